"""Structure of long frame series: passages that come again, and regions around prominent peaks.

A series is cut into chunks of frames with what they need of their neighbours, so that no task holds a timeline.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.folds import min_spacing_filter, select_by_score
from cuesheet.operators.frames import local_extrema, moving_average, quantile, unit
from cuesheet.operators.intervals import Keys, islands, overlap_join

#: of the grid on which similarities are counted and compared
GRID = 1000


def flat_peaks(rows: DataFrame, col: str, keys: Keys, order: str) -> DataFrame:
    """Local maxima (keys, order, col): runs of equal values higher than both neighbours, at their middle frame; `order` counts up by one."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(col).over(w)
    runs = islands(rows.withColumn("_new", F.coalesce(F.col(col) != before, F.lit(True))), keys, [order], F.col("_new"))
    flat = runs.groupBy(*keys, "island").agg(F.min(order).alias("_a"), F.max(order).alias("_b"), F.first(col).alias(col))
    sides = Window.partitionBy(*keys).orderBy("island")
    tops = flat.withColumns({"_before": F.lag(col).over(sides), "_after": F.lead(col).over(sides)}).where((F.col(col) > F.col("_before")) & (F.col(col) > F.col("_after")))
    return tops.select(*keys, F.floor((F.col("_a") + F.col("_b")) / 2).cast("long").alias(order), col)


def diagonal_runs(frames: DataFrame, keys: Keys, order: str, vector: str, reach: int, share: float = 0.7, shortest: int = 3, hole: int = 1, chunk: int = 512) -> DataFrame:
    """Runs along the diagonals of a timeline's self-similarity, up to `reach` frames off the main one: keys, lag, first, last (frames counted from 0).

    Frames i and i + lag are similar if their cosine is above the `share`-quantile of all positive ones within the reach, both on a grid of GRID steps. Runs of
    fewer than `shortest` frames are dropped, then holes of up to `hole` frames filled. Vectors without length are like none.
    Each chunk of frames meets itself and the head of the next as one product of matrices.
    """
    size = max(chunk, reach)
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    rows = frames.select(*keys, nr.cast("long").alias("_nr"), F.coalesce(F.transform(unit(F.col(vector)), lambda x: F.coalesce(x, F.lit(0.0))), F.array()).alias("_u"))
    own = F.floor(F.col("_nr") / size)
    dealt = rows.withColumn("_c", F.explode(F.array_compact(F.array(own, F.when((F.col("_nr") % size < reach) & (own > 0), own - 1)))))
    types = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def steps(part: pd.DataFrame, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The similarity of the chunk's own frames with those 1 to `reach` later, in steps of the grid; -1 where there is none."""
        part = part.sort_values("_nr")
        width = max(map(len, part["_u"]), default=0)
        all_ = np.zeros((len(part), width))
        for row, x in zip(all_, part["_u"], strict=True):
            row[: len(x)] = x
        mine = all_[part["_nr"].to_numpy() // size == c]
        found = np.floor(mine @ all_.T * GRID + 0.5).astype(int)
        at = np.arange(len(mine))[:, None] + np.arange(1, reach + 1)[None]
        out = np.where(at < len(part), np.take_along_axis(found, np.minimum(at, len(part) - 1), 1), -1)
        return part["_nr"].to_numpy()[: len(mine)], out

    def counted(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        value, n = np.unique(steps(part, key[-1])[1], return_counts=True)
        return pd.DataFrame({**dict(zip(keys, key[:-1], strict=True)), "_g": value, "_n": n})[[*keys, "_g", "_n"]].query("_g > 0")

    def ran(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        nrs, found = steps(part, key[-1])
        on = np.pad(found > part["_g"].iloc[0], ((1, 1), (0, 0))).astype(np.int8)
        lag, first = np.nonzero(np.diff(on, axis=0).T == 1)
        last = np.nonzero(np.diff(on, axis=0).T == -1)[1] - 1
        base = int(nrs[0]) if len(nrs) else 0
        return pd.DataFrame({**dict(zip(keys, key[:-1], strict=True)), "lag": lag + 1, "first": first + base, "last": last + base})[[*keys, "lag", "first", "last"]]

    histogram = dealt.groupBy(*keys, "_c").applyInPandas(counted, f"{types}, _g int, _n long").groupBy(*keys, "_g").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_g")  # GRID rows at most
    below = histogram.withColumns({"_below": F.sum("_n").over(w), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    threshold = below.where(F.col("_below") >= share * F.col("_all")).groupBy(*keys).agg(F.min("_g").alias("_g"))
    found = dealt.join(threshold, list(keys)).groupBy(*keys, "_c").applyInPandas(ran, f"{types}, lag long, first long, last long")
    diagonal = [*keys, "lag"]
    whole = _joined(found, diagonal, 0).where(F.col("last") - F.col("first") + 1 >= shortest)
    return _joined(whole, diagonal, hole)


def _joined(runs: DataFrame, keys: Keys, hole: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("first")
    apart = F.coalesce(F.col("first") - F.col("_last") - 1 > hole, F.lit(True))
    return islands(runs.withColumn("_last", F.lag("last").over(w)), keys, ["first"], apart).groupBy(*keys, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def repeating_blocks(frames: DataFrame, keys: Keys, order: str, vector: str, block: int, height: float = 0.3, similar: float = 0.5, reach: int | None = None, **runs: float) -> DataFrame:
    """Stretches of about `block` frames that come again: first, last (exclusive; frames from 0), score, similarity, occurrences.

    A frame's score is the number of similar frames up to 2 x `block` (and half the timeline) away, itself included, over the timeline's largest; blocks stand around peaks
    of at least `height`, `block` frames apart from each other. Similarity is the share of similar pairs inside a block. A block occurs again at each
    shift from its own size on, in steps of half of it and up to `reach` (by default 2 x `block`), at which more than `similar` of its frames are similar.
    """
    reach = reach or 2 * block
    found = diagonal_runs(frames, keys, order, vector, max(reach, 2 * block), **runs)
    sizes = frames.groupBy(*keys).agg(F.count("*").alias("_n"))
    near = found.join(sizes, list(keys)).where((F.col("lag") <= 2 * block) & (F.col("lag") <= F.floor(F.col("_n") / 2)))
    edges = F.explode(F.array(*(F.struct((F.col(at) + shift).alias("_nr"), F.lit(n).alias("_d")) for at, shift, n in (("first", F.lit(0), 1), ("last", F.lit(1), -1), ("first", F.col("lag"), 1), ("last", F.col("lag") + 1, -1)))))
    steps = near.select(*keys, edges.alias("e")).groupBy(*keys, F.col("e._nr").alias("_nr")).agg(F.sum("e._d").alias("_d"))
    w = Window.partitionBy(*keys).orderBy("_nr")
    nr = (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long")
    at = frames.select(*keys, nr.alias("_nr")).join(steps, [*keys, "_nr"], "left")
    held = at.select(*keys, "_nr", (1 + F.coalesce(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).cast("double").alias("_held"))
    scored = held.withColumn("_held", F.col("_held") / F.max("_held").over(Window.partitionBy(*keys)))
    peaks = flat_peaks(scored, "_held", keys, "_nr").where(F.col("_held") >= height).select(*keys, F.col("_nr").cast("double").alias("_nr"), F.col("_held").alias("score"))
    tops = select_by_score(peaks, keys, "_nr", "score", float(block)).join(sizes, list(keys))
    half = block // 2
    blocks = tops.select(*keys, F.greatest(F.col("_nr") - half, F.lit(0)).cast("long").alias("first"), F.least(F.col("_nr") + half, F.col("_n")).cast("long").alias("last"), "score", "_n")
    spans = found.select(*keys, "lag", F.col("first").cast("double").alias("start_s"), (F.col("last") + 1).cast("double").alias("end_s"))
    met = overlap_join(blocks.withColumns({"start_s": F.col("first").cast("double"), "end_s": F.col("last").cast("double")}), spans, keys)
    inside = F.greatest(F.lit(0), F.least(F.col("last") - F.col("b_lag"), F.col("b_end_s")) - F.greatest(F.col("first"), F.col("b_start_s")))
    by_lag = met.groupBy(*keys, "first", "last", "_n", "b_lag").agg(F.sum(inside).alias("_in"), F.sum("overlap_s").alias("_on"))
    size = F.col("last") - F.col("first")
    step = F.greatest(F.lit(1), F.floor(size / 2))
    most = F.least(F.col("_n") - F.col("last") + 1, F.floor(F.col("_n") / 2), F.lit(reach + 1))
    again = (F.col("b_lag") >= size) & (F.col("b_lag") < most) & ((F.col("b_lag") - size) % step == 0) & (F.col("last") + F.col("b_lag") <= F.col("_n")) & (F.col("_on") / size > similar)
    sums = by_lag.groupBy(*keys, "first", "last").agg(F.sum("_in").alias("_in"), F.count_if(again).alias("_again"))
    size = F.col("last") - F.col("first")
    share = (size + 2 * F.coalesce("_in", F.lit(0.0))) / (size * size)
    return blocks.join(sums, [*keys, "first", "last"], "left").select(*keys, "first", "last", "score", share.alias("similarity"), (1 + F.coalesce("_again", F.lit(0))).alias("occurrences"))


def numbered_frames(rows: DataFrame, keys: Keys, order: str, col: str) -> DataFrame:
    """Frames (keys, nr from 0, v) in order."""
    return rows.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long").alias("nr"), F.col(col).cast("double").alias("v"))


def prominences(series: DataFrame, peaks: DataFrame, keys: Keys, chunk: int = 4096) -> DataFrame:
    """Peaks (keys, nr, v) with their prominence in a series (keys, nr from 0, v): how far it falls on both sides before it rises higher, or ends.

    A peak looks for the nearest higher frame in its own chunk of frames first, then for the nearest chunk with one among the chunks' highest and lowest values,
    and last inside that chunk. A task reads its chunks one after the other, each before its questions, and holds those of an Arrow batch and one more, however long a timeline is.
    """
    types = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)
    at = [*keys, "c"]
    # columns of its own, as both sides of a union come from one series
    dealt = series.select(*(F.col(x).alias(x) for x in (*keys, "nr", "v")), F.floor(F.col("nr") / chunk).alias("c"))
    asked_of = [*at, "nr", "v", "p", "side", "low"]

    def answered(part: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        """Questions (p, nr, v, side, low) behind the frames (side 0) of their chunk: from frame nr on towards the side, until one is above v."""
        frames = part["side"].to_numpy() == 0
        asked, own = part[~frames], group[~frames]
        values, numbers = part["v"].to_numpy()[frames], part["nr"].to_numpy()[frames]
        first, end = np.searchsorted(group[frames], own, "left"), np.searchsorted(group[frames], own, "right")
        v, side, low = asked["v"].to_numpy(), asked["side"].to_numpy(), asked["low"].to_numpy().copy()
        base = numbers[np.minimum(first, len(numbers) - 1)] if len(numbers) else first
        spot = first + asked["nr"].to_numpy() - base
        spot, met = np.where(side < 0, np.minimum(spot, end - 1), spot), np.zeros(len(asked), bool)
        on = np.flatnonzero((spot >= first) & (spot < end))
        while len(on):
            x = values[spot[on]]
            higher = x > v[on]
            met[on[higher]] = True
            on, x = on[~higher], x[~higher]
            low[on] = np.minimum(low[on], x)
            spot[on] += side[on]
            on = on[(spot[on] >= first[on]) & (spot[on] < end[on])]
        return asked.assign(met=met, low=low)[[*keys, "p", "v", "side", "c", "met", "low"]]

    def looked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            ids, before = part[at], part[at].shift()
            group = (~((ids == before) | (ids.isna() & before.isna())).all(axis=1)).to_numpy().cumsum()
            # the last chunk may go on in the next batch
            last = int(np.searchsorted(group, group[-1])) if len(part) else 0
            held = part[last:]
            yield answered(part[:last], group[:last])
        if held is not None:
            yield answered(held, np.zeros(len(held), int))

    def ask(questions: DataFrame) -> DataFrame:
        frames = dealt.select(*at, "nr", "v", F.lit(-1).cast("long").alias("p"), F.lit(0).alias("side"), F.lit(0.0).alias("low"))
        rows = frames.unionByName(questions.select(*asked_of)).repartition(*at).sortWithinPartitions(*at, F.col("side") != 0, "nr")
        return rows.mapInPandas(looked, f"{types}, p long, v double, side int, c long, met boolean, low double")

    sides = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    own = ask(peaks.select(*keys, F.col("nr").alias("p"), "nr", "v", sides).withColumns({"c": F.floor(F.col("nr") / chunk), "low": F.lit(float("inf"))}))
    chunks = dealt.groupBy(*at).agg(F.max("v").alias("top"), F.min("v").alias("least"))
    ways = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("c").alias("other"), "top", "least"))).alias("way"))
    start = F.struct(F.lit(None).cast("long").alias("other"), F.col("low").alias("low"))
    step = lambda s, x: F.when(s["other"].isNotNull(), s).when(x["top"] > F.col("v"), F.struct(x["other"].alias("other"), s["low"].alias("low"))).otherwise(F.struct(s["other"].alias("other"), F.least(s["low"], x["least"]).alias("low")))
    way = F.when(F.col("side") < 0, F.reverse(F.filter("way", lambda x: x["other"] < F.col("c")))).otherwise(F.filter("way", lambda x: x["other"] > F.col("c")))
    far = F.when(~F.col("met"), F.aggregate(way, start, step)).otherwise(start)
    passed = own.join(ways, list(keys)).withColumn("far", far).select(*keys, "p", "v", "side", F.col("far.other").alias("c"), F.col("far.low").alias("low"))
    # inside the chunk with a higher frame the way begins at its near end; who has none is in no chunk now
    last = ask(passed.withColumn("nr", F.coalesce(F.when(F.col("side") < 0, (F.col("c") + 1) * chunk - 1).otherwise(F.col("c") * chunk), F.col("p"))))
    return last.groupBy(*keys, "p").agg(F.first("v").alias("v"), F.max("low").alias("low")).select(*keys, F.col("p").alias("nr"), "v", (F.col("v") - F.col("low")).alias("prominence"))


def energy_regions(rows: DataFrame, keys: Keys, order: str, col: str, smooth: int, distance: int, before: int, after: int, shortest: int, prominence: float = 0.03, chunk: int = 4096) -> DataFrame:
    """Stretches around energy peaks: first, last (exclusive; frames from 0), prominence, confidence (the peak over the timeline's highest).

    The energy is smoothed over `smooth` frames. Peaks reach its median at least, are `distance` frames apart, the highest first, and then need the prominence. A stretch is
    cut at the timeline's ends and has `shortest` frames or more.
    """
    series = numbered_frames(rows.select(*keys, order, moving_average(col, keys, order, smooth).alias("_s")), keys, order, "_s")
    level = series.groupBy(*keys).agg(quantile("v", 0.5).alias("_p50"), F.max("v").alias("_top"), F.count("*").alias("_n"))
    tops = flat_peaks(series, "v", keys, "nr").join(level, list(keys)).where(F.col("v") >= F.col("_p50")).select(*keys, F.col("nr").cast("double").alias("_at"), "v")
    peaks = select_by_score(tops, keys, "_at", "v", float(distance)).select(*keys, F.col("_at").cast("long").alias("nr"), "v")
    found = prominences(series, peaks, keys, chunk).where(F.col("prominence") >= prominence).join(level, list(keys))
    spans = found.select(*keys, F.greatest(F.col("nr") - before, F.lit(0)).alias("first"), F.least(F.col("nr") + after, F.col("_n")).alias("last"), "prominence", (F.col("v") / F.col("_top")).alias("confidence"))
    return spans.where(F.col("last") - F.col("first") >= shortest)


def song_boundaries(points: DataFrame, frames: DataFrame, totals: DataFrame, keys: Keys, time: str, score: str, energy: str, distance: float = 15.0, tail: float = 15.0, song: float = 180.0, fewest: int = 5, reach: int = 10, order: str | None = None) -> DataFrame:
    """Boundaries (t, origin) of timelines (total_s): the best candidates (time, score) `distance` apart, none within `tail` of the end.

    Where a timeline longer than one song has fewer than one boundary for each `song` seconds, or than `fewest`, valleys of the frames' energy are added: frames lower than all of `reach`
    neighbours on both sides, `distance` from each other and from the start, more than that from every boundary chosen, none within `tail` of the end. Frames are neighbours by
    `order`, which tells those at one time apart, or by their time alone.
    """
    ends = totals.select(*keys, F.col("total_s").alias("_end"))
    early = points.select(*keys, F.col(time).alias("t"), F.col(score).alias("score")).join(ends, list(keys)).where(F.col("_end") - F.col("t") >= tail).drop("_end")
    chosen = select_by_score(early, keys, "t", "score", distance)
    counts = ends.join(chosen.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys), "left")
    few = counts.where((F.col("_end") > song) & (F.coalesce("_n", F.lit(0)) < F.greatest(F.lit(fewest), F.floor(F.col("_end") / song)))).select(*keys, "_end")
    valleys = local_extrema(frames.join(few, list(keys)), energy, keys, order or time, reach, "min").where(F.col("_end") - F.col(time) >= tail)
    spaced = min_spacing_filter(valleys.select(*keys, F.col(time).alias("t")), keys, "t", distance, 0.0)
    around = chosen.select(*keys, "t", (F.col("t") - distance).alias("start_s"), (F.col("t") + distance).alias("end_s"))
    met = overlap_join(spaced.withColumns({"start_s": F.col("t"), "end_s": F.col("t")}), around, keys, eps=-1e-6)
    # the edges of the stretches are rounded, the distance decides
    near = met.where(F.abs(F.col("b_t") - F.col("t")) <= distance).select(*keys, "t").distinct()
    added = spaced.join(near, [*keys, "t"], "left_anti")
    return chosen.select(*keys, "t", F.lit("score").alias("origin")).unionByName(added.select(*keys, "t", F.lit("valley").alias("origin")))
