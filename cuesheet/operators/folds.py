"""Sequence folds: each decision depends on the one before it.

A timeline's points are gathered into one sorted array (boundaries and segments of one recording) and folded by the built-in
`aggregate`, so that no row leaves the JVM. Where a wide gap makes what follows independent of what came before, as in spacing, only the
stretches between such gaps are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.frames import quantile
from cuesheet.operators.intervals import Keys, islands


def gathered(rows: DataFrame, keys: Keys, *columns: str) -> DataFrame:
    """One row for each timeline: `items`, its rows as structs of the columns, sorted by them in turn."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))


def fold(rows: DataFrame, keys: Keys, columns: list[str], start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> DataFrame:
    """Rows of what `finish` gives (an array of structs) after folding each timeline's items."""
    out = gathered(rows, keys, *columns).select(*keys, F.explode(F.aggregate("items", start, step, finish)).alias("_x"))
    return out.select(*keys, "_x.*")


def stretches(points: DataFrame, keys: Keys, time: str, gap: float) -> tuple[DataFrame, list[str]]:
    """The points with the number of their stretch, and the keys of a stretch: points at least `gap` apart are in different ones."""
    w = Window.partitionBy(*keys).orderBy(time)
    apart = points.withColumn("_gap", F.col(time) - F.lag(time).over(w))
    return islands(apart, keys, [time], F.coalesce(F.col("_gap") >= gap, F.lit(True))).drop("_gap"), [*keys, "island"]


def _typed(fields: str) -> Column:
    return F.array().cast(f"array<struct<{fields}>>")


def _kept(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))


def _last(items: Column) -> Column:
    return F.element_at(items, -1)


def min_spacing_filter(points: DataFrame, keys: Keys, time: str, distance: float, start: float) -> DataFrame:
    """Points at least `distance` after the last that was kept; the first is measured from `start`."""
    step = lambda acc, x: F.when(x[time] - acc["at"] >= distance, F.struct(x[time].alias("at"), _kept(acc["out"], x).alias("out"))).otherwise(acc)
    init = F.struct(F.lit(float(start)).alias("at"), _typed(f"{time}: double").alias("out"))
    rows, parts = stretches(points.where(F.col(time) >= start + distance), keys, time, distance)
    return fold(rows, parts, [time], init, step, lambda acc: acc["out"]).drop("island")


def suppress_close_candidates(points: DataFrame, keys: Keys, time: str, score: str, gap: float = 60.0) -> DataFrame:
    """Of two candidates in a row closer than the gap the better one; of equal ones the first."""

    def step(acc: Column, x: Column) -> Column:
        near = (F.size(acc) > 0) & (x[time] - F.try_element_at(acc, F.lit(-1))[time] < gap)
        better = x[score] > F.try_element_at(acc, F.lit(-1))[score]
        return F.when(near & better, _kept(F.slice(acc, 1, F.size(acc) - 1), x)).when(near, acc).otherwise(_kept(acc, x))

    return fold(points, keys, [time, score], _typed(f"{time}: double, {score}: double"), step, lambda acc: acc)


def cluster_boundaries(points: DataFrame, keys: Keys, time: str, source: str, weights: Mapping[str, float], radius: float = 15.0, keep: float = 0.55) -> DataFrame:
    """Clusters of points in time order: a point joins the first whose weighted centre is within the radius. Columns center, score, n.

    The score is the sum of the weights of the sources that a cluster holds; clusters with less than `keep` are left out.
    """
    weight = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))
    rows = points.withColumn("_w", weight[F.col(source)])
    init = F.array().cast("array<struct<center: double, total: double, sum: double, n: int, sources: array<string>>>")

    def step(acc: Column, x: Column) -> Column:
        which = F.array_min(F.filter(F.transform(acc, lambda c, i: F.when(F.abs(x[time] - c["center"]) <= radius, i)), lambda i: i.isNotNull()))

        def joined(c: Column) -> Column:
            total, weighted = c["total"] + x["_w"], c["sum"] + x[time] * x["_w"]
            return F.struct((weighted / total).alias("center"), total.alias("total"), weighted.alias("sum"), (c["n"] + 1).alias("n"), F.array_union(c["sources"], F.array(x[source])).alias("sources"))

        new = F.struct(x[time].alias("center"), x["_w"].alias("total"), (x[time] * x["_w"]).alias("sum"), F.lit(1).alias("n"), F.array(x[source]).alias("sources"))
        return F.when(which.isNull(), _kept(acc, new)).otherwise(F.transform(acc, lambda c, i: F.when(i == which, joined(c)).otherwise(c)))

    score = lambda c: F.aggregate(c["sources"], F.lit(0.0), lambda s, x: s + weight[x])
    found = fold(rows, keys, [time, source, "_w"], init, step, lambda acc: F.transform(acc, lambda c: F.struct(c["center"], score(c).alias("score"), c["n"])))
    return found.where(F.col("score") >= keep - 1e-9)


def select_by_score(points: DataFrame, keys: Keys, time: str, score: str, distance: float, compat: bool = False) -> DataFrame:
    """Best-first selection of points at least `distance` from every one selected (in compat mode: from the last selected, and after it); of equal scores the earlier."""
    rows = points.withColumns({"_rank": -F.col(score)})

    def step(acc: Column, x: Column) -> Column:
        apart = F.forall(acc, lambda k: F.abs(k[time] - x[time]) >= distance)
        if compat:
            apart = (F.size(acc) == 0) | (x[time] - F.try_element_at(acc, F.lit(-1))[time] >= distance)
        return F.when(apart, _kept(acc, F.struct(x[time].alias(time), (-x["_rank"]).alias(score)))).otherwise(acc)

    if compat:
        return fold(rows, keys, ["_rank", time], _typed(f"{time}: double, {score}: double"), step, lambda acc: acc)
    rows, parts = stretches(rows, keys, time, distance)
    return fold(rows, parts, ["_rank", time], _typed(f"{time}: double, {score}: double"), step, lambda acc: acc).drop("island")


def peaks_with_min_distance(rows: DataFrame, col: str, keys: Keys, order: str, distance: int, height: float) -> DataFrame:
    """Strict local maxima of at least `height`, kept from highest to lowest unless nearer than `distance` frames to a kept one."""
    w = Window.partitionBy(*keys).orderBy(order)
    sides = rows.withColumns({"_a": F.lag(col).over(w), "_b": F.lead(col).over(w)})
    tops = sides.where((F.col(col) > F.col("_a")) & (F.col(col) > F.col("_b")) & (F.col(col) >= height)).withColumn("_at", F.col(order).cast("double"))
    found = select_by_score(tops, keys, "_at", col, float(distance))
    return found.select(*keys, F.col("_at").cast("long").alias(order), col)


def suppress_overlaps_by_confidence(segments: DataFrame, keys: Keys, ident: str, tolerance: float = 1.0) -> DataFrame:
    """In time order, of two segments in a row that overlap by more than the tolerance the more confident; of equal ones the first."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        over = (F.size(acc) > 0) & (last["end_s"] - x["start_s"] > tolerance)
        return F.when(over & (x["confidence"] > last["confidence"]), _kept(F.slice(acc, 1, F.size(acc) - 1), x)).when(over, acc).otherwise(_kept(acc, x))

    return fold(segments, keys, ["start_s", "end_s", "confidence", ident], _typed(f"start_s: double, end_s: double, confidence: double, {ident}: bigint"), step, lambda acc: acc)


def merge_short_runs(segments: DataFrame, keys: Keys, shortest: float) -> DataFrame:
    """In time order, a segment shorter than `shortest` joins the one before it, if there is one: start_s, end_s, label."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        short = (F.size(acc) > 0) & (x["end_s"] - x["start_s"] < shortest)
        longer = F.struct(last["start_s"].alias("start_s"), F.greatest(last["end_s"], x["end_s"]).alias("end_s"), last["label"].alias("label"))
        return F.when(short, _kept(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(_kept(acc, x))

    return fold(segments, keys, ["start_s", "end_s", "label"], _typed("start_s: double, end_s: double, label: string"), step, lambda acc: acc)


def trim_edge_runs(segments: DataFrame, keys: Keys, ident: str, shortest: float = 1.0) -> DataFrame:
    """Segments in time order with whole edges: start_s, end_s, label.

    What begins a timeline joins the next segment, whose label it takes, until at least `shortest` seconds are together; what ends one
    joins the segment before in the same way. Then equal labels in a row at either edge are one segment. One segment alone stays as it is.
    """
    w = Window.partitionBy(*keys)
    rows = segments.select(*keys, "start_s", "end_s", "label", F.row_number().over(w.orderBy("start_s", "end_s", ident)).alias("_nr"))
    rows = rows.withColumns({"_from": F.min_by("start_s", "_nr").over(w), "_to": F.max_by("end_s", "_nr").over(w)})
    rows = rows.withColumn("_k", F.coalesce(F.min(F.when(F.col("end_s") - F.col("_from") >= shortest, F.col("_nr"))).over(w), F.max("_nr").over(w)))
    rows = rows.where("_nr >= _k").withColumn("start_s", F.when(F.col("_nr") == F.col("_k"), F.col("_from")).otherwise(F.col("start_s")))
    rows = rows.withColumn("_j", F.coalesce(F.max(F.when(F.col("_to") - F.col("start_s") >= shortest, F.col("_nr"))).over(w), F.col("_k")))
    rows = rows.where("_nr <= _j").withColumn("end_s", F.when(F.col("_nr") == F.col("_j"), F.col("_to")).otherwise(F.col("end_s")))
    rows = rows.withColumns({"_a": F.min_by("label", "_nr").over(w), "_b": F.max_by("label", "_nr").over(w)})
    other = lambda edge: F.when(~F.col("label").eqNullSafe(F.col(edge)), F.col("_nr"))
    rows = rows.withColumns({"_head": F.min(other("_a")).over(w), "_tail": F.max(other("_b")).over(w)})
    part = F.when(F.col("_head").isNull() | (F.col("_nr") < F.col("_head")), 0).when(F.col("_nr") > F.col("_tail"), -1).otherwise(F.col("_nr"))
    return rows.groupBy(*keys, part.alias("_part")).agg(F.min_by("start_s", "_nr").alias("start_s"), F.max_by("end_s", "_nr").alias("end_s"), F.min_by("label", "_nr").alias("label")).drop("_part")


#: sentence punctuation that ends a chunk
CHUNK_ENDS = "。！？!?,，、；;：:"


def words_to_chunks(words: DataFrame, keys: Keys, max_chars: int = 24, max_gap: float = 0.6) -> DataFrame:
    """Words in order as lines: a new one after a gap, when it would grow too long, and after punctuation. Columns text, start_s, end_s.

    ASCII letters or digits that would meet are parted by a space; blank words are left out.
    """
    rows = words.withColumn("word", F.trim("word")).where("word <> ''")
    # a wide gap and punctuation begin a line whatever came before, so only what is between them is gathered
    order = ["word_pos", "word", "start_s", "end_s"]
    w = Window.partitionBy(*keys).orderBy(*order)
    ended = F.contains(F.lit(CHUNK_ENDS), F.right(F.lag("word").over(w), F.lit(1))) | (F.greatest(F.lit(0.0), F.col("start_s") - F.lag("end_s").over(w)) > max_gap)
    rows = islands(rows.withColumn("_new", F.coalesce(ended, F.lit(True))), keys, order, F.col("_new"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        text = last["text"]
        new = F.struct(x["word"].alias("text"), x["start_s"].alias("start_s"), x["end_s"].alias("end_s"))
        gap = F.greatest(F.lit(0.0), x["start_s"] - last["end_s"])
        apart = (F.size(acc) == 0) | (gap > max_gap) | (F.length(text) + F.length(x["word"]) > max_chars) | F.contains(F.lit(CHUNK_ENDS), F.right(text, F.lit(1)))
        joint = F.when(text.rlike("[A-Za-z0-9]$") & x["word"].rlike("^[A-Za-z0-9]"), " ").otherwise("")
        grown = F.struct(F.concat(text, joint, x["word"]).alias("text"), last["start_s"].alias("start_s"), x["end_s"].alias("end_s"))
        return F.when(apart, _kept(acc, new)).otherwise(_kept(F.slice(acc, 1, F.size(acc) - 1), grown))

    return fold(rows, [*keys, "island"], order, _typed("text: string, start_s: double, end_s: double"), step, lambda acc: acc).drop("island")


def merge_fragments(sentences: DataFrame, keys: Keys, max_gap: float = 0.45, max_chars: int = 15, max_s: float = 5.0, left_gap: float = 0.5, left_chars: int = 24) -> DataFrame:
    """Close short pieces of a sentence as one: both together short, and either tiny or the first without final punctuation.

    In a second pass a single character that is left joins the piece before it, or else the one after it, if within `left_gap` seconds of
    one that has at most `left_chars` characters.
    """
    rows = sentences.withColumn("text", F.trim("text")).where("text <> ''")

    def together(a: Column, b: Column) -> Column:
        joint = F.when(a["text"].rlike("[A-Za-z0-9]$") & b["text"].rlike("^[A-Za-z0-9]"), " ").otherwise("")
        return F.struct(a["start_s"].alias("start_s"), F.greatest(a["end_s"], b["end_s"]).alias("end_s"), F.concat(a["text"], joint, b["text"]).alias("text"))

    def short(acc: Column, x: Column) -> Column:
        last = _last(acc)
        a, b = last["text"], x["text"]
        near = (F.greatest(F.lit(0.0), x["start_s"] - last["end_s"]) <= max_gap) & (F.length(a) + F.length(b) <= max_chars) & (F.greatest(last["end_s"], x["end_s"]) - last["start_s"] <= max_s)
        open_ = (F.length(a) <= 2) | (F.length(b) <= 2) | ~F.contains(F.lit(CHUNK_ENDS + "."), F.right(a, F.lit(1)))
        return F.when((F.size(acc) > 0) & near & open_, _kept(F.slice(acc, 1, F.size(acc) - 1), together(last, x))).otherwise(_kept(acc, x))

    def single(acc: Column, x: Column) -> Column:
        last = _last(acc)
        a, b = F.length(last["text"]), F.length(x["text"])
        alone = (a <= 1) & (b <= left_chars) | (b <= 1) & (a <= left_chars)
        return F.when((F.size(acc) > 0) & alone & (x["start_s"] - last["end_s"] <= left_gap), _kept(F.slice(acc, 1, F.size(acc) - 1), together(last, x))).otherwise(_kept(acc, x))

    none = _typed("start_s: double, end_s: double, text: string")
    return fold(rows, keys, ["start_s", "end_s", "text"], none, short, lambda acc: F.aggregate(acc, none, single))


def first_last_relabel(segments: DataFrame, keys: Keys, shortest: float = 12.0, edge: float = 25.0) -> DataFrame:
    """Short segments joined to the one before; then a first one under `edge` seconds is the intro and a last one the outro: start_s, end_s, label."""
    rows = merge_short_runs(segments, keys, shortest)
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"_nr": F.row_number().over(w.orderBy("start_s", "end_s")), "_n": F.count("*").over(w)})
    short = F.col("end_s") - F.col("start_s") < edge
    label = F.when((F.col("_nr") == 1) & short, "intro").when((F.col("_nr") == F.col("_n")) & short, "outro").otherwise(F.col("label"))
    return rows.withColumn("label", label).drop("_nr", "_n")


def enforce_max_length(segments: DataFrame, keys: Keys, ident: str, longest: float) -> DataFrame:
    """Same-label neighbours joined while the whole stays within `longest` and the gap is at most 2 s: start_s, end_s, label, n."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (last["label"] == x["label"]) & (x["start_s"] - last["end_s"] <= 2) & (F.greatest(last["end_s"], x["end_s"]) - last["start_s"] <= longest)
        new = F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("end_s"), x["label"].alias("label"), F.lit(1).alias("n"))
        grown = F.struct(last["start_s"].alias("start_s"), F.greatest(last["end_s"], x["end_s"]).alias("end_s"), last["label"].alias("label"), (last["n"] + 1).alias("n"))
        return F.when(joins, _kept(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(_kept(acc, new))

    return fold(segments, keys, ["start_s", "end_s", "label", ident], _typed("start_s: double, end_s: double, label: string, n: int"), step, lambda acc: acc)


def structure_split(frames: DataFrame, beats: DataFrame, totals: DataFrame, keys: Keys, target: float, shortest: float, longest: float, least: float = 3.0) -> DataFrame:
    """Timelines (total_s) in parts of about `target` seconds: start_s, end_s; parts under `least` seconds are left out.

    A part ends between `shortest` and `longest` after its start, at the frame (t, change) of strong change that is nearest to the target, a large change
    counting for up to 0.3 of it, else at the target; then it moves to the nearest beat (t) within 2 s. Changes above the 70th percentile are strong, or where
    fewer than three are, above the median. Gathered are the strong frames and beats of one timeline.
    """
    q = frames.groupBy(*keys).agg(quantile("change", 0.7).alias("_p70"), quantile("change", 0.5).alias("_p50"))
    marked = frames.join(q, list(keys))
    counts = marked.groupBy(*keys).agg((F.count_if(F.col("change") > F.col("_p70")) < 3).alias("_few"))
    strong = marked.join(counts, list(keys)).where((F.col("change") > F.col("_p70")) | F.col("_few") & (F.col("change") > F.col("_p50")))
    rows = totals.join(gathered(strong, keys, "t", "change"), list(keys), "left").join(beats.groupBy(*keys).agg(F.sort_array(F.collect_set("t")).alias("_b")), list(keys), "left")
    rows = rows.withColumns({"items": F.coalesce("items", _typed("t: double, change: double")), "_b": F.coalesce("_b", F.array().cast("array<double>"))})

    def step(cuts: Column, _: Column) -> Column:
        at = _last(cuts)
        ideal, low, high = at + target, at + shortest, F.least(at + longest, F.col("total_s"))
        cost = lambda x: F.round(F.abs(x["t"] - ideal) / target - x["change"] * 0.3, 9)
        best = F.array_min(F.transform(F.filter("items", lambda x: (x["t"] >= low) & (x["t"] <= high)), lambda x: F.struct(cost(x).alias("c"), x["t"].alias("t"))))["t"]
        best = F.coalesce(best, F.least(high, ideal))
        beat = F.array_min(F.transform(F.filter("_b", lambda b: F.abs(b - best) < 2.0), lambda b: F.struct(F.abs(b - best).alias("d"), b.alias("b"))))["b"]
        cut = F.when(beat.isNotNull(), F.greatest(low, F.least(beat, high))).otherwise(best)
        return F.when(at < F.col("total_s") - shortest, _kept(cuts, cut)).otherwise(cuts)

    cuts = F.aggregate(F.sequence(F.lit(1), F.ceil(F.col("total_s") / shortest).cast("int") + 1), F.array(F.lit(0.0)), step)
    ends = rows.withColumn("_c", F.concat(cuts, F.array("total_s"))).select(*keys, F.posexplode(F.slice("_c", F.lit(1), F.size("_c") - 1)).alias("_i", "start_s"), "_c")
    return ends.select(*keys, "start_s", F.element_at("_c", F.col("_i") + 2).alias("end_s")).where(F.col("end_s") - F.col("start_s") >= least)
