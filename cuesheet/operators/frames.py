"""Frame series: smoothing, extrema, masks, statistics, vectors.

Frames of a timeline are ordered by `order`; windows are over the key columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cuesheet.operators.intervals import BUCKET_S, Keys, in_buckets, islands, merge_intervals, overlap_join, share_of


def centred(keys: Keys, order: str, size: int) -> WindowSpec:
    """`size` frames around a frame, one more before than after if even; fewer at the ends."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size // 2), size - 1 - size // 2)


def quantile(col: str, share: float) -> Column:
    """The share-quantile of a group's values: both neighbours weighed, the lower one's product and the sum rounded together, as DuckDB does.

    F.percentile rounds each step; where values lie as close as sums in another order do, another of them is then above the quantile.
    """
    values = F.sort_array(F.collect_list(col))
    at = (F.size(values) - 1) * F.lit(share)
    low, high = (F.element_at(values, (f(at) + 1).cast("int")) for f in (F.floor, F.ceil))
    part = at - F.floor(at)
    return F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")


def in_chunks(rows: DataFrame, keys: Keys, order: str, reach: int, f: Callable[[DataFrame, list[str]], DataFrame], chunk: int = 1 << 16) -> DataFrame:
    """What `f(rows, keys)` gives, where each frame depends on no more than `reach` frames on either side, without one task for a timeline.

    Frames are numbered by `order` without holes. Each chunk of them is handled as a timeline of its own with the frames within reach on both sides beside it, whose own results are dropped; so a long recording is spread
    over as many tasks as it has chunks.
    """
    own = F.floor(F.col(order) / chunk)
    each = F.array_distinct(F.array(own, F.floor((F.col(order) - reach) / chunk), F.floor((F.col(order) + reach) / chunk)))
    found = f(rows.withColumn("_chunk", F.explode(each)), [*keys, "_chunk"])
    return found.where(F.col("_chunk") == own).drop("_chunk")


def moving_average(col: str | Column, keys: Keys, order: str, size: int) -> Column:
    return F.avg(col).over(centred(keys, order, size))


def reflected_average(rows: DataFrame, col: str, keys: Keys, order: str, size: int) -> DataFrame:
    """Adds smooth: the mean of `size` frames around each, the series mirrored at its ends (the first and last frame twice). Timelines have `size` frames or more."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"_nr": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    mirror = F.when(F.col("_nr") <= size // 2, 1 - F.col("_nr")), F.when(F.col("_n") - F.col("_nr") < size // 2, 2 * F.col("_n") + 1 - F.col("_nr"))
    places = F.array_compact(F.array(F.col("_nr"), *mirror))
    spread = rows.withColumn("_at", F.explode(places))
    mean = F.avg(col).over(w.orderBy("_at").rowsBetween(-(size // 2), size - 1 - size // 2))
    return spread.withColumn("smooth", mean).where(F.col("_at") == F.col("_nr")).drop("_nr", "_n", "_at")


def local_extrema(rows: DataFrame, col: str, keys: Keys, order: str, reach: int, kind: str = "max") -> DataFrame:
    """Frames strictly above (or below) all of up to `reach` neighbours on each side; the first and last frame never are."""
    w = Window.partitionBy(*keys).orderBy(order)
    best = F.max if kind == "max" else F.min
    before, after = best(col).over(w.rowsBetween(-reach, -1)), best(col).over(w.rowsBetween(1, reach))
    ok = (F.col(col) > F.col("_before")) & (F.col(col) > F.col("_after")) if kind == "max" else (F.col(col) < F.col("_before")) & (F.col(col) < F.col("_after"))
    return rows.withColumns({"_before": before, "_after": after}).where(ok).drop("_before", "_after")


def change_rate(rows: DataFrame, col: str, keys: Keys, order: str, size: int) -> DataFrame:
    """Adds change: the absolute step from the frame before (0 for the first), smoothed, over its largest value in the timeline."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = rows.withColumn("_step", F.coalesce(F.abs(F.col(col) - F.lag(col).over(w)), F.lit(0.0)))
    smooth = step.withColumn("_smooth", moving_average("_step", keys, order, size))
    most = F.max("_smooth").over(Window.partitionBy(*keys))
    return smooth.withColumn("change", F.when(most > 0, F.col("_smooth") / most).otherwise(0.0)).drop("_step", "_smooth")


def mask_to_intervals(rows: DataFrame, flag: Column, keys: Keys, order: str) -> DataFrame:
    """Runs of frames where the flag holds: first and last frame, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_on", flag)
    runs = islands(marked, keys, [order], F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)))
    return runs.where("_on").groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("island")


def eroded(flag: str, keys: Keys, order: str, size: int) -> Column:
    return F.min(F.col(flag).cast("int")).over(centred(keys, order, size)) == 1


def dilated(flag: str, keys: Keys, order: str, size: int) -> Column:
    """Mirrors the window of `eroded`, so that the two undo each other's shift."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(size - 1 - size // 2), size // 2)
    return F.max(F.col(flag).cast("int")).over(w) == 1


def binary_open(rows: DataFrame, flag: str, keys: Keys, order: str, size: int) -> DataFrame:
    """Drops runs of the flag shorter than `size` frames."""
    return rows.withColumn(flag, eroded(flag, keys, order, size)).withColumn(flag, dilated(flag, keys, order, size))


def binary_close(rows: DataFrame, flag: str, keys: Keys, order: str, size: int) -> DataFrame:
    """Fills holes of the flag shorter than `size` frames."""
    return rows.withColumn(flag, dilated(flag, keys, order, size)).withColumn(flag, eroded(flag, keys, order, size))


def time_sessions(rows: DataFrame, keys: Keys, time: str, gap: float) -> DataFrame:
    """Stretches of frames not more than the gap apart: start_s, end_s, n. The stream's reading is `streaming.live.session_regions`."""
    w = Window.partitionBy(*keys).orderBy(time)
    runs = islands(rows.withColumn("_gap", F.col(time) - F.lag(time).over(w)), keys, [time], F.coalesce(F.col("_gap") > gap, F.lit(True)))
    return runs.groupBy(*keys, "island").agg(F.min(time).alias("start_s"), F.max(time).alias("end_s"), F.count("*").alias("n")).drop("island")


#: frames darker or brighter than this aren't compared with others
DARK, BRIGHT = 10.0, 250.0


def _runs(rows: DataFrame, keys: Keys, time: str, change: str, brightness: str, below: float, still_gap: int, dark_gap: int | None) -> DataFrame:
    """Runs of still frames: keys, start_s, broken_s (the frame that ends the run; null if none does), dark (whether that is a dark or bright one).

    Frames that change break a run when more than `still_gap` of them (and of dark or bright ones) came since its last still frame; dark or bright ones at once, or where `dark_gap` is given when more
    than that many came. A frame without a change, as the first and one after a frame that isn't compared, is neither.
    """
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    usable = F.col(brightness).between(DARK, BRIGHT)
    still, moving = usable & (F.col(change) < below), usable & (F.col(change) >= below)
    rows = rows.withColumns({"_still": F.coalesce(still, F.lit(False)), "_move": F.coalesce(moving, F.lit(False)), "_dark": ~usable})
    rows = rows.withColumn("_n", F.sum((F.col("_move") | F.col("_dark")).cast("int")).over(w))
    since = F.col("_n") - F.coalesce(F.last(F.when(F.col("_still"), F.col("_n")), ignorenulls=True).over(w), F.lit(0))
    rows = rows.withColumn("_since", since)
    broken = F.col("_move") & (F.col("_since") > still_gap) | F.col("_dark") & (F.col("_since") > (0 if dark_gap is None else dark_gap))
    rows = rows.withColumn("_break", broken).withColumn("_run", F.sum(F.col("_break").cast("int")).over(w) - F.col("_break").cast("int"))
    kept = rows.where("_still or _break").groupBy(*keys, "_run").agg(F.min(F.when(F.col("_still"), F.col(time))).alias("start_s"), F.min(F.when(F.col("_break"), F.struct(F.col(time).alias("t"), F.col("_dark").alias("dark")))).alias("_end"))
    return kept.where("start_s is not null").select(*keys, "start_s", F.col("_end.t").alias("broken_s"), F.col("_end.dark").alias("dark"))


def static_candidates(rows: DataFrame, totals: DataFrame, keys: Keys, time: str, change: str, brightness: str, below: float = 8.0, gap: int = 1, min_len: float = 2.0, expand: float = 6.0, merge: float = 10.0) -> DataFrame:
    """Coarse stage: stretches around runs of still frames of a timeline (total_s): start_s, end_s, n.

    Twice the gap is tolerated, in frames, and taken off a run's length in seconds; a run that meets a dark or bright frame goes. Stretches are wider by `expand` on both sides,
    within the timeline, and those up to `merge` apart are one.
    """
    found = _runs(rows, keys, time, change, brightness, below, 2 * gap, None).join(totals.select(*keys, "total_s"), list(keys))
    ended = F.coalesce(F.col("broken_s") - 2 * gap, F.col("total_s"))
    long_enough = found.where(~F.coalesce("dark", F.lit(False)) & (ended - F.col("start_s") >= min_len))
    wide = long_enough.select(*keys, F.greatest(F.lit(0.0), F.col("start_s") - expand).alias("start_s"), F.least(F.col("total_s"), F.coalesce(F.col("broken_s") + expand, F.col("total_s"))).alias("end_s"))
    return merge_intervals(wide, keys, merge)


def static_runs(rows: DataFrame, totals: DataFrame, keys: Keys, time: str, change: str, brightness: str, below: float = 8.0, gap: int = 1, min_len: float = 2.0) -> DataFrame:
    """Fine stage: runs of still frames of a region or timeline (total_s is where it ends): start_s, size_s.

    Up to `gap` frames in a row that change are tolerated, and of dark or bright frames among them twice as many; the gap is taken off the length of a run that was broken.
    """
    found = _runs(rows, keys, time, change, brightness, below, gap, 2 * gap).join(totals.select(*keys, "total_s"), list(keys))
    size = F.coalesce(F.col("broken_s") - gap, F.col("total_s")) - F.col("start_s")
    return found.select(*keys, "start_s", size.alias("size_s")).where(F.col("size_s") >= min_len)


#: percentiles of the active frames
SHARES = (10, 25, 50, 75, 90, 95)


def frame_statistics(rows: DataFrame, columns: list[str], keys: Keys, energy: str = "rms", fewest: int = 10) -> DataFrame:
    """Mean, deviation and percentiles of each column over the active frames: those whose energy is above its 5th percentile if there are more than `fewest`, else all."""
    floor = rows.groupBy(*keys).agg(F.percentile(energy, F.lit(0.05)).alias("_p5"))
    marked = rows.join(floor, list(keys)).withColumn("_on", F.col(energy) > F.col("_p5"))
    some = marked.groupBy(*keys).agg((F.count_if("_on") <= fewest).alias("_all"))
    active = marked.join(some, list(keys)).where("_all or _on")
    each = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), *(F.percentile(c, F.lit(p / 100)).alias(f"{c}_p{p}") for p in SHARES))]
    return active.groupBy(*keys).agg(F.count("*").alias("n"), *each)


def song_statistics(rows: DataFrame, col: str, keys: Keys, order: str, size: int) -> DataFrame:
    """Of the smoothed series: mean, median, upper quantiles, and stability 1 / (1 + deviation / mean)."""
    smooth = rows.withColumn("_s", moving_average(col, keys, order, size))
    return smooth.groupBy(*keys).agg(F.avg("_s").alias("mean"), *(F.percentile("_s", F.lit(p / 100)).alias(f"p{p}") for p in (50, 75, 85)), (1 / (1 + F.stddev_pop("_s") / F.nullif(F.avg("_s"), F.lit(0.0)))).alias("stability"))


def interval_stability(rows: DataFrame, keys: Keys, time: str) -> DataFrame:
    """1 - deviation / mean of the gaps between events, in [0, 1]; 0.5 with three events or fewer."""
    w = Window.partitionBy(*keys).orderBy(time)
    gaps = rows.withColumn("_gap", F.col(time) - F.lag(time).over(w)).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_gap").alias("_m"), F.stddev_pop("_gap").alias("_d"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_d") / F.col("_m")))
    return gaps.select(*keys, "n", F.when((F.col("n") <= 3) | (F.col("_m") <= 0), 0.5).otherwise(value).alias("stability"))


def voice_ratio(rows: DataFrame, col: str, keys: Keys, part: str, share: float = 0.2) -> DataFrame:
    """The share of frames of each part above a percentile of the whole timeline."""
    floor = rows.groupBy(*keys).agg(F.percentile(col, F.lit(share)).alias("_p"))
    return rows.join(floor, list(keys)).groupBy(*keys, part).agg(F.avg((F.col(col) > F.col("_p")).cast("double")).alias("voice_ratio"))


def signal_diagnostics(rows: DataFrame, col: str, keys: Keys, time: str, silence: float) -> DataFrame:
    """Duration, peak and mean level in dB, the share of silent samples, and whether there is a signal at all."""
    level = lambda x: 20 * F.log10(F.greatest(x, F.lit(1e-9)))
    share = F.avg((F.abs(col) < silence).cast("double"))
    return rows.groupBy(*keys).agg((F.max(time) - F.min(time)).alias("duration_s"), level(F.max(F.abs(col))).alias("peak_db"), level(F.avg(F.abs(col))).alias("mean_db"), share.alias("silent_share"), (F.max(F.abs(col)) > silence).alias("valid"))


def cosine(a: Column, b: Column) -> Column:
    """0 for null vectors, other sizes or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.transform(v, lambda x: x / F.nullif(norm, F.lit(0.0)))


def by_dimension(rows: DataFrame, vector: str) -> DataFrame:
    """A row for each dimension (dim, x) instead of the vector."""
    return rows.select(*(c for c in rows.columns if c != vector), F.posexplode(vector).alias("dim", "x"))


def before_after_distance(rows: DataFrame, vector: str, keys: Keys, order: str, size: int) -> DataFrame:
    """The distance of the mean vectors of `size` frames before and from a frame; 0 where either side is short."""
    w = Window.partitionBy(*keys, "dim").orderBy(order)
    before, after = w.rowsBetween(-size, -1), w.rowsBetween(0, size - 1)
    step = by_dimension(rows.select(*keys, order, vector), vector).withColumns({"_d": F.avg("x").over(before) - F.avg("x").over(after), "_full": (F.count("x").over(before) == size) & (F.count("x").over(after) == size)})
    return step.groupBy(*keys, order).agg(F.when(F.first("_full"), F.sqrt(F.sum(F.col("_d") * F.col("_d")))).otherwise(0.0).alias("distance"))


def similarity_drop(rows: DataFrame, vector: str, keys: Keys, order: str, size: int, threshold: float = 0.4) -> DataFrame:
    """The cosine of the mean vectors before and from a frame, and by how much it is under its own recent mean: adds similarity, drop, and whether it scores."""
    w = Window.partitionBy(*keys, "dim").orderBy(order)
    sides = by_dimension(rows.select(*keys, order, vector), vector).withColumns({"_a": F.avg("x").over(w.rowsBetween(-size, -1)), "_b": F.avg("x").over(w.rowsBetween(0, size - 1))})
    similar = sides.groupBy(*keys, order).agg((F.sum(F.col("_a") * F.col("_b")) / F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b")))).alias("similarity"))
    recent = F.avg("similarity").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-size, -1))
    return similar.withColumn("drop", F.coalesce(recent - F.col("similarity"), F.lit(0.0))).withColumn("scores", F.col("drop") > threshold)


def local_self_similarity(rows: DataFrame, vector: str, keys: Keys, order: str, reach: int) -> DataFrame:
    """The mean cosine of a frame with the frames around it (itself included), from [-1, 1] to [0, 1]: a product with the window's mean unit vector."""
    dims = by_dimension(rows.select(*keys, order, unit(F.col(vector)).alias("u")), "u")
    w = Window.partitionBy(*keys, "dim").orderBy(order).rowsBetween(-reach, reach)
    return dims.withColumn("_m", F.avg("x").over(w)).groupBy(*keys, order).agg(((F.sum(F.col("x") * F.col("_m")) + 1) / 2).alias("similarity"))


def distribution_entropy(vector: Column, least: float = 0.01) -> Column:
    """Entropy in bits of the vector's absolute values as shares, ignoring those up to `least`."""
    total = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.abs(x))
    shares = F.filter(F.transform(vector, lambda x: F.abs(x) / F.nullif(total, F.lit(0.0))), lambda p: p > least)
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def edge_signature(rows: DataFrame, vector: str, keys: Keys, order: str, size: int, fewest: int = 2, tail: bool = False) -> DataFrame:
    """The mean vector of the first (or last) `size` frames of each timeline, of length one; null with fewer than `fewest` frames."""
    first = rows.withColumn("_nr", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order) if tail else F.asc(order)))).where(F.col("_nr") <= size)
    means = by_dimension(first.select(*keys, vector), vector).groupBy(*keys, "dim").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    whole = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("v"), F.first("n").alias("n"))
    return whole.select(*keys, F.when(F.col("n") >= fewest, unit(F.col("v"))).alias("signature"))


def pairwise_similarity(rows: DataFrame, vector: str, group: str, ident: str, threshold: float = 0.85, block: int = 2048) -> DataFrame:
    """Of each vector the number of others in its group with a cosine above the threshold, and its mean cosine with them.

    The mean needs no pairs: it is the product with the group's sum of unit vectors. The count compares all pairs, as matrix products of two
    blocks of about `block` vectors at a time, so that no pair is ever a row and no task holds a group. Vectors without length are like none.
    """
    units = rows.select(group, ident, unit(F.col(vector)).alias("u"))
    blocks = units.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = units.where("u[0] is not null").join(blocks, group).withColumn("_b", F.pmod(F.xxhash64(ident), F.col("_n")).cast("int"))
    pairs = dealt.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = pairs.withColumns({"_x": F.least("_b", "_c"), "_y": F.greatest("_b", "_c")})
    ids = rows.schema[ident].dataType.simpleString()

    def counted(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        first = (some["_b"] == key[1]).to_numpy()
        a, b = (np.array(some.loc[x, "u"].tolist()) for x in (first, ~first if key[1] != key[2] else first))
        if not len(a) or not len(b):
            return pd.DataFrame({group: [], ident: [], "_k": []})
        close = a @ b.T > threshold
        if key[1] == key[2]:
            np.fill_diagonal(close, False)
            return pd.DataFrame({group: key[0], ident: some.loc[first, ident], "_k": close.sum(1)})
        return pd.DataFrame({group: key[0], ident: pd.concat([some.loc[first, ident], some.loc[~first, ident]]), "_k": np.concatenate([close.sum(1), close.sum(0)])})

    schema = f"{group} {rows.schema[group].dataType.simpleString()}, {ident} {ids}, _k long"
    counts = met.groupBy(group, "_x", "_y").applyInPandas(counted, schema).groupBy(group, ident).agg(F.sum("_k").alias("repeat_count"))
    sums = by_dimension(units, "u").groupBy(group, "dim").agg(F.sum("x").alias("_t"), F.count("*").alias("_n"))
    means = by_dimension(units, "u").join(sums, [group, "dim"]).groupBy(group, ident).agg(((F.sum(F.col("x") * F.col("_t")) - 1) / F.nullif(F.first("_n") - 1, F.lit(0))).alias("avg_similarity"))
    return means.join(counts, [group, ident], "left").withColumn("repeat_count", F.coalesce("repeat_count", F.lit(0)))


def combine_window_logits(windows: DataFrame, keys: Keys, frame: str, logits: str, boundary: str) -> DataFrame:
    """The mean of overlapping windows' outputs for each frame: the best class, its number from 0, its probability, and the probability of a boundary."""
    means = by_dimension(windows.select(*keys, frame, logits), logits).groupBy(*keys, frame, "dim").agg(F.avg("x").alias("m"))
    best = means.groupBy(*keys, frame).agg(F.max_by("dim", F.struct("m", -F.col("dim"))).alias("class"), F.max("m").alias("_top"), F.array_sort(F.collect_list("m")).alias("_all"))
    total = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top")))
    edges = windows.groupBy(*keys, frame).agg((1 / (1 + F.exp(-F.avg(boundary)))).alias("boundary"))
    return best.select(*keys, frame, "class", (1 / total).alias("probability")).join(edges, [*keys, frame])


def segment_confidence(frames: DataFrame, segment: Keys) -> DataFrame:
    """Of each segment's frames (probability, boundary) the mean boundary probability times the mean probability of the best class."""
    return frames.groupBy(*segment).agg((F.avg("boundary") * F.avg("probability")).alias("confidence"))


def top_classes(frames: DataFrame, keys: Keys, frame: str, size: int, k: int = 3) -> DataFrame:
    """The k commonest classes of each stretch of `size` frames; of equally common ones the smaller number: bucket, class, n, nr."""
    counts = frames.groupBy(*keys, F.floor(F.col(frame) / size).alias("bucket"), "class").agg(F.count("*").alias("n"))
    nr = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(F.desc("n"), "class")).cast("long")
    return counts.withColumn("nr", nr).where(F.col("nr") <= k)


def segment_features(frames: DataFrame, segments: DataFrame, keys: Keys, segment_id: str, time: str, order: str, energy: str, centroid: str, likelihood: str, silent: float) -> DataFrame:
    """Of the frames in each segment: energy and centroid by mean, deviation, relation to the timeline's mean and (centroid) first-to-last change, the share of
    silence, the energy's variance, and the mean likelihood of a repeat. Of frames at one time the first by `order` counts at either end."""
    whole = frames.groupBy(*keys).agg(F.avg(energy).alias("_e"), F.avg(centroid).alias("_c"))
    held = in_buckets(segments.select(*keys, segment_id, "start_s", "end_s"), "start_s", "end_s")
    timed = frames.select(*keys, time, order, energy, centroid, likelihood, F.floor(F.col(time) / BUCKET_S).alias("_bucket"))
    inside = held.join(timed, [*keys, "_bucket"]).where((F.col(time) >= F.col("start_s")) & (F.col(time) < F.col("end_s")))
    found = inside.groupBy(*keys, segment_id).agg(
        F.avg(energy).alias("energy"), F.stddev_pop(energy).alias("deviation"), F.var_pop(energy).alias("variance"), F.avg((F.col(energy) < silent).cast("double")).alias("silence_ratio"),
        F.avg(centroid).alias("centroid"), F.stddev_pop(centroid).alias("centroid_std"), (F.max_by(centroid, F.struct(time, -F.col(order))) - F.min_by(centroid, F.struct(time, order))).alias("centroid_gradient"), F.avg(likelihood).alias("repeat_likelihood"),
    )
    both = found.join(whole, list(keys))
    return both.withColumns({"relative_energy": F.col("energy") / F.nullif("_e", F.lit(0.0)), "centroid_relative": F.col("centroid") / F.nullif("_c", F.lit(0.0))}).drop("_e", "_c")


def strong_peaks_apart(peaks: DataFrame, groups: DataFrame, keys: Keys, time: str, score: str, tolerance: float = 3.0, share: float = 0.85) -> DataFrame:
    """Peaks of at least the share-quantile of their timeline's scores that no group (t) is within the tolerance of: the second tier of `agreeing_signals`."""
    floor = peaks.groupBy(*keys).agg(F.percentile(score, F.lit(share)).alias("_p"))
    strong = peaks.join(floor, list(keys)).where(F.col(score) >= F.col("_p")).drop("_p")
    around = groups.select(*keys, (F.col("t") - tolerance).alias("start_s"), (F.col("t") + tolerance).alias("end_s"))
    points = strong.select(*keys, time, F.col(time).alias("start_s"), F.col(time).alias("end_s"))
    near = overlap_join(points, around, keys, eps=-1e-9).select(*keys, time).distinct()
    return strong.join(near, [*keys, time], "left_anti")


# The weight of each sign of a boundary.
SIGNS = {"applause_low": 3.0, "chroma": 2.0, "mfcc": 2.5, "centroid": 1.8, "beat": 1.2, "crowd": 2.0, "key_drop": 3.0, "valley": 0.8}


def boundary_score_curve(rows: DataFrame, keys: Keys, signs: dict[str, float] | None = None) -> DataFrame:
    """Adds score: the weighted sum of the signs (a column each, 0 and more), each over its largest value in the timeline."""
    signs = signs or SIGNS
    most = rows.groupBy(*keys).agg(*(F.max(c).alias(f"_{c}") for c in signs))
    parts = [F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}") * w).otherwise(0.0) for c, w in signs.items()]
    return rows.join(most, list(keys)).withColumn("score", sum(parts[1:], parts[0])).drop(*(f"_{c}" for c in signs))


def applause_mask(rows: DataFrame, keys: Keys, order: str, size: int) -> DataFrame:
    """Adds flag: frames (rms, zcr, flatness, pitch) like noise with energy, without runs shorter than `size` and holes shorter than twice that."""
    bounds = {"zcr": 0.6, "flatness": 0.5, "pitch": 0.6, "rms": 0.15}
    q = rows.groupBy(*keys).agg(*(F.percentile(c, F.lit(p)).alias(f"_{c}") for c, p in bounds.items()))
    noisy = (F.col("zcr") > F.col("_zcr")) & (F.col("flatness") > F.col("_flatness")) & (F.col("pitch") < F.col("_pitch")) & (F.col("rms") > F.col("_rms"))
    marked = rows.join(q, list(keys)).withColumn("flag", noisy).drop(*(f"_{c}" for c in bounds))
    return binary_close(binary_open(marked, "flag", keys, order, size), "flag", keys, order, 2 * size)


def voice_mask(rows: DataFrame, keys: Keys) -> DataFrame:
    """Adds flag: frames (rms, zcr, centroid) of some energy with a voice's rate of zero crossings and centroid."""
    q = rows.groupBy(*keys).agg(F.percentile("rms", F.lit(0.2)).alias("_p"))
    voice = (F.col("rms") > F.col("_p")) & (F.col("zcr") > 0.02) & (F.col("zcr") < 0.20) & (F.col("centroid") > 300) & (F.col("centroid") < 4000)
    return rows.join(q, list(keys)).withColumn("flag", voice).drop("_p")


def vocal_share(vocal: Column, full: Column) -> Column:
    """The voice ratio where voices were separated: their energy (null where there are none) over that of everything, at most 1; 1 in silence."""
    # least skips nulls, so that none may reach it; NaN is more than 1
    return F.least(F.lit(1.0), share_of(F.coalesce(vocal, F.lit(0.0)), full))


def agreeing_signals(points: DataFrame, keys: Keys, time: str, signal: str, tolerance: float = 3.0, fewest: int = 2) -> DataFrame:
    """Groups of points not more than the tolerance apart that at least `fewest` different signals back: mean time and number of signals."""
    w = Window.partitionBy(*keys).orderBy(time, signal)
    runs = islands(points.withColumn("_gap", F.col(time) - F.lag(time).over(w)), keys, [time, signal], F.coalesce(F.col("_gap") > tolerance, F.lit(True)))
    found = runs.groupBy(*keys, "island").agg(F.avg(time).alias("t"), F.countDistinct(signal).alias("n_signals")).drop("island")
    return found.where(F.col("n_signals") >= fewest)


def intervals_to_mask(intervals: DataFrame, keys: Keys, hop: float) -> DataFrame:
    """The numbers of the hops that an interval touches."""
    frames = F.explode(F.sequence(F.floor(F.col("start_s") / hop), F.ceil(F.col("end_s") / hop) - 1))
    return intervals.where("end_s > start_s").select(*keys, frames.alias("hop")).distinct()
