"""As-of joins: each point meets the reference before, after or nearest to it.

Both sides are put under one another and read by windows over the key, so that an as-of join is one shuffle and linear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.text import estimated_line_seconds
from cuesheet.operators.intervals import Keys, to_millis


def with_neighbours(points: DataFrame, refs: DataFrame, keys: Keys, strict: bool = False) -> DataFrame:
    """Points (columns and t) with _before and _after, the times of refs (column t) around them; strict leaves out equal times."""
    names = [c for c in points.columns if c not in keys and c != "t"]
    rows = points.select(*keys, "t", F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast("double").alias("_ref"))
    some = refs.select(*keys, F.col("t").alias("t"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col("t").alias("_ref"))
    both = rows.unionByName(some.withColumn("_side", F.lit(2 if strict else 0)))
    # references at a point's own time come before it either way, or after it if they are left out
    forward = Window.partitionBy(*keys).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(*keys).orderBy(F.desc("t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"_before": F.last("_ref", ignorenulls=True).over(forward), "_after": F.last("_ref", ignorenulls=True).over(backward)})
    return near.where("_side = 1").select(*keys, "t", "_row.*", "_before", "_after")


def asof_nearest(points: DataFrame, refs: DataFrame, keys: Keys, farthest: float, force: bool = False, digits: int | None = None) -> DataFrame:
    """Adds snapped_t: the nearest reference within `farthest` (any, if forced), else the point; of equally near ones (to so many digits, if given) the earlier."""
    near = with_neighbours(points, refs, keys)
    far = lambda x: x if digits is None else F.round(x, digits)
    nearest = F.when(F.col("_after").isNull() | (far(F.col("t") - F.col("_before")) <= far(F.col("_after") - F.col("t"))), F.col("_before")).otherwise(F.col("_after"))
    found = near.withColumn("_near", nearest)
    usable = F.col("_near").isNotNull() & (F.lit(force) | (F.abs(F.col("_near") - F.col("t")) <= farthest))
    return found.withColumn("snapped_t", F.when(usable, F.col("_near")).otherwise(F.col("t"))).drop("_near", "_before", "_after")


def asof_backward(points: DataFrame, refs: DataFrame, keys: Keys, tolerance: float) -> DataFrame:
    """Adds ref_t: the latest reference at or before the point, within the tolerance."""
    near = with_neighbours(points, refs, keys)
    return near.withColumn("ref_t", F.when(F.col("t") - F.col("_before") <= tolerance, F.col("_before"))).drop("_before", "_after")


def asof_forward(points: DataFrame, refs: DataFrame, keys: Keys) -> DataFrame:
    """Adds ref_t: the earliest reference after the point."""
    near = with_neighbours(points, refs, keys, strict=True)
    return near.withColumnRenamed("_after", "ref_t").drop("_before")


def lookup_with_tolerance(points: DataFrame, scores: DataFrame, keys: Keys, tolerance: float = 0.6) -> DataFrame:
    """Adds score: that of the time (to one decimal) equal to the point's, else of the nearest within the tolerance, else 0."""
    one = lambda x: F.round(x + 1e-9, 1)
    known = scores.groupBy(*keys, one(F.col("t")).alias("t")).agg(F.max("score").alias("score"))
    near = asof_nearest(points.withColumn("_t", F.col("t")).withColumn("t", one(F.col("t"))), known, keys, tolerance + 1e-9, digits=6)
    found = near.join(known.select(*keys, F.col("t").alias("snapped_t"), "score"), [*keys, "snapped_t"], "left")
    return found.withColumn("t", F.col("_t")).withColumn("score", F.coalesce("score", F.lit(0.0))).drop("_t", "snapped_t")


def next_non_null_start(lines: DataFrame, keys: Keys, order: Keys, duration: float, shortest: float = 0.8) -> DataFrame:
    """Adds end_s to timed lines (t): the next timed line's start, else the duration, but at least so long; untimed lines go."""
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    end = F.coalesce(F.first("t", ignorenulls=True).over(after), F.lit(duration))
    return lines.withColumn("end_s", F.greatest(end, F.col("t") + shortest)).where(F.col("t").isNotNull())


#: fixed values: the share of the prediction in a blend, the least length of a line and its distance from the next anchor, the shift of songs without anchors, and confidences
BLEND, LEAST_S, APART_S, NO_ANCHOR_S = 0.55, 0.35, 0.05, 13.0
ALONE, NO_ANCHORS, SHARE, LOWEST, HIGHEST = 0.32, 0.25, 0.7, 0.26, 0.62


def fill_between_anchors(lines: DataFrame, keys: Keys, order: str, scale: float = 1.0, offset: float = NO_ANCHOR_S, spacing: float = 4.0) -> DataFrame:
    """Lines (t, text, start_s, end_s, confidence, status) of which every one has a time: those that aren't confirmed are placed by the anchors around them.

    Anchors are confirmed lines with a start and a lyric time t. A line's time is interpolated between the anchors before and after it, or runs on from the only one at the pace `scale`, or
    is its lyric time plus `offset` where there is none; a start that it has counts for 0.45. It ends after its estimated length, but before the next anchor.
    Its confidence is 0.7 of the mean confidence of the anchors up to two lines away, within bounds. A line without lyric time has one between its timed neighbours', in proportion to `order`,
    or `spacing` seconds a line from them. Adds time_source.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    past, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    timed = F.when(F.col("t").isNotNull(), F.struct(F.col(order).alias("o"), F.col("t").alias("t")))
    rows = lines.withColumns({"_p": F.last(timed, ignorenulls=True).over(past), "_n": F.first(timed, ignorenulls=True).over(ahead)})
    p, n, at = F.col("_p"), F.col("_n"), F.col(order)
    between = F.when(p["o"] == n["o"], p["t"]).otherwise(p["t"] + (n["t"] - p["t"]) * (at - p["o"]) / (n["o"] - p["o"]))
    own = F.coalesce(between, p["t"] + spacing * (at - p["o"]), n["t"] - spacing * (n["o"] - at), at * spacing)
    rows = rows.withColumn("_t", own)
    anchor = F.when((F.col("status") == "confirmed") & F.col("start_s").isNotNull() & F.col("t").isNotNull(), F.struct(F.col("t").alias("own"), F.col("start_s").alias("placed"), F.col("confidence").alias("c")))
    rows = rows.withColumn("_anchor", anchor)
    later = by.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({"_a": F.last("_anchor", ignorenulls=True).over(past), "_b": F.first("_anchor", ignorenulls=True).over(ahead), "_next": F.first("_anchor", ignorenulls=True).over(later)["placed"], "_near": F.avg("_anchor.c").over(by.rangeBetween(-2, 2))})
    a, b, t = F.col("_a"), F.col("_b"), F.col("_t")
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - a["own"]) / (b["own"] - a["own"])))
    both = F.when(F.abs(b["own"] - a["own"]) > 1e-6, a["placed"] + ratio * (b["placed"] - a["placed"]))
    predicted = F.coalesce(both, a["placed"] + scale * (t - a["own"]), b["placed"] - scale * (b["own"] - t), t + offset)
    start = F.greatest(F.lit(0.0), F.coalesce(BLEND * predicted + (1 - BLEND) * F.col("start_s"), predicted))
    end = start + estimated_line_seconds(F.col("text"))
    end = F.when(F.col("_next").isNull(), end).otherwise(F.least(end, F.greatest(start + LEAST_S, F.col("_next") - APART_S)))
    sure = F.when(a.isNull() & b.isNull(), NO_ANCHORS).when(F.col("_near").isNull(), ALONE).otherwise(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), SHARE * F.col("_near"))))
    fixed = F.col("status") == "confirmed"
    placed = {"start_s": F.when(fixed, F.col("start_s")).otherwise(to_millis(start)), "end_s": F.when(fixed, F.col("end_s")).otherwise(to_millis(F.greatest(end, start + LEAST_S))), "confidence": F.when(fixed, F.col("confidence")).otherwise(F.round(sure + 1e-9, 4)), "status": F.when(fixed, F.col("status")).otherwise("interpolated"), "time_source": F.when(fixed, "anchor").otherwise("interp")}
    return rows.select(*(c for c in lines.columns if c not in placed), *(c.alias(k) for k, c in placed.items()))
