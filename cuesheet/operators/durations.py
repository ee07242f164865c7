"""Legal lengths for segments: long ones split, short ones joined with a neighbour or dropped.

Whether a short segment joins depends on what became of those before it. Two neighbours can't change each other if both are long enough or if nothing before
ends near the second one's start; between such breaks stand the few segments of one repair, which are folded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.intervals import Keys, islands, split_range

#: seconds to a neighbour of the same type, and of any type; the share of the least length that a joined segment needs; rounding
SAME_GAP, ANY_GAP, SHARE, EPS = 2.0, 2.5, 0.8, 1e-6


def enforce_durations(segments: DataFrame, keys: Keys, ident: str, shortest: float, longest: float) -> DataFrame:
    """Segments (type, is_highlight) of `shortest` to `longest` seconds: start_s, end_s, type, is_highlight.

    Long ones are split evenly. Then, in order of start, one that is too short joins the one before it, if of its type and within 2 s, or else the one after on the same terms;
    where that doesn't come about, one of any type within 2.5 s, first the one before, if what is joined is at most `longest` and not far under `shortest`; else it is dropped. A joined
    segment is a highlight if either was. At last what is still long is split again, and what is short left out.
    """
    rows = split_range(segments.select(*keys, ident, "type", F.coalesce("is_highlight", F.lit(False)).alias("is_highlight"), "start_s", "end_s"), shortest, longest)
    order = ["start_s", "end_s", "type", ident, "part"]
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_short", F.col("end_s") - F.col("start_s") < shortest - EPS)
    rows = rows.withColumns({"_before": F.lag("_short").over(w), "_reach": F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    apart = F.col("_before").isNull() | (~F.col("_short") & ~F.col("_before")) | (F.col("start_s") - F.col("_reach") > ANY_GAP)
    rows = islands(rows, keys, order, apart)
    repaired = rows.groupBy(*keys, "island").agg(F.max("_short").alias("_any"), F.array_sort(F.collect_list(F.struct(*order, "is_highlight"))).alias("items"))
    none = F.array().cast("array<struct<start_s: double, end_s: double, type: string, is_highlight: boolean>>")
    start = F.struct(none.alias("out"), F.lit(None).cast("double").alias("start"), F.lit(False).alias("high"))

    def step(acc: Column, item: Column) -> Column:
        x, after = item["x"], item["y"]
        first, high = F.coalesce(F.least(acc["start"], x["start_s"]), x["start_s"]), acc["high"] | x["is_highlight"]
        last = F.try_element_at(acc["out"], F.lit(-1))
        own = F.struct(first.alias("start_s"), x["end_s"].alias("end_s"), x["type"].alias("type"), high.alias("is_highlight"))
        with_last, with_next = x["end_s"] - last["start_s"], after["end_s"] - first
        fits = lambda size: (size <= longest + EPS) & ((size >= shortest * SHARE) | (size <= 0))
        like_last = F.coalesce((last["type"] == x["type"]) & (first - last["end_s"] <= SAME_GAP), F.lit(False))
        like_next = F.coalesce(~like_last & (after["type"] == x["type"]) & (after["start_s"] - x["end_s"] <= SAME_GAP), F.lit(False))
        same_last, same_next = like_last & (with_last <= longest + EPS), like_next & (with_next <= longest + EPS)
        any_last = F.coalesce((first - last["end_s"] <= ANY_GAP) & fits(with_last), F.lit(False))
        any_next = F.coalesce((after["start_s"] - x["end_s"] <= ANY_GAP) & fits(with_next), F.lit(False))
        to_last = same_last | (~same_next & any_last)
        grown = F.struct(last["start_s"].alias("start_s"), F.greatest(last["end_s"], x["end_s"]).alias("end_s"), last["type"].alias("type"), (last["is_highlight"] | high).alias("is_highlight"))
        state = lambda out, begin=F.lit(None).cast("double"), lit=F.lit(False): F.struct(out.alias("out"), begin.alias("start"), lit.alias("high"))
        long_enough = x["end_s"] - first >= shortest - EPS
        kept, joined = F.concat(acc["out"], F.array(own)), F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(grown))
        return F.when(long_enough, state(kept)).when(to_last, state(joined)).when(same_next | any_next, state(acc["out"], first, high)).otherwise(state(acc["out"]))

    pairs = F.transform("items", lambda x, i: F.struct(x.alias("x"), F.try_element_at("items", i + 2).alias("y")))
    out = F.when(F.col("_any"), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.transform("items", lambda x: F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("end_s"), x["type"].alias("type"), x["is_highlight"].alias("is_highlight"))))
    again = split_range(repaired.select(*keys, F.explode(out).alias("s")).select(*keys, "s.*"), shortest, longest)
    return again.where(F.col("end_s") - F.col("start_s") >= shortest - EPS).select(*keys, "start_s", "end_s", "type", "is_highlight")
