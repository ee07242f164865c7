"""Classification in order, where a segment's label depends on the one before it.

A segment is a map from the state before it to the state after it. Maps compose in any grouping, so segments are cut into chunks: each chunk's maps make one, the
chunks' maps in order give every chunk's first state, and from there each chunk is walked on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.classify import STATES, candidates
from cuesheet.operators.intervals import Keys


def _state(label: Column) -> Column:
    found = F.lit(0)
    for i, name in enumerate(STATES):
        if name:
            found = F.when(label == name, i).otherwise(found)
    return found


def scanned(rows: DataFrame, keys: Keys, order: str, after: str, chunk: int = 256) -> DataFrame:
    """Rows (keys, order, label, confidence): of each row's decisions in `after` the one for the state that the row before leaves; before the first it is state 0."""
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    maps = rows.select(*keys, F.col(order).alias("_o"), nr.cast("long").alias("_nr"), F.col(after).alias("_after"))
    maps = maps.withColumns({"_c": F.floor(F.col("_nr") / chunk), "_to": F.transform("_after", lambda x: _state(x["label"]))})
    chunks = maps.groupBy(*keys, "_c").agg(F.array_sort(F.collect_list(F.struct("_nr", "_o", "_after", "_to"))).alias("items"))
    same = F.array(*map(F.lit, range(len(STATES))))
    whole = chunks.select(*keys, "_c", F.aggregate("items", same, lambda acc, x: F.transform(acc, lambda s: F.element_at(x["_to"], s + 1))).alias("_map"))
    ordered = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_c", "_map"))).alias("maps"))  # one for each chunk
    first = F.aggregate("maps", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(x["_map"], F.element_at(acc, -1) + 1))))
    starts = ordered.select(*keys, F.posexplode(first).alias("_c", "_s")).withColumn("_c", F.col("_c").cast("long"))
    states = F.aggregate("items", F.array("_s"), lambda acc, x: F.concat(acc, F.array(F.element_at(x["_to"], F.element_at(acc, -1) + 1))))
    walked = chunks.join(starts, [*keys, "_c"]).withColumn("_states", F.slice(states, F.lit(1), F.size("items")))
    each = walked.select(*keys, F.explode(F.arrays_zip("items", "_states")).alias("x"))
    found = F.element_at(F.col("x.items._after"), F.col("x._states") + 1)
    return each.select(*keys, F.col("x.items._o").alias(order), found["label"].alias("label"), found["confidence"].alias("confidence"))


def classify_in_order(rows: DataFrame, keys: Keys, order: str, chunk: int = 256) -> DataFrame:
    """Segments of a timeline, in order, with label and confidence (for music), by all rules: keys, order, label, confidence."""
    return scanned(candidates(rows), keys, order, "after", chunk)
