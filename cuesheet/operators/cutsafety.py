"""Cuts between clips that leave sung sentences whole, in steps over a whole catalogue.

A step's cuts are those of `cuts`, pair by pair; a pair depends on the one before it only by where its left clip begins. So what is sung around each pair is gathered once, and chains of pairs are
folded, long ones in chunks that are folded again where the chunk before has changed. Short clips are repaired in the few clips between neighbours that can't change each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.labels import type_priority
from cuesheet.operators.cuts import EQUAL, OVERLAP, adjacent_candidates, boundaries, boundary_cut, covered_gap_fills, overlap_cut, overlapping_neighbours, padded_candidates
from cuesheet.operators.intervals import Keys, islands, overlap_join, to_millis
from cuesheet.sources.archives import shared_table as _table

STEPS = ("part", "protect", "repair", "protect", "fill")
#: seconds of sung sentences that keep a clip that is too short
SUNG = 0.3
CLIP = "struct<start_s: double, end_s: double, type: string, is_highlight: boolean, song_index: int, ident: bigint>"


def chained_cuts(pairs: DataFrame, keys: Keys, order: str, cut: Callable[[Column, Column], Column], values: Sequence[str], size: int = 256, rounds: int = 1000) -> DataFrame:
    """(keys, order, next_id, cut): the cuts of pairs (neighbours, with nr of the left clip) in order, each with its left clip beginning where the pair before was cut.

    `cut` makes a pair's cut, or null, from a struct of its l_start, r_end and `values` and from where the left clip begins. A chain is folded in chunks of up to `size` pairs; chunks that go on a chain
    are folded again with the last cut of the chunk before, until that stays the same.
    """
    part = [*keys, "island"]
    goes_on = F.coalesce(F.lag("nr").over(Window.partitionBy(*keys).orderBy("nr")) == F.col("nr") - 1, F.lit(False))
    rows = islands(pairs.withColumn("_on", goes_on), keys, ["nr"], ~F.col("_on") | (F.col("nr") % size == 0))
    item = F.struct("nr", F.col(order).alias("ident"), "next_id", "l_start", "r_end", "_on", *values)
    chunks = rows.groupBy(*part).agg(F.sort_array(F.collect_list(item)).alias("_x")).withColumn("_on", F.col("_x")[0]["_on"])

    def folded(before: Column) -> Column:
        """The cut before the chunk and those of its pairs."""
        step = lambda acc, x: F.concat(acc, F.transform(F.array(F.coalesce(F.element_at(acc, -1), x["l_start"])), lambda at: cut(x, at)))
        return F.aggregate("_x", F.array(before.cast("double")), step)

    ids = F.transform("_x", lambda x: F.struct(x["ident"].alias(order), x["next_id"].alias("next_id")))
    chunks = _table(chunks.select(*part, "_on", F.when(F.col("_on"), F.col("_x")).alias("_x"), ids.alias("_ids"), folded(F.lit(None)).alias("_cuts")))
    later = chunks.where("_on")
    found = chunks.select(*part, "_ids", "_cuts")
    for _ in range(0 if later.isEmpty() else rounds):
        last = found.select(*keys, (F.col("island") + 1).alias("island"), F.element_at("_cuts", -1).alias("_last"))
        now = later.drop("_cuts").join(last, part).join(found.select(*part, F.col("_cuts")[0].alias("_was")), part).where(~F.col("_last").eqNullSafe(F.col("_was")))
        moved = _table(now.select(*part, "_ids", folded(F.col("_last")).alias("_cuts")))
        if moved.isEmpty():
            break
        found = _table(found.join(moved.select(*part), part, "left_anti").unionByName(moved))
    else:
        if not later.isEmpty():
            raise RuntimeError(f"cuts did not settle in {rounds} rounds")
    cuts = F.arrays_zip("_ids", F.slice("_cuts", F.lit(2), F.size("_ids")).alias("cut"))
    return found.select(*keys, F.explode(cuts).alias("x")).select(*keys, f"x._ids.{order}", "x._ids.next_id", "x.cut").where("cut is not null")


def _ordered(clips: DataFrame, keys: Keys, *order: str) -> DataFrame:
    return clips.withColumn("nr", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _moved(clips: DataFrame, cuts: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Clips with the ends and starts that cuts between them give."""
    ends, starts = cuts.select(*keys, order, F.col("cut").alias("_end")), cuts.select(*keys, F.col("next_id").alias(order), F.col("cut").alias("_start"))
    both = clips.join(ends, [*keys, order], "left").join(starts, [*keys, order], "left")
    return both.withColumns({"start_s": F.coalesce("_start", "start_s"), "end_s": F.coalesce("_end", "end_s")}).drop("_start", "_end")


def part_overlaps(clips: DataFrame, sentences: DataFrame, keys: Keys, order: str, shortest: float, longest: float) -> DataFrame:
    """Clips (nr) without overlaps: small ones, and those of two songs, go to the later clip, others are cut by `overlap_cut`."""
    w = Window.partitionBy(*keys).orderBy("nr")
    rows = clips.withColumns({"_next": F.lead("start_s").over(w), "_song": F.lead("song_index").over(w), "_id": F.lead(order).over(w)}).withColumn("_over", F.col("end_s") - F.col("_next"))
    own = chained_cuts(overlapping_neighbours(clips, sentences, keys, order, "nr"), keys, order, lambda x, at: overlap_cut(at, x["l_end"], x["r_start"], x["r_end"], x["said"], x["gaps"], shortest, longest), ["l_end", "r_start", "said", "gaps"])
    other = rows.where((F.col("_over") > OVERLAP) & (F.col("_song") != F.col("song_index"))).select(*keys, order, F.col("_id").alias("next_id"), to_millis(F.col("_next")).alias("cut"))
    small = (F.col("_over") > 0) & (F.col("_over") <= OVERLAP)
    closed = rows.withColumn("end_s", F.when(small, F.col("_next")).otherwise(F.col("end_s"))).select(*clips.columns)
    return _table(_moved(closed, own.unionByName(other), keys, order))


def protect_sentences(clips: DataFrame, sentences: DataFrame, words: DataFrame, keys: Keys, order: str, shortest: float, longest: float) -> DataFrame:
    """Clips (nr) whose shared boundaries lie in no sentence, as in `adjacent_cuts`, or a little past a sentence's end, as in `padded_cuts`."""
    pairs = _table(boundaries(clips, keys, order, "nr"))
    inside = adjacent_candidates(pairs, sentences, words, keys, order).withColumn("moves", F.abs(F.col("cut") - F.col("t")) > EQUAL)
    past = padded_candidates(pairs, sentences, keys, order).withColumn("moves", F.lit(True))
    places = inside.unionByName(past).groupBy(*keys, order).agg(F.collect_list(F.struct("cut", "cost", "moves")).alias("places"))
    cuts = chained_cuts(pairs.join(places, [*keys, order]), keys, order, lambda x, at: boundary_cut(at, x["r_end"], x["t"], x["places"], shortest, longest), ["t", "places"])
    return _table(_moved(clips, cuts, keys, order))


def repair_short(clips: DataFrame, sentences: DataFrame, keys: Keys, order: str, shortest: float, longest: float) -> DataFrame:
    """Clips that are too short borrow from a neighbour that can spare it, else join one of their kind, else stay if they are sung, else go; with nr.

    After each change the clip before is looked at again. Two neighbours that are long enough and overlap no clip stay so and never change each other, and nothing joins over more than `longest`: the clips between such
    places are one repair, with the sentences around them. A timeline's only clip stays.
    """
    rows = clips.where(F.col("end_s") - F.col("start_s") > EQUAL)
    w = Window.partitionBy(*keys).orderBy("start_s", "end_s", "nr")
    rows = rows.withColumns({"_short": shortest - (F.col("end_s") - F.col("start_s")) > EQUAL, "_all": F.count("*").over(Window.partitionBy(*keys))})
    rows = rows.withColumns({"_reach": F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.lead("start_s").over(w)})
    alone = F.coalesce(F.col("start_s") >= F.col("_reach"), F.lit(True)) & F.coalesce(F.col("_next") >= F.col("end_s"), F.lit(True))
    rows = rows.withColumn("_firm", ~F.col("_short") & alone).withColumn("_before", F.lag("_firm").over(w))
    apart = F.col("_before").isNull() | (F.col("_firm") & F.col("_before")) | (F.col("start_s") - F.col("_reach") > longest + EQUAL)
    rows = islands(rows, keys, ["start_s", "end_s", "nr"], apart)
    part = [*keys, "island"]
    item = F.struct("start_s", "end_s", "nr", "type", "is_highlight", "song_index", F.col(order).cast("long").alias("ident"))
    parts = rows.groupBy(*part).agg((F.max("_short") & (F.first("_all") > 1)).alias("_any"), F.array_sort(F.collect_list(item)).alias("_x"), F.min("start_s").alias("_a"), F.max("end_s").alias("_b"))
    clip = lambda x: F.struct(*(x[c].alias(c) for c in ("start_s", "end_s", "type", "is_highlight", "song_index", "ident")))
    parts = parts.withColumn("_x", F.transform("_x", clip))
    songs = rows.join(parts.where("_any").select(*part, "_a", "_b"), part).groupBy(*part, "song_index", "_a", "_b").count()
    spans = songs.select(*part, "song_index", F.col("_a").alias("start_s"), F.col("_b").alias("end_s"))
    said = overlap_join(spans, sentences.where("end_s > start_s").select(*keys, "song_index", "start_s", "end_s"), [*keys, "song_index"])
    sung = said.groupBy(*part).agg(F.collect_list(F.struct("song_index", F.col("b_start_s").alias("s"), F.col("b_end_s").alias("e"))).alias("_said"))
    parts = parts.join(sung, part, "left").withColumn("_said", F.coalesce("_said", F.array().cast("array<struct<song_index: int, s: double, e: double>>")))

    def step(acc: Column, _: Column) -> Column:
        clips_, i = acc["c"], acc["i"]
        x, a, b = F.try_element_at(clips_, i), F.try_element_at(clips_, F.greatest(i - 1, F.lit(1))), F.try_element_at(clips_, i + 1)
        size = lambda c: c["end_s"] - c["start_s"]
        missing = shortest - size(x)
        has_a, has_b = i > 1, i < F.size(clips_)
        spare = lambda c, gap: F.coalesce((gap <= OVERLAP) & (size(c) - missing >= shortest), F.lit(False))
        joins = lambda c, size: F.coalesce(c["type"].eqNullSafe(x["type"]) & (c["song_index"] == x["song_index"]) & (size <= longest + EQUAL), F.lit(False))
        set_ = lambda c, start=None, end=None: F.struct((c["start_s"] if start is None else start).alias("start_s"), (c["end_s"] if end is None else end).alias("end_s"), *(c[k].alias(k) for k in ("type", "is_highlight", "song_index", "ident")))
        weight = lambda c: type_priority(c["type"], c["is_highlight"])

        def united(p: Column, q: Column) -> Column:
            kind = F.when(weight(q) > weight(p), q["type"]).otherwise(p["type"])
            return F.struct(F.least(p["start_s"], q["start_s"]).alias("start_s"), F.greatest(p["end_s"], q["end_s"]).alias("end_s"), kind.alias("type"), (p["is_highlight"] | q["is_highlight"]).alias("is_highlight"), p["song_index"].alias("song_index"), p["ident"].alias("ident"))

        def put(at: Column, n: int, *new: Column) -> Column:
            return F.concat(F.slice(clips_, F.lit(1), at - 1), F.array(*new).cast(f"array<{CLIP}>"), F.slice(clips_, at + n, F.greatest(F.lit(0), F.size(clips_) - at - n + 1)))

        state = lambda c, at: F.struct(c.alias("c"), F.greatest(F.lit(1), at).alias("i"))
        later, earlier = to_millis(x["end_s"] + missing), to_millis(x["start_s"] - missing)
        held = F.aggregate(F.filter("_said", lambda s: s["song_index"] == x["song_index"]), F.lit(0.0), lambda t, s: t + F.greatest(F.lit(0.0), F.least(x["end_s"], s["e"]) - F.greatest(x["start_s"], s["s"])))
        none = F.array().cast(f"array<{CLIP}>")
        dropped = F.concat(F.slice(clips_, F.lit(1), i - 1), none, F.slice(clips_, i + 1, F.greatest(F.lit(0), F.size(clips_) - i)))
        return (
            F.when((i > F.size(clips_)), acc)
            .when(missing <= EQUAL, state(clips_, i + 1))
            .when(has_b & spare(b, b["start_s"] - x["end_s"]), state(put(i, 2, set_(x, end=later), set_(b, start=later)), i - 1))
            .when(has_a & spare(a, x["start_s"] - a["end_s"]), state(put(i - 1, 2, set_(a, end=earlier), set_(x, start=earlier)), i - 1))
            .when(has_a & joins(a, x["end_s"] - a["start_s"]), state(put(i - 1, 2, united(a, x)), i - 2))
            .when(has_b & joins(b, b["end_s"] - x["start_s"]), state(put(i, 2, united(x, b)), i - 1))
            .when(held >= SUNG, state(clips_, i + 1))
            .otherwise(state(dropped, i - 1))
        )

    # each change makes one short clip less, and costs at most three more looks
    looks = F.sequence(F.lit(1), 8 * F.size("_x") + 8)
    start = F.struct(F.col("_x").cast(f"array<{CLIP}>").alias("c"), F.lit(1).alias("i"))
    done = F.when(F.col("_any"), F.aggregate(looks, start, step, lambda acc: acc["c"])).otherwise(F.col("_x").cast(f"array<{CLIP}>"))
    out = parts.select(*part, F.posexplode(done).alias("_at", "s")).select(*part, "_at", "s.*").withColumnRenamed("ident", order)
    return _table(_ordered(out, keys, "island", "_at").drop("island", "_at"))


def normalize_overlaps(segments: DataFrame, sentences: DataFrame, words: DataFrame | None, keys: Keys, shortest: float, longest: float, steps: Sequence[str] = STEPS, order: str = "seg_index") -> DataFrame:
    """Segments (song_index, seg_index, start_s, end_s, type, is_highlight) without overlaps, short ones repaired and sung gaps filled; adds filled.

    Sentences and words (song_index, start_s, end_s, word) are on the media's timeline; words may be left out. Segments are told apart by `order`; of joined ones the earlier's stays, and what fills
    a gap has that of the segment before. A timeline's only segment stays as it is.
    """
    names = ["song_index", order, "start_s", "end_s", "type", "is_highlight"]
    clips = segments.select(*keys, F.col("song_index").cast("int").alias("song_index"), order, "start_s", "end_s", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("is_highlight", F.lit(False)).alias("is_highlight"))
    clips = _table(_ordered(clips, keys, "start_s", "end_s", order))
    said = _table(sentences.where("end_s > start_s").select(*keys, "song_index", "start_s", "end_s"))
    heard = said.select("*", F.lit("").alias("word")).limit(0) if words is None else words.where("end_s > start_s").select(*keys, "song_index", "start_s", "end_s", "word")
    filled = None
    for name in steps:
        if name == "part":
            clips = part_overlaps(clips, said, keys, order, shortest, longest)
        elif name == "protect":
            clips = protect_sentences(clips, said, heard, keys, order, shortest, longest)
        elif name == "repair":
            clips = repair_short(clips, said, keys, order, shortest, longest)
        else:
            filled = covered_gap_fills(clips, said, keys, order, type_priority(F.col("type"), F.col("is_highlight")), longest)
    out = clips.select(*keys, *names, F.lit(False).alias("filled"))
    return out if filled is None else out.unionByName(filled.select(*keys, *names, F.lit(True).alias("filled")))
