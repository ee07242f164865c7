"""Cuts between neighbouring clips, each from the two clips and what is sung around them: no pair looks at another, so all is joins and expressions.

Clips are (keys, song_index, start_s, end_s and an id in `order`), sentences and words (keys, song_index, start_s, end_s) on the same timeline. The
order-dependent repairs, which chain these, are in `cutsafety`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.text import text_units
from cuesheet.operators.folds import enforce_max_length
from cuesheet.operators.intervals import Keys, gathered, overlap_join, split_gap, to_millis
from cuesheet.operators.lyrics import cut_candidate_score

# Fixed values, in seconds: what counts as equal, as an overlap, as a shared boundary, as a sentence's end, and the pad after one.
EQUAL, OVERLAP, SHARED, NEAR_END, PAD = 0.05, 0.30, 0.50, 0.12, 0.35


def neighbours(clips: DataFrame, keys: Keys, order: str, *more: str) -> DataFrame:
    """Each clip with the next of its timeline, if both are of one song: l_start, l_end, r_start, r_end, the ids (order, next_id), and r_ of more columns.

    Clips are in order of time, or of a column `nr` if they have one. Rows that are neighbours already (with l_start) stay as they are.
    """
    if "l_start" in clips.columns:
        return clips
    w = Window.partitionBy(*keys).orderBy(*(["nr"] if "nr" in clips.columns else ["start_s", "end_s", order]))
    after = {f"r_{c}": F.lead(c).over(w) for c in ("song_index", "start_s", "end_s", *more)}
    rows = clips.withColumns(after | {"next_id": F.lead(order).over(w)}).where(F.col("r_song_index") == F.col("song_index"))
    return rows.select(*keys, "song_index", order, "next_id", F.col("start_s").alias("l_start"), F.col("end_s").alias("l_end"), F.col("r_start_s").alias("r_start"), F.col("r_end_s").alias("r_end"), *more, *(f"r_{c}" for c in more))


def best_cut(candidates: DataFrame, keys: Keys, reference: str, shortest: float, longest: float) -> DataFrame:
    """Of candidates (cut, cost) of each pair of clips the best: keys and cut, null where every one leaves a side of 0.1 s or less."""
    score = cut_candidate_score(F.col("l_start"), F.col("r_end"), F.col("cut"), F.col(reference), shortest, longest, F.col("cost"))
    return candidates.groupBy(*keys).agg(F.min(score).alias("_x")).select(*keys, F.col("_x.cut").alias("cut"))


def overlapping_neighbours(clips: DataFrame, sentences: DataFrame, keys: Keys, order: str, *more: str) -> DataFrame:
    """Neighbours of a song that overlap by more than 0.30 s, with the sentences and the gaps between sentences that meet the overlap: said and gaps, arrays of s and e."""
    song = [*keys, "song_index"]
    rows = neighbours(clips, keys, order, *more).where(F.col("l_end") - F.col("r_start") > OVERLAP)
    rows = rows.withColumns({"start_s": F.greatest("l_start", "r_start"), "end_s": F.least("l_end", "r_end")})
    said = sentences.where("end_s > start_s").select(*song, "start_s", "end_s")
    w = Window.partitionBy(*song).orderBy("start_s", "end_s")
    gap = F.struct(F.col("end_s").alias("start_s"), F.col("_next").alias("end_s"), F.lit(True).alias("gap"))
    both = said.withColumn("_next", F.lead("start_s").over(w)).select(*song, F.explode(F.array(F.struct("start_s", "end_s", F.lit(False).alias("gap")), gap)).alias("x")).select(*song, "x.*").where("end_s > start_s")
    x = F.struct(F.col("b_start_s").alias("s"), F.col("b_end_s").alias("e"))
    return gathered(rows, both, song, -1e-9, said=F.collect_list(F.when(~F.col("b_gap"), x)), gaps=F.collect_list(F.when(F.col("b_gap"), x))).drop("start_s", "end_s")


def overlap_cut(l_start: Column, l_end: Column, r_start: Column, r_end: Column, said: Column, gaps: Column, shortest: float, longest: float) -> Column:
    """Where two overlapping clips part, to 3 decimals; said and gaps as in `overlapping_neighbours`, for this l_start or an earlier one.

    Candidates: the middle of the gaps between sentences (cost 0), edges of sentences (1), a shared sentence's end or start, so that the larger side has
    it whole (2), and the middle of the overlap (5; inside a sentence, if another candidate will do, 500).
    """
    start, end = F.greatest(l_start, r_start), F.least(l_end, r_end)
    middle = (start + end) / 2
    score = lambda cut, cost: cut_candidate_score(l_start, r_end, cut, middle, shortest, longest, cost)
    meets = lambda x: (start < x["e"] + 1e-9) & (end > x["s"] - 1e-9)
    part = lambda x, a, b: F.least(x["e"], b) - F.greatest(x["s"], a)
    met = F.filter(said, meets)
    between = F.transform(F.filter(gaps, meets), lambda x: score((F.greatest(x["s"], start) + F.least(x["e"], end)) / 2, F.lit(0.0)))
    edges = F.filter(F.flatten(F.transform(met, lambda x: F.array(x["s"], x["e"]))), lambda x: x.between(start, end))
    shared = F.filter(met, lambda x: (part(x, l_start, l_end) > 0) & (part(x, r_start, r_end) > 0))
    whole = F.transform(shared, lambda x: score(F.when(part(x, l_start, l_end) >= part(x, r_start, r_end), x["e"]).otherwise(x["s"]), F.lit(2.0)))
    placed = F.array_min(F.concat(between, F.transform(edges, lambda x: score(x, F.lit(1.0))), whole))
    inside = F.exists(met, lambda x: (x["s"] + EQUAL < middle) & (middle < x["e"] - EQUAL))
    # an array of one, so that what is placed is worked out once
    best = F.transform(F.array(placed), lambda x: F.least(x, score(middle, F.when(x.isNotNull() & inside, 500.0).otherwise(5.0))))
    return to_millis(F.coalesce(best[0]["cut"], middle))


def overlap_cuts(clips: DataFrame, sentences: DataFrame, keys: Keys, order: str, shortest: float, longest: float) -> DataFrame:
    """Where neighbours of a song that overlap by more than 0.30 s part, by `overlap_cut`: keys, order, next_id, cut."""
    rows = overlapping_neighbours(clips, sentences, keys, order)
    return rows.select(*keys, order, "next_id", overlap_cut(*map(F.col, ("l_start", "l_end", "r_start", "r_end", "said", "gaps")), shortest, longest).alias("cut"))


def aligned_cuts(clips: DataFrame, sentences: DataFrame, keys: Keys, order: str, soft_min: float = 4.0) -> DataFrame:
    """Where neighbours of a song (with original_start_s, original_end_s) that overlap after snapping part, each pair by itself: keys, order, next_id, cut.

    A cut goes to the start of the first or the end of the last sentence that both hold, without one to a sentence's edge in the overlap, without one to
    the middle of the original edges, held inside the overlap. It costs its distance from both original edges, and 100 for each second that a side is under
    `soft_min`; of equals the earlier. Pairs whose every cut leaves a side of 0.05 s or less are left out.
    """
    song, pair = [*keys, "song_index"], [*keys, order, "next_id"]
    rows = neighbours(clips, keys, order, "original_start_s", "original_end_s").where(F.col("l_end") - F.col("r_start") > EQUAL)
    rows = rows.select(*song, order, "next_id", "l_start", "l_end", "r_start", "r_end", F.col("original_end_s").alias("was_end"), F.col("r_original_start_s").alias("was_start"))
    spans = rows.withColumns({"start_s": F.col("r_start") - EQUAL, "end_s": F.col("l_end") + EQUAL})
    met = overlap_join(spans, sentences.where("end_s > start_s").select(*song, "start_s", "end_s"), song, eps=-1e-9)
    inside = lambda a, b: F.least("b_end_s", b) - F.greatest("b_start_s", a) > 0
    shared = inside("l_start", "l_end") & inside("r_start", "r_end")
    edge = lambda c: F.when(F.col(c).between(F.col("start_s"), F.col("end_s")), F.col(c))
    sums = met.groupBy(*pair).agg(F.min(F.when(shared, F.struct("b_start_s", "b_end_s"))).alias("_a"), F.max(F.when(shared, F.struct("b_start_s", "b_end_s"))).alias("_b"), F.flatten(F.collect_list(F.array(edge("b_start_s"), edge("b_end_s")))).alias("_e"))
    both = rows.join(sums, pair, "left")
    edges = F.array_compact(F.coalesce("_e", F.array().cast("array<double>")))
    middle = F.greatest("r_start", F.least("l_end", (F.col("was_end") + F.col("was_start")) / 2))
    places = F.when(F.col("_a").isNotNull(), F.array("_a.b_start_s", "_b.b_end_s")).when(F.size(edges) > 0, edges).otherwise(F.array(middle))
    cuts = both.withColumn("cut", F.explode(places)).withColumn("cut", F.round(F.col("cut") + 1e-9, 6))
    left, right = F.col("cut") - F.col("l_start"), F.col("r_end") - F.col("cut")
    under = lambda x: F.when(x < soft_min, (soft_min - x) * 100).otherwise(0.0)
    cost = F.round(F.abs(F.col("was_end") - F.col("cut")) + F.abs(F.col("was_start") - F.col("cut")) + under(left) + under(right), 6)
    return cuts.where((left > EQUAL) & (right > EQUAL)).groupBy(*pair).agg(F.min(F.struct(cost.alias("cost"), F.col("cut"))).alias("_x")).select(*pair, F.col("_x.cut").alias("cut"))


def boundaries(clips: DataFrame, keys: Keys, order: str, *more: str) -> DataFrame:
    """Neighbours of a song at most 0.5 s apart, with the boundary (t) that they share."""
    rows = neighbours(clips, keys, order, *more).where(F.abs(F.col("r_start") - F.col("l_end")) <= SHARED)
    return rows.withColumn("t", (F.col("l_end") + F.col("r_start")) / 2)


def adjacent_candidates(clips: DataFrame, sentences: DataFrame, words: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Shared boundaries inside a sentence, each with the sentence's end and start: keys, order, next_id, t, l_start, r_end, cut, cost.

    By its words the sentence counts as sung before the boundary from 60 % on (with more than 3 characters or at most 0.45 s left) or from 50 % with at
    most 0.45 s left; without words from 55 % of its time, or at most 0.45 s left. The other edge costs 3 or 3.5.
    """
    song, pair = [*keys, "song_index"], [*keys, order]
    rows = boundaries(clips, keys, order)
    points = rows.withColumns({"start_s": F.col("t"), "end_s": F.col("t")})
    held = overlap_join(points, sentences.select(*song, "start_s", "end_s"), song, eps=EQUAL).groupBy(*pair).agg(F.min(F.struct("b_start_s", "b_end_s")).alias("_s"))
    rows = rows.join(held, pair).withColumns({"start_s": F.col("_s.b_start_s"), "end_s": F.col("_s.b_end_s")}).drop("_s")
    said = overlap_join(rows, words.select(*song, "start_s", "end_s", text_units(F.col("word")).alias("units")), song)
    share = (F.col("t") - F.col("b_start_s")) / F.greatest(F.lit(EQUAL), F.col("b_end_s") - F.col("b_start_s"))
    sung = F.when(F.col("t") >= F.col("b_end_s"), F.col("b_units")).when(F.col("t") <= F.col("b_start_s"), 0).otherwise(F.least(F.col("b_units"), F.floor(F.col("b_units") * share + 0.5)))
    done = said.groupBy(*pair).agg(F.sum(sung).alias("_done"), F.sum("b_units").alias("_all"))
    rows = rows.join(done, pair, "left").withColumns({"_rest": F.greatest(F.lit(0.0), F.col("end_s") - F.col("t")), "_share": F.col("_done") / F.col("_all")})
    by_words = (F.col("_share") >= 0.6) & ((F.col("_done") > 3) | (F.col("_rest") <= 0.45)) | (F.col("_rest") <= 0.45) & (F.col("_share") >= 0.5)
    by_time = ((F.col("t") - F.col("start_s")) / (F.col("end_s") - F.col("start_s")) >= 0.55) | (F.col("_rest") <= 0.45)
    rows = rows.withColumn("_before", F.when(F.col("_all") > 0, by_words).otherwise(by_time))
    end, start = F.struct(F.col("end_s").alias("cut"), F.when(F.col("_before"), 0.0).otherwise(3.0).alias("cost")), F.struct(F.col("start_s").alias("cut"), F.when(F.col("_before"), 3.5).otherwise(0.0).alias("cost"))
    return rows.select(*pair, "next_id", "t", "l_start", "r_end", F.explode(F.array(end, start)).alias("_c")).select(*pair, "next_id", "t", "l_start", "r_end", "_c.*")


def adjacent_cuts(clips: DataFrame, sentences: DataFrame, words: DataFrame, keys: Keys, order: str, shortest: float, longest: float) -> DataFrame:
    """Shared boundaries inside a sentence that move to its end or start: keys, order, next_id, t, cut to 3 decimals. Moves of up to 0.05 s are none."""
    found = best_cut(adjacent_candidates(clips, sentences, words, keys, order), [*keys, order, "next_id", "t"], "t", shortest, longest)
    return found.where(F.abs(F.col("cut") - F.col("t")) > EQUAL).withColumn("cut", to_millis(F.col("cut")))


def padded_candidates(clips: DataFrame, sentences: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Shared boundaries at a sentence's end (within 0.12 s, and in no sentence) with the place 0.35 s past it, or just before the next sentence: keys, order, next_id, t, l_start, r_end, cut, cost."""
    song, pair = [*keys, "song_index"], [*keys, order]
    rows = boundaries(clips, keys, order)
    said = sentences.where("end_s > start_s").select(*song, "start_s", "end_s")
    points = rows.withColumns({"start_s": F.col("t"), "end_s": F.col("t")})
    inside = overlap_join(points, said, song, eps=EQUAL).select(*pair).distinct()
    ends = said.select(*song, (F.col("end_s") - NEAR_END).alias("start_s"), (F.col("end_s") + NEAR_END).alias("end_s"), F.col("end_s").alias("e"))
    near = overlap_join(points.join(inside, pair, "left_anti"), ends, song, eps=-1e-9).where(F.abs(F.col("b_e") - F.col("t")) <= NEAR_END)
    near = near.groupBy(*pair, "song_index", "next_id", "t", "l_start", "r_end").agg(F.min_by("b_e", F.struct(F.abs(F.col("b_e") - F.col("t")), "b_e")).alias("e"))
    # the next sentence matters only if it begins before the pad is over
    reach = near.withColumns({"start_s": F.col("e") + EQUAL, "end_s": F.col("e") + PAD + EQUAL})
    begins = said.select(*song, "start_s", F.col("start_s").alias("end_s"))
    after = overlap_join(reach, begins, song, eps=-1e-9).where(F.col("b_start_s") > F.col("e") + EQUAL).groupBy(*pair).agg(F.min("b_start_s").alias("_next"))
    cut = F.least(F.col("e") + PAD, F.greatest(F.col("e"), F.coalesce(F.col("_next") - EQUAL, F.col("e") + PAD)))
    rows = near.join(after, pair, "left").withColumns({"cut": cut, "cost": F.lit(0.5)}).where(F.col("cut") > F.col("t") + EQUAL)
    return rows.select(*pair, "next_id", "t", "l_start", "r_end", "cut", "cost")


def padded_cuts(clips: DataFrame, sentences: DataFrame, keys: Keys, order: str, shortest: float, longest: float) -> DataFrame:
    """Shared boundaries that move to the place of `padded_candidates`, if that leaves both clips more than 0.1 s: keys, order, next_id, t, cut to 3 decimals."""
    found = best_cut(padded_candidates(clips, sentences, keys, order), [*keys, order, "next_id", "t"], "t", shortest, longest)
    return found.where("cut is not null").withColumn("cut", to_millis(F.col("cut")))


def boundary_cut(l_start: Column, r_end: Column, t: Column, candidates: Column, shortest: float, longest: float) -> Column:
    """The best of a boundary's candidates (structs cut, cost, moves) to 3 decimals; null if that doesn't move it, or every one leaves a side of 0.1 s or less."""
    score = lambda x: cut_candidate_score(l_start, r_end, x["cut"], t, shortest, longest, x["cost"])
    best = F.array_min(F.filter(F.transform(candidates, lambda x: F.struct(score(x).alias("x"), x["moves"].alias("moves"))), lambda x: x["x"].isNotNull()))
    return F.transform(F.array(best), lambda x: F.when(x["moves"], to_millis(x["x"]["cut"])))[0]


def covered_gap_fills(clips: DataFrame, sentences: DataFrame, keys: Keys, order: str, weight: Column, longest: float) -> DataFrame:
    """Clips for gaps of over 0.5 s between neighbours of a song that are sung for at least max(0.5, min(2, a fifth of the gap)) seconds.

    Columns keys, song_index, order (of the clip before), type (of the weightier neighbour), is_highlight (of either), part, start_s, end_s.
    """
    song, pair = [*keys, "song_index"], [*keys, order]
    rows = neighbours(clips.withColumn("weight", weight), keys, order, "type", "is_highlight", "weight").where(F.col("r_start") - F.col("l_end") > SHARED)
    gaps = rows.withColumns({"start_s": F.col("l_end"), "end_s": F.col("r_start")})
    sung = overlap_join(gaps.select(*song, order, "start_s", "end_s"), sentences.select(*song, "start_s", "end_s"), song).groupBy(*pair).agg(F.sum("overlap_s").alias("_sung"))
    enough = F.greatest(F.lit(0.5), F.least(F.lit(2.0), (F.col("end_s") - F.col("start_s")) * 0.2))
    kind = F.when(F.col("weight") >= F.col("r_weight"), F.col("type")).otherwise(F.col("r_type"))
    filled = gaps.join(sung, pair).where(F.col("_sung") >= enough)
    filled = filled.select(*song, order, kind.alias("type"), (F.col("is_highlight") | F.col("r_is_highlight")).alias("is_highlight"), "start_s", "end_s")
    return split_gap(filled, longest).where(F.col("end_s") - F.col("start_s") > EQUAL)


def split_at_safe_boundaries(segments: DataFrame, points: DataFrame, keys: Keys, order: str, shortest: float, longest: float, label: str = "type") -> DataFrame:
    """Segments over `longest` in parts that end at the safe point (t) nearest to `longest` after their start; then neighbours of one type that fit are joined: start_s, end_s, label, n.

    A part ends at most half of `shortest` (0.5 s at least) before that place or 1 s after it; without a point there, at it. No part is shorter than
    `shortest`, but what is left at a segment's end; under 0.5 s of that is dropped. Highlights stay whole up to 1.1 times `longest`.
    """
    size = F.col("end_s") - F.col("start_s")
    whole = (size <= longest) | F.col("is_highlight") & (size <= longest * 1.1)
    inside = points.select(*keys, F.col("t").alias("start_s"), F.col("t").alias("end_s"))
    near = overlap_join(segments.where(~whole), inside, keys, eps=-1e-9).groupBy(*keys, order).agg(F.sort_array(F.collect_set("b_start_s")).alias("_points"))
    rows = segments.where(~whole).join(near, [*keys, order], "left").withColumn("_points", F.coalesce("_points", F.array().cast("array<double>")))

    def step(cuts: Column, _: Column) -> Column:
        at = F.element_at(cuts, -1)
        ideal = F.least(at + longest, F.col("end_s"))
        low, high = F.greatest(at + shortest, ideal - max(0.5, shortest / 2)), F.least(ideal + 1.0, F.col("end_s"))
        best = F.array_min(F.transform(F.filter("_points", lambda b: (b >= low) & (b <= high)), lambda b: F.struct(F.abs(b - ideal).alias("d"), b.alias("b"))))["b"]
        after = F.least(F.col("end_s"), F.greatest(F.coalesce(best, ideal), at + shortest))
        return F.when(at < F.col("end_s") - 0.5, F.concat(cuts, F.array(after))).otherwise(cuts)

    cuts = F.aggregate(F.sequence(F.lit(0), F.ceil(size / shortest).cast("int")), F.array(F.col("start_s")), step)
    parts = rows.withColumn("_c", cuts).select(*keys, order, label, F.posexplode(F.slice("_c", F.lit(1), F.size("_c") - 1)).alias("_i", "start_s"), "_c")
    parts = parts.select(*keys, order, F.col(label).alias("label"), "start_s", F.element_at("_c", F.col("_i") + 2).alias("end_s"))
    return enforce_max_length(parts.unionByName(segments.where(whole).select(*keys, order, F.col(label).alias("label"), "start_s", "end_s")), keys, order, longest)
