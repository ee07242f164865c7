"""Reports on labels, corrections and identification, and the vote of title probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators.intervals import Keys


def label_distribution(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Counts of each label in each group, of each group, and of all rows, in one pass: nulls stand for all."""
    return rows.rollup(group, label).agg(F.count("*").alias("n"))


def modification_rate(rows: DataFrame, group: Keys, flag: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(flag).alias("modified"), F.coalesce(F.count_if(flag) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("rate"))


def error_patterns(rows: DataFrame) -> DataFrame:
    """Of corrected rows (old, new, is_modified): counts of swaps, of new labels and of all, in one pass: nulls stand for all."""
    return rows.where("is_modified").groupingSets([["old", "new"], ["new"], []], "old", "new").agg(F.count("*").alias("n"))


def suggest_adjustments(rows: DataFrame, fewest: int = 2) -> DataFrame:
    """Thresholds to move: a label that is often put in is missed too often; audience turned into chorus is found too often."""
    swaps = rows.where("is_modified").groupBy("old", "new").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)
    named = F.when(F.col("new").isin("audience", "solo"), F.col("new")).when((F.col("old") == "audience") & (F.col("new") == "chorus"), F.lit("audience"))
    lower = F.col("new").isin("audience", "solo")
    return swaps.withColumn("threshold", named).where("threshold is not null").select("old", "new", "n", "threshold", F.when(lower, "lower").otherwise("higher").alias("direction"), F.lit(0.5).alias("delta"), F.when(lower, "high").otherwise("medium").alias("priority"))


def label_accuracy(rows: DataFrame) -> DataFrame:
    """The share of rows that were left as they are, by old label and over all (null)."""
    return rows.rollup("old").agg(F.count("*").alias("n"), F.avg((~F.col("is_modified")).cast("double")).alias("accuracy"))


def acceptance_check(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("solo",)) -> DataFrame:
    """From one row each of overall, key labels' accuracies, degraded and samples: the reasons against, and whether there are none."""
    old = before.select(*(F.col(c).alias(f"old_{c}") for c in before.columns))
    pair = old.join(after)
    reasons = [F.when(F.col("overall") < F.col("old_overall") - 0.05, "overall")]
    reasons += [F.when(F.col(k) < F.col(f"old_{k}") - 0.1, k) for k in keys]
    reasons.append(F.when((F.col("samples") > 0) & (F.col("degraded") / F.col("samples") > 0.1), "degraded"))
    found = F.array_compact(F.array(*reasons))
    return pair.select(F.array_join(found, ",").alias("reasons"), (F.size(found) == 0).alias("passed"))


def identification_source(title: Column, track: Column, ocr: Column, unknown: str) -> Column:
    named = F.coalesce(ocr, F.lit("")) != ""
    return F.when(F.coalesce(track, F.lit("")) != "", "track").when(named & (title == ocr), "ocr").when(named & (title != unknown), "merged").otherwise("unknown")


def identification_report(songs: DataFrame, source: str) -> DataFrame:
    """Songs by source, and over all (null), with the share that is identified."""
    return songs.rollup(source).agg(F.count("*").alias("n"), F.avg((F.col(source) != "unknown").cast("double")).alias("identified"))


def rebalance_over_predicted(rows: DataFrame, keys: Keys, kind: str, weak: Column, common: str, other: str, fewest: int = 4, share: float = 0.72) -> DataFrame:
    """Where one type is most of a song of at least `fewest` segments, its weak ones become the other type."""
    song = Window.partitionBy(*keys)
    most = (F.count("*").over(song) >= fewest) & (F.avg((F.col(kind) == common).cast("double")).over(song) >= share)
    return rows.withColumn("_most", most).withColumn(kind, F.when(F.col("_most") & (F.col(kind) == common) & weak, F.lit(other)).otherwise(F.col(kind))).drop("_most")


def title_agreement(probes: DataFrame, key: str) -> DataFrame:
    """Of each probe (key, probe, title) how far the titles of the song's other probes agree with its own: half the mean of their similarities; 0 for a probe alone.

    Probes with one title are compared once: the pairs are of a song's different titles, weighted by how many probes have them.
    """
    named = probes.select(key, "probe", tx.norm_title(F.col("title")).alias("_t"))
    titles = named.groupBy(key, "_t").agg(F.count("*").alias("_n"))
    other = titles.select(key, F.col("_t").alias("_u"), F.col("_n").alias("_m"))
    met = titles.join(other, key).where("_t <> _u").withColumn("_s", tx.plain_ratio(F.col("_t"), F.col("_u")))
    sums = met.groupBy(key, "_t").agg(F.sum(F.col("_s") * F.col("_m")).alias("_others"))
    own = F.when(F.col("_t") == "", 0.0).otherwise(F.col("_n") - 1.0)
    all_ = F.sum("_n").over(Window.partitionBy(key))
    degree = titles.withColumn("_all", all_).join(sums, [key, "_t"], "left").select(key, "_t", ((own + F.coalesce("_others", F.lit(0.0))) * 0.5 / F.greatest(F.col("_all") - 1, F.lit(1))).alias("agreement"))
    return named.join(degree, [key, "_t"]).select(key, "probe", "agreement")


def probe_vote(probes: DataFrame, key: str, sure: float = 0.82, agreement: DataFrame | None = None) -> DataFrame:
    """The probe that names a song: the first if it has a track or is sure; else the best of the track that two or more agree on; else the best by
    position weight and confidence, and where given by `agreement` (see `title_agreement`), less trusted where the runner-up is close.

    Probes are (key, probe, track_id, title, confidence, pos_weight), track_id null where unknown.
    """
    song = Window.partitionBy(key)
    agreed = F.when(F.col("track_id").isNotNull(), F.count("*").over(Window.partitionBy(key, "track_id")))
    rows = probes.withColumn("agreement", F.lit(0.0)) if agreement is None else probes.join(agreement, [key, "probe"])
    score = F.col("pos_weight") * (1 + F.least(F.col("confidence"), F.lit(1.0))) + F.col("agreement")
    rows = rows.withColumns({"_n": agreed, "_score": score, "_sure": (F.col("probe") == 1) & (F.col("track_id").isNotNull() | (F.col("confidence") >= sure))})
    rows = rows.withColumn("_rank", F.when(F.col("_sure"), 2).when(F.coalesce(F.col("_n") >= 2, F.lit(False)), 1).otherwise(0))
    value = F.round(F.when(F.col("_rank") == 1, F.col("confidence") * F.col("pos_weight")).otherwise(F.col("_score")), 9)
    votes = F.when(F.col("_rank") == 1, F.col("_n")).otherwise(0)
    order = song.orderBy(F.desc("_rank"), F.desc("_votes"), F.desc("_value"), "probe")
    rows = rows.withColumns({"_value": value, "_votes": votes}).withColumns({"_next": F.lead("_value").over(order), "_nr": F.row_number().over(order)})
    close = (F.col("_rank") == 0) & ((F.col("_value") - F.col("_next")) / F.col("_value") < 0.15)
    how = F.when(F.col("_rank") == 2, "first").when(F.col("_rank") == 1, "track").otherwise("score")
    confidence = F.when(close, F.col("confidence") * 0.6).otherwise(F.col("confidence"))
    return rows.where("_nr = 1").select(key, "probe", "track_id", "title", confidence.alias("confidence"), how.alias("how"))


def apply_edits(segments: DataFrame, edits: DataFrame, keys: Keys, ident: str, least: float = 0.01) -> DataFrame:
    """Segments after edits (new_start_s, new_end_s, new_label, null where unchanged): neighbours in order stay contiguous, and changed rows are marked."""
    w = Window.partitionBy(*keys).orderBy("start_s", ident)
    rows = segments.join(edits, [*keys, ident], "left")
    moved = lambda new, old: F.when(F.abs(F.col(new) - F.col(old)) > least, F.col(new))
    rows = rows.withColumns({"_s": moved("new_start_s", "start_s"), "_e": moved("new_end_s", "end_s")})
    rows = rows.withColumns({"_prev": F.lag("_e").over(w), "_next": F.lead("_s").over(w)})
    changed = F.col("_s").isNotNull() | F.col("_e").isNotNull() | F.coalesce(F.col("new_label") != F.col("label"), F.lit(False))
    return rows.select(*keys, ident, F.coalesce("_s", "_prev", "start_s").alias("start_s"), F.coalesce("_e", "_next", "end_s").alias("end_s"), F.coalesce("new_label", "label").alias("label"), changed.alias("modified"))


def edit_cascade_metrics(before: DataFrame, after: DataFrame, keys: Keys, ident: str, least: float = 0.01) -> DataFrame:
    """Rows whose edges moved by more than `least`: by how much."""
    old = before.select(*keys, ident, F.col("start_s").alias("old_start_s"), F.col("end_s").alias("old_end_s"))
    both = after.join(old, [*keys, ident])
    both = both.select(*keys, ident, (F.col("start_s") - F.col("old_start_s")).alias("start_shift"), (F.col("end_s") - F.col("old_end_s")).alias("end_shift"))
    return both.where((F.abs("start_shift") > least) | (F.abs("end_shift") > least))
