"""Songs as wholes: matches in a catalogue, neighbours that belong together, agreement of sources, dominant clusters."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators.frames import cosine
from cuesheet.operators.intervals import Keys
from cuesheet.operators.snapping import let


#: characters are counted in so many classes; lengths are put together in buckets a quarter wider each
CLASSES, STEP = 64, 1.25


def character_counts(texts: list[str]) -> np.ndarray:
    """How often each class of characters occurs in each text."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    for row, x in zip(out, texts, strict=True):
        row += np.bincount(np.frombuffer(x.encode("utf-32-le"), "<u4") % CLASSES, minlength=CLASSES).astype(np.int32)
    return out


def best_catalog_match(wanted: DataFrame, catalog: DataFrame, ident: str, title: str, catalog_id: str, catalog_title: str, least: float = 0.45, block: int = 4096) -> DataFrame:
    """For each wanted title the catalogue's most similar one from `least` up: ident, catalog_id, similarity; of equals the smallest id.

    Exact: a pair is left out only where it can't reach `least`. Lengths bound the similarity, so a title meets the buckets of lengths that are near enough, each in blocks of titles; in a block
    the characters in common, whatever their order, bound it for all pairs at once, and pairs are compared from the highest bound down until no bound reaches the best. Equal titles are compared once.
    """
    a = wanted.select(ident, tx.norm_title(F.col(title)).alias("_a")).where("_a <> ''")
    b = catalog.select(tx.norm_title(F.col(catalog_title)).alias("_b"), catalog_id).where("_b <> ''").groupBy("_b").agg(F.min(catalog_id).alias("_id"))
    asked = a.select("_a").distinct()
    stripes, slices = (max(1, -(-x.count() // block)) for x in (asked, b))
    bucket = lambda n: F.floor(F.log(n) / math.log(STEP)).cast("int")
    size = F.length("_a").cast("double")
    ratio = (2 - least) / least
    near = F.explode(F.sequence(bucket(F.greatest(F.lit(1.0), size / ratio - 1e-9)), bucket(size * ratio + 1e-9))).alias("_k")
    left = asked.select("_a", F.pmod(F.xxhash64("_a"), stripes).alias("_s"), near).select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_t"))
    right = b.select("_b", "_id", bucket(F.length("_b")).alias("_k"), F.pmod(F.xxhash64("_b"), slices).cast("int").alias("_t")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("_s"))

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("_id")
        texts, ids, out = theirs.column("_b").to_pylist(), theirs.column("_id").to_pylist(), []
        sizes, counts = np.array([len(x) for x in texts]), character_counts(texts)
        own = mine.column("_a").to_pylist()
        for x, c in zip(own, character_counts(own), strict=True):
            if not texts:
                break
            bounds = 2 * np.minimum(c, counts).sum(axis=1) / (sizes + len(x))
            top, at = least, -1
            matcher = SequenceMatcher(None, x, "")
            for i in np.argsort(-bounds, kind="stable"):
                if bounds[i] < top:
                    break
                matcher.set_seq2(texts[i])
                found = matcher.ratio()
                if found > top or found == top and (at < 0 or i < at):
                    top, at = found, int(i)
            if at >= 0:
                out.append((x, ids[at], top))
        return pa.table({"_a": pa.array([r[0] for r in out], pa.string()), "_id": pa.array([r[1] for r in out], theirs.schema.field("_id").type), "similarity": pa.array([r[2] for r in out], pa.float64())})

    ids = catalog.schema[catalog_id].dataType.simpleString()
    keys = ("_k", "_t", "_s")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"_a string, _id {ids}, similarity double")
    top = found.groupBy("_a").agg(F.max_by(F.struct(F.col("_id").alias(catalog_id), "similarity"), F.struct("similarity", (-F.col("_id")).alias("i"))).alias("_x"))
    return a.join(top, "_a").select(ident, f"_x.{catalog_id}", "_x.similarity")


def best_line_window(lines: DataFrame, transcripts: DataFrame, keys: Keys, longest: int) -> DataFrame:
    """Of all windows of 1 to `longest` lines in a row (line, text) the one most like the transcript (transcript): first, size, similarity; of equals the first and shortest."""
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(0, longest - 1)
    ahead = lines.select(*keys, "line", F.collect_list("text").over(w).alias("_t"))
    windows = ahead.select(*keys, F.col("line").alias("first"), F.explode(F.sequence(F.lit(1), F.size("_t"))).alias("size"), "_t")
    windows = windows.select(*keys, "first", "size", F.array_join(F.slice("_t", F.lit(1), F.col("size")), "").alias("_text"))
    scored = windows.join(transcripts, list(keys)).withColumn("similarity", tx.text_similarity(F.col("_text"), F.col("transcript")))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("first", "size", "similarity"), F.struct("similarity", (-F.col("first")).alias("f"), (-F.col("size")).alias("s"))).alias("_x"))
    return best.select(*keys, "_x.*")


def adjacent_merge_score(songs: DataFrame, keys: Keys, order: str, least: float = 3.5) -> DataFrame:
    """How much each song (title, track_id, head_sig, tail_sig, size_s) and the one after it are one: score, strong, merges. The last of a media has none.

    Points: 4 for one track, 4 for one title, 2.5 times a likeness over 0.6; 3.5 or 2 for edges with a cosine from 0.90 or 0.84; 2 for two
    unknown titles; 1 for a short pair. Merging needs `least` points and a strong sign: track, title or close edges.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    pair = songs.withColumns({f"_{c}": F.lead(c).over(w) for c in ("title", "track_id", "head_sig", "size_s")}).where("_size_s is not null")
    known = (F.col("title") != "") & (F.col("_title") != "")
    same_track = F.coalesce(F.col("track_id") == F.col("_track_id"), F.lit(False))
    same_title = known & (tx.norm_title(F.col("title")) == tx.norm_title(F.col("_title")))
    like = F.when(known & ~same_title, tx.title_similarity(F.col("title"), F.col("_title"))).otherwise(0.0)
    edge = cosine(F.col("tail_sig"), F.col("_head_sig"))
    rows = pair.withColumns({"_like": like, "_edge": edge})
    score = F.when(same_track, 4.0).otherwise(0.0) + F.when(same_title, 4.0).otherwise(0.0) + F.when(F.col("_like") > 0.6, F.col("_like") * 2.5).otherwise(0.0)
    score = score + F.when(F.col("_edge") >= 0.90, 3.5).when(F.col("_edge") >= 0.84, 2.0).otherwise(0.0)
    score = score + F.when((F.col("title") == "") & (F.col("_title") == ""), 2.0).otherwise(0.0) + F.when(F.col("size_s") + F.col("_size_s") < 150, 1.0).otherwise(0.0)
    strong = same_track | same_title | (F.col("_edge") >= 0.90)
    return rows.select(*keys, order, score.alias("score"), strong.alias("strong")).withColumn("merges", (F.col("score") >= least) & F.col("strong"))


def merge_song_chain(songs: DataFrame, scores: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Songs joined along the chain of merging neighbours: number, first known title, span, largest confidence, parts."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = songs.join(scores.select(*keys, order, "merges"), [*keys, order], "left")
    rows = rows.withColumn("_new", F.when(F.coalesce(F.lag("merges").over(w), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("song", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    title = F.coalesce(F.min_by("title", F.when(F.col("title") != "", F.col(order))), F.lit(""))
    return rows.groupBy(*keys, "song").agg(title.alias("title"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.max("confidence").alias("confidence"), F.count("*").alias("parts"))


def cross_source_agreement(sources: DataFrame, keys: Keys, source: str, text: str, score: str, least: float = 0.7) -> DataFrame:
    """Mean similarity of the pairs of sources (few for each key), whether that validates them, and the best source by its score."""
    a, b = (sources.select(*keys, F.col(source).alias(f"_{x}"), F.col(text).alias(f"_t{x}")) for x in "ab")
    pairs = a.join(b, list(keys)).where("_a < _b").withColumn("_s", tx.text_similarity(F.col("_ta"), F.col("_tb")))
    means = pairs.groupBy(*keys).agg(F.avg("_s").alias("agreement"))
    best = sources.groupBy(*keys).agg(F.max_by(source, F.struct(score, source)).alias("best"))
    return best.join(means, list(keys), "left").withColumn("validated", F.coalesce(F.col("agreement") >= least, F.lit(False)))


def dominant_cluster_label(rows: DataFrame, group: str, vector: str, energy: str, k: int = 3, seed: int = 7) -> DataFrame:
    """k-means over all vectors; of each group its commonest cluster, and chorus if that is the cluster of most energy, else verse."""
    data = rows.select(group, energy, array_to_vector(vector).alias("features"))
    found = KMeans(k=k, seed=seed).fit(data).transform(data).select(group, energy, "prediction")
    loud = found.groupBy("prediction").agg(F.avg(energy).alias("_e")).agg(F.max_by("prediction", "_e").alias("_loud"))
    counts = found.groupBy(group, "prediction").agg(F.count("*").alias("n"))
    top = counts.groupBy(group).agg(F.max_by("prediction", F.struct("n", -F.col("prediction"))).alias("cluster"))
    return top.crossJoin(F.broadcast(loud)).select(group, "cluster", F.when(F.col("cluster") == F.col("_loud"), "chorus").otherwise("verse").alias("label"))


def fit_time_transform(pairs: DataFrame, keys: Keys, low: float = 0.45, high: float = 1.85, tolerance: float = 1.2) -> DataFrame:
    """Scale and offset from lyric time x to sung time y (weight w) that most pairs fit: every two pairs propose one; twice the inliers plus their weight decide.

    Deterministic. Pairs are a song's few matched lines. Without a usable proposal the scale is 1 and the offset the mean difference. Columns scale, offset, inliers.
    """
    songs = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y", "w"))).alias("_p"), F.avg(F.col("y") - F.col("x")).alias("_m"))
    fits = lambda m, p: F.abs(m["scale"] * p["x"] + m["offset"] - p["y"]) <= tolerance

    def proposed(a: Column) -> Column:
        scales = F.transform(F.filter("_p", lambda b: b["x"] > a["x"]), lambda b: F.round(F.try_divide(b["y"] - a["y"], b["x"] - a["x"]), 6))
        return F.transform(F.filter(scales, lambda s: s.between(low, high)), lambda s: F.struct(s.alias("scale"), F.round(a["y"] - s * a["x"], 6).alias("offset")))

    def rated(m: Column) -> Column:
        value = F.aggregate("_p", F.lit(0.0), lambda t, p: F.when(fits(m, p), t + 2.0 + F.coalesce(p["w"], F.lit(0.0))).otherwise(t))
        return F.struct(value.alias("v"), m.alias("m"))

    def first(rows: Column) -> Column:
        """Of equal values the scale nearest to one, the smallest offset, the lower offset, the larger scale."""
        order = lambda v, m: F.struct(F.round(v, 6).alias("v"), F.round(-F.abs(m["scale"] - 1), 6).alias("d"), F.round(-F.abs(m["offset"]), 6).alias("o"), (-m["offset"]).alias("t"), m["scale"].alias("scale"))
        most = F.array_max(F.transform(rows, lambda r: r["v"]))
        return F.array_max(let(most, lambda v: F.transform(F.filter(rows, lambda r: r["v"] >= v - 2e-6), lambda r: order(r["v"], r["m"]))))

    best = let(F.transform(F.flatten(F.transform(F.filter("_p", lambda p: p["x"].isNotNull()), proposed)), rated), first)
    out = songs.withColumn("_x", F.when(F.size("_p") > 1, best))
    scale, offset = F.coalesce("_x.scale", F.lit(1.0)), F.coalesce(-F.col("_x.t"), F.col("_m"))
    inliers = F.size(F.filter("_p", lambda p: fits({"scale": F.col("_x.scale"), "offset": -F.col("_x.t")}, p)))
    return out.select(*keys, scale.alias("scale"), offset.alias("offset"), F.when(F.col("_x").isNull(), 0).otherwise(inliers).cast("long").alias("inliers"))


def structural_remap(segments: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Labels of a song (label, start_s, end_s, energy) completed by its structure, each only where the label is absent and for one row.

    The first early short verse is the intro, the last late verse the outro, the first verse after the second chorus a bridge, and the first
    long quiet one instrumental.
    """
    song = Window.partitionBy(*keys)
    w = song.orderBy(order)
    quartiles = segments.groupBy(*keys).agg(F.min("start_s").alias("_s"), F.max("end_s").alias("_e"), F.percentile("energy", F.lit(0.25)).alias("_p25"), F.percentile("energy", F.lit(0.75)).alias("_p75"))
    size = F.col("end_s") - F.col("start_s")
    rows = segments.join(quartiles, list(keys)).withColumns({"_pos": (F.col("start_s") - F.col("_s")) / (F.col("_e") - F.col("_s")), "_to": (F.col("end_s") - F.col("_s")) / (F.col("_e") - F.col("_s"))})

    def once(rows: DataFrame, name: str, fits: Column, last: bool = False) -> DataFrame:
        fits = fits & (F.max((F.col("label") == name).cast("int")).over(song) == 0)
        rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
        at = (F.max if last else F.min)(F.when(F.col("_fits"), F.col(order))).over(song)
        return rows.withColumn("_at", at).withColumn("label", F.when(F.col("_fits") & (F.col(order) == F.col("_at")), name).otherwise(F.col("label")))

    rows = once(rows, "intro", (F.col("label") == "verse") & (F.col("_pos") < 0.05) & (size < 30))
    rows = once(rows, "outro", (F.col("label") == "verse") & ((F.col("_to") > 0.92) | (F.col("_to") > 0.85) & (F.col("energy") < F.col("_p25"))), last=True)
    nr = F.sum((F.col("label") == "chorus").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_nr", nr)
    second = F.min(F.when((F.col("_nr") == 2) & (F.col("label") == "chorus"), F.col("_pos"))).over(song)
    rows = rows.withColumn("_second", second)
    rows = once(rows, "bridge", F.col("label").isin("verse", "intro") & (F.col("_pos") > F.col("_second") + 0.03) & F.col("_pos").between(0.15, 0.70) & F.col("energy").between(F.col("_p25"), F.col("_p75")) & (size < 45))
    rows = once(rows, "inst", F.col("label").isin("verse", "intro", "prechorus") & (F.col("energy") < F.col("_p25")) & (size >= 5))
    return rows.select(*keys, order, "label")
