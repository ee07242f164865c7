"""Frame and vector operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuesheet.operators import frames as fr
from cuesheet.plans.registry import query

M = ["media_id"]
W = "(PARTITION BY media_id ORDER BY frame ROWS BETWEEN {} AND {})"
SMOOTH5 = "OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


MIRRORED = f"""a AS (SELECT media_id, frame, rms, row_number() OVER (PARTITION BY media_id ORDER BY frame) AS nr, count(*) OVER (PARTITION BY media_id) AS n FROM tl),
    m AS (SELECT *, nr AS spot FROM a UNION ALL SELECT *, 1 - nr FROM a WHERE nr <= 2 UNION ALL SELECT *, 2 * n + 1 - nr FROM a WHERE n - nr < 2),
    r AS (SELECT *, avg(rms) OVER (PARTITION BY media_id ORDER BY spot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS reflected FROM m)"""


@query("W01_moving_average", f"WITH {MIRRORED}, s AS (SELECT media_id, frame, avg(rms) {SMOOTH5} AS smooth FROM tl) SELECT media_id, frame, s.smooth, r.reflected FROM r JOIN s USING (media_id, frame) WHERE spot = nr", "smooth reflected")
def w01(v):
    rows = v.tl.select("media_id", "frame", "rms", fr.moving_average("rms", M, "frame", 5).alias("cut"))
    return fr.reflected_average(rows, "rms", M, "frame", 5).select("media_id", "frame", F.col("cut").alias("smooth"), F.col("smooth").alias("reflected"))


@query("W02_local_extrema", """SELECT media_id, frame, rms FROM (SELECT *, max(rms) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, max(rms) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b FROM tl) WHERE rms > a AND rms > b""")
def w02(v):
    return fr.in_chunks(v.tl, M, "frame", 3, lambda rows, keys: fr.local_extrema(rows, "rms", keys, "frame", 3), 64).select("media_id", "frame", "rms")


CHANGE = f"""s AS (SELECT *, coalesce(abs(rms - lag(rms) OVER (PARTITION BY media_id ORDER BY frame)), 0.0) AS step FROM tl), m AS (SELECT *, avg(step) {SMOOTH5} AS smooth FROM s),
    c AS (SELECT media_id, frame, t, rms, CASE WHEN max(smooth) OVER (PARTITION BY media_id) > 0 THEN smooth / max(smooth) OVER (PARTITION BY media_id) ELSE 0.0 END AS change FROM m)"""


@query("W03_change_rate", f"WITH {CHANGE} SELECT media_id, frame, change FROM c", "change")
def w03(v):
    return fr.change_rate(v.tl, "rms", M, "frame", 5).select("media_id", "frame", "change")


DIMS = "d AS (SELECT song, frame, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM vec)"


@query("W04_before_after_distance", f"""WITH {DIMS}, s AS (SELECT *, avg(x) OVER b - avg(x) OVER a AS diff, count(x) OVER b = 4 AND count(x) OVER a = 4 AS whole FROM d
    WINDOW b AS (PARTITION BY song, dim ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY song, dim ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
    SELECT song, frame, CASE WHEN bool_and(whole) THEN sqrt(sum(diff * diff)) ELSE 0.0 END AS distance FROM s GROUP BY song, frame""", "distance")
def w04(v):
    return fr.before_after_distance(v.vec, "v", ["song"], "frame", 4)


@query("W05_similarity_drop", f"""WITH {DIMS}, s AS (SELECT *, avg(x) OVER b AS p, avg(x) OVER a AS q FROM d
    WINDOW b AS (PARTITION BY song, dim ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY song, dim ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
    c AS (SELECT song, frame, sum(p * q) / sqrt(sum(p * p) * sum(q * q)) AS similarity FROM s GROUP BY song, frame),
    e AS (SELECT *, coalesce(avg(similarity) OVER (PARTITION BY song ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) - similarity, 0.0) AS "drop" FROM c)
    SELECT *, "drop" > 0.4 AS scores FROM e""", 'similarity "drop"')
def w05(v):
    return fr.similarity_drop(v.vec, "v", ["song"], "frame", 4)


@query("W07_mask_to_intervals", """WITH f AS (SELECT *, rms > 20 AS on_, coalesce(lag(rms > 20) OVER (PARTITION BY media_id ORDER BY frame), false) AS was FROM tl),
    g AS (SELECT *, sum(CASE WHEN on_ AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT media_id, min(frame) AS "first", max(frame) AS "last", count(*) AS n FROM g WHERE on_ GROUP BY media_id, island""")
def w07(v):
    return fr.mask_to_intervals(v.tl, F.col("rms") > 20, M, "frame")


OPENED = """o1 AS (SELECT media_id, frame, min((rms > 20)::INT) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM tl),
    o2 AS (SELECT media_id, frame, max(a) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS b FROM o1),
    o3 AS (SELECT media_id, frame, max(b) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c FROM o2),
    o4 AS (SELECT media_id, frame, min(c) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS flag FROM o3)"""


@query("W08_binary_open_close", f"WITH {OPENED} SELECT * FROM o4")
def w08(v):
    rows = v.tl.select("media_id", "frame", (F.col("rms") > 20).alias("flag"))
    both = lambda some, keys: fr.binary_close(fr.binary_open(some, "flag", keys, "frame", 3), "flag", keys, "frame", 5)
    return fr.in_chunks(rows, M, "frame", 6, both, 64)


#: frame numbers as seconds; the energy as the change, no change after a dark or bright frame and at first
SHOWN = "x AS (SELECT media_id, frame, rms, (frame * 37 + media_id * 11) % 280 AS light FROM tl), f AS (SELECT media_id, frame, row_number() OVER (PARTITION BY media_id ORDER BY frame) AS nr, light NOT BETWEEN 10 AND 250 AS dark, CASE WHEN lag(light) OVER (PARTITION BY media_id ORDER BY frame) BETWEEN 10 AND 250 THEN rms END AS change FROM x), tt AS (SELECT media_id, max(frame) + 1 AS total FROM tl GROUP BY media_id)"
#: frame by frame: the start of the run, how many frames interrupt it, and what ends here
STILL = """w AS (SELECT media_id, 0::BIGINT AS nr, NULL::BIGINT AS start, 0 AS k, NULL::BIGINT AS s, NULL::BIGINT AS e FROM f WHERE nr = 1 UNION ALL
      SELECT f.media_id, f.nr, CASE WHEN {dark_ends} THEN NULL WHEN NOT dark AND change < 40 THEN coalesce(w.start, frame) WHEN NOT dark AND change >= 40 AND w.k + 1 > {gap} THEN NULL ELSE w.start END, CASE WHEN NOT dark AND change < 40 THEN 0 WHEN dark OR change >= 40 THEN w.k + 1 ELSE w.k END,
        CASE WHEN w.start IS NOT NULL AND ({dark_closes} OR NOT dark AND change >= 40 AND w.k + 1 > {gap}) THEN w.start END, frame FROM w JOIN f ON f.media_id = w.media_id AND f.nr = w.nr + 1)"""
OPEN = "l AS (SELECT media_id, arg_max({'s': start}, nr).s AS s FROM w GROUP BY media_id)"


def shown(v):
    w = Window.partitionBy("media_id").orderBy("frame")
    rows = v.tl.select("media_id", F.col("frame").cast("double").alias("second"), "rms", "frame", ((F.col("frame") * 37 + F.col("media_id") * 11) % 280).alias("light"))
    rows = rows.withColumn("change", F.when(F.lag("light").over(w).between(10, 250), F.col("rms")))
    return rows, v.tl.groupBy("media_id").agg((F.max("frame") + 1).cast("double").alias("total_s"))


@query("W09_static_runs", f"WITH RECURSIVE {SHOWN}, {STILL.format(dark_ends='dark AND w.k + 1 > 2', dark_closes='dark AND w.k + 1 > 2', gap=1)}, {OPEN} SELECT media_id, start_s, size_s FROM (SELECT media_id, s::DOUBLE AS start_s, (e - 1 - s)::DOUBLE AS size_s FROM w WHERE s IS NOT NULL UNION ALL SELECT media_id, s::DOUBLE, (total - s)::DOUBLE FROM l JOIN tt USING (media_id) WHERE s IS NOT NULL) WHERE size_s >= 2".replace("WITH RECURSIVE", "SELECT * FROM (WITH RECURSIVE") + ")")
def w09(v):
    rows, totals = shown(v)
    return fr.static_runs(rows, totals, M, "second", "change", "light", 40.0)


@query("W09_static_candidates", f"""SELECT * FROM (WITH RECURSIVE {SHOWN}, {STILL.format(dark_ends='dark', dark_closes='false', gap=2)}, {OPEN}, c AS (SELECT media_id, greatest(0, s - 6) AS a, least(total, e + 6) AS b FROM w JOIN tt USING (media_id) WHERE s IS NOT NULL AND e - s - 2 >= 2
      UNION ALL SELECT media_id, greatest(0, s - 6), total FROM l JOIN tt USING (media_id) WHERE s IS NOT NULL AND total - s >= 2),
    g AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY media_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10 THEN 1 ELSE 0 END AS apart FROM c), i AS (SELECT *, sum(apart) OVER (PARTITION BY media_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT media_id, min(a)::DOUBLE AS start_s, max(b)::DOUBLE AS end_s, count(*) AS n FROM i GROUP BY media_id, island)""")
def w09_candidates(v):
    rows, totals = shown(v)
    return fr.static_candidates(rows, totals, M, "second", "change", "light", 40.0)


@query("W10_local_self_similarity", f"""WITH u AS (SELECT song, frame, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vec), d AS (SELECT song, frame, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM u),
    m AS (SELECT *, avg(x) OVER (PARTITION BY song, dim ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM d) SELECT song, frame, (sum(x * m) + 1) / 2 AS similarity FROM m GROUP BY song, frame""", "similarity")
def w10(v):
    return fr.local_self_similarity(v.vec, "v", ["song"], "frame", 5)


@query("W13_neighbour_context", "SELECT media_id, seg_index, lag(confidence) OVER w AS prev_confidence, lead(confidence) OVER w AS next_confidence, row_number() OVER w AS nr, count(*) OVER (PARTITION BY media_id, song_index) AS n FROM seg WINDOW w AS (PARTITION BY media_id, song_index ORDER BY start_s, seg_index)")
def w13(v):
    from pyspark.sql import Window

    song = Window.partitionBy("media_id", "song_index")
    w = song.orderBy("start_s", "seg_index")
    return v.seg.select("media_id", "seg_index", F.lag("confidence").over(w).alias("prev_confidence"), F.lead("confidence").over(w).alias("next_confidence"), F.row_number().over(w).cast("long").alias("nr"), F.count("*").over(song).alias("n"))


#: frames with features made from their numbers; the same text serves both engines
FRAMES = """media_id, frame, t, rms, CAST(frame * 7 % 11 AS DOUBLE) / 40 AS zcr, CAST(frame * 3 % 10 AS DOUBLE) / 10 AS flatness, CAST(frame * 13 % 17 AS DOUBLE) / 17 AS pitch, CAST(frame * 37 % 4500 AS DOUBLE) + 1 AS centroid,
    CAST(frame * 5 % 19 AS DOUBLE) / 19 AS likelihood"""
FEATURED = f"fs AS (SELECT {FRAMES} FROM tl)"


def featured(v):
    return v.tl.selectExpr(*FRAMES.replace("\n", " ").split(", "))


MEASURED = ["rms", "zcr", "centroid", "flatness", "pitch"]
STATS = {f"{c}_{k}": x for c in MEASURED for k, x in ({"mean": f"avg({c})", "std": f"stddev_pop({c})"} | {f"p{p}": f"quantile_cont({c}, {p / 100})" for p in fr.SHARES}).items()}


@query("A01_frame_statistics", f"""WITH {FEATURED}, f AS (SELECT media_id, quantile_cont(rms, 0.05) AS p5 FROM tl GROUP BY media_id), m AS (SELECT fs.*, rms > p5 AS on_, sum((rms > p5)::INT) OVER (PARTITION BY media_id) AS k FROM fs JOIN f USING (media_id))
    SELECT media_id, count(*) AS n, {', '.join(f'{x} AS {k}' for k, x in STATS.items())} FROM m WHERE k <= 10 OR on_ GROUP BY media_id""", " ".join(STATS))
def a01(v):
    return fr.frame_statistics(featured(v), MEASURED, M)


@query("A02_song_statistics", f"WITH m AS (SELECT media_id, avg(rms) {SMOOTH5} AS s FROM tl) SELECT media_id, avg(s) AS mean, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.75) AS p75, quantile_cont(s, 0.85) AS p85, 1 / (1 + stddev_pop(s) / nullif(avg(s), 0)) AS stability FROM m GROUP BY media_id", "mean p50 p75 p85 stability")
def a02(v):
    return fr.song_statistics(v.tl, "rms", M, "frame", 5)


@query("A03_segment_features", f"""WITH {FEATURED}, w AS (SELECT media_id, avg(rms) AS we, avg(centroid) AS wc FROM fs GROUP BY media_id), i AS (SELECT s.media_id, s.seg_index, f.* EXCLUDE (media_id) FROM seg s JOIN fs f ON s.media_id = f.media_id AND f.t >= s.start_s AND f.t < s.end_s)
    SELECT i.media_id, seg_index, avg(rms) AS energy, stddev_pop(rms) AS deviation, var_pop(rms) AS variance, avg((rms < 10)::INT) AS silence_ratio, avg(centroid) AS centroid, stddev_pop(centroid) AS centroid_std, arg_max(centroid, t) - arg_min(centroid, t) AS centroid_gradient,
    avg(likelihood) AS repeat_likelihood, avg(rms) / any_value(we) AS relative_energy, avg(centroid) / any_value(wc) AS centroid_relative FROM i JOIN w USING (media_id) GROUP BY i.media_id, seg_index""",
    "energy deviation variance silence_ratio centroid centroid_std centroid_gradient repeat_likelihood relative_energy centroid_relative")
def a03(v):
    return fr.segment_features(featured(v), v.seg, M, "seg_index", "t", "frame", "rms", "centroid", "likelihood", 10.0)


@query("A20_interval_stability", """WITH g AS (SELECT media_id, t - lag(t) OVER (PARTITION BY media_id ORDER BY t) AS gap FROM tl WHERE kind = 'click')
    SELECT media_id, count(*) AS n, CASE WHEN count(*) <= 3 OR avg(gap) <= 0 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - stddev_pop(gap) / avg(gap))) END AS stability FROM g GROUP BY media_id""", "stability")
def a20(v):
    return fr.interval_stability(v.tl.where("kind = 'click'"), M, "t")


@query("A21_distribution_entropy", "WITH p AS (SELECT song, frame, unnest(list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda y: abs(y))))) AS p FROM vec) SELECT song, avg(e) AS entropy FROM (SELECT song, frame, -sum(p * log2(p)) AS e FROM p WHERE p > 0.01 GROUP BY song, frame) GROUP BY song", "entropy")
def a21(v):
    return v.vec.groupBy("song").agg(F.avg(fr.distribution_entropy(F.col("v"))).alias("entropy"))


SIDE = """{n}1 AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY frame {order}) AS nr FROM vec), {n}2 AS (SELECT song, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM {n}1 WHERE nr <= 12), {n}3 AS (SELECT song, dim, avg(x) AS m FROM {n}2 GROUP BY song, dim),
    {n} AS (SELECT song, dim - 1 AS dim, m / sqrt(sum(m * m) OVER (PARTITION BY song)) AS x FROM {n}3)"""


@query("A22_edge_signature", f"WITH {SIDE.format(n='hd', order='')}, {SIDE.format(n='ta', order='DESC')} SELECT song, dim, hd.x AS head, ta.x AS tail FROM hd JOIN ta USING (song, dim)", "head tail")
def a22(v):
    side = lambda name, tail: fr.by_dimension(fr.edge_signature(v.vec, "v", ["song"], "frame", 12, tail=tail), "signature").select("song", F.col("dim").cast("long").alias("dim"), F.col("x").alias(name))
    return side("head", False).join(side("tail", True), ["song", "dim"])


@query("A25_voice_ratio", f"WITH {FEATURED}, f AS (SELECT media_id, quantile_cont(rms, 0.2) AS p FROM tl GROUP BY media_id) SELECT media_id, floor(t / 720)::INT AS song_index, avg((rms > p)::INT) AS voice_ratio, least(1.0, coalesce(avg(rms) FILTER (zcr > 0.1), 0.0) / avg(rms)) AS vocal_share FROM fs JOIN f USING (media_id) GROUP BY ALL", "voice_ratio vocal_share")
def a25(v):
    rows = featured(v).withColumn("song_index", F.floor(F.col("t") / 720).cast("int"))
    shares = rows.groupBy("media_id", "song_index").agg(fr.vocal_share(F.avg(F.when(F.col("zcr") > 0.1, F.col("rms"))), F.avg("rms")).alias("vocal_share"))
    return fr.voice_ratio(rows, "rms", M, "song_index").join(shares, ["media_id", "song_index"])


#: each vector as the outputs of three overlapping windows: 63 classes and the boundary
COMBINED = """w AS (SELECT song, frame + k AS frame, v FROM vec, range(0, 3) r(k)), g AS (SELECT song, frame, list(v) AS vs FROM w GROUP BY ALL), m AS (SELECT song, frame, list_transform(range(1, 65), lambda d: list_avg(list_transform(vs, lambda x: x[d]))) AS m FROM g),
    p AS (SELECT song, frame, m[1:63] AS p, list_max(m[1:63]) AS top, m[64] AS b FROM m), cb AS (SELECT song, frame, (list_position(p, top) - 1)::INT AS class, 1 / list_sum(list_transform(p, lambda x: exp(x - top))) AS probability, 1 / (1 + exp(-b)) AS boundary FROM p)"""


def combined(v):
    windows = v.vec.select("song", F.explode(F.sequence(F.col("frame"), F.col("frame") + 2)).alias("frame"), F.slice("v", 1, 63).alias("v"), F.element_at("v", 64).alias("b"))
    return fr.combine_window_logits(windows, ["song"], "frame", "v", "b")


@query("A26_combine_window_logits", f"WITH {COMBINED} SELECT * FROM cb", "probability boundary")
def a26(v):
    return combined(v)


@query("A26_segment_confidence", f"WITH {COMBINED} SELECT song, frame // 10 AS part, avg(boundary) * avg(probability) AS confidence FROM cb GROUP BY ALL", "confidence")
def a26_segments(v):
    return fr.segment_confidence(combined(v).withColumn("part", F.floor(F.col("frame") / 10)), ["song", "part"])


@query("A26_top_classes", f"WITH {COMBINED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY song, bucket ORDER BY n DESC, class) AS nr FROM (SELECT song, frame // 60 AS bucket, class, count(*) AS n FROM cb GROUP BY ALL)) WHERE nr <= 3")
def a26_top(v):
    return fr.top_classes(combined(v), ["song"], "frame", 60)


@query("A28_signal_diagnostics", "SELECT media_id, max(t) - min(t) AS duration_s, 20 * log10(greatest(max(abs(rms)), 1e-9)) AS peak_db, 20 * log10(greatest(avg(abs(rms)), 1e-9)) AS mean_db, avg((abs(rms) < 5)::INT) AS silent_share, max(abs(rms)) > 5 AS valid FROM tl GROUP BY media_id", "duration_s peak_db mean_db silent_share")
def a28(v):
    return fr.signal_diagnostics(v.tl, "rms", M, "t", 5.0)


DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"


@query("F11_cosine", "WITH a AS (SELECT * FROM vec), b AS (SELECT song, frame - 1 AS frame, v FROM vec) SELECT a.song, a.frame, coalesce(list_cosine_similarity(a.v, b.v), 0.0) AS cosine FROM a LEFT JOIN b ON a.song = b.song AND a.frame = b.frame", "cosine")
def f11(v):
    after = v.vec.select("song", (F.col("frame") - 1).alias("frame"), F.col("v").alias("w"))
    return v.vec.join(after, ["song", "frame"], "left").select("song", "frame", fr.cosine(F.col("v"), F.col("w")).alias("cosine"))


@query("J19_pairwise_similarity", "SELECT a.song, a.frame, avg(list_cosine_similarity(a.v, b.v)) AS avg_similarity, count(*) FILTER (list_cosine_similarity(a.v, b.v) > 0.3) AS repeat_count FROM vec a LEFT JOIN vec b ON a.song = b.song AND a.frame <> b.frame GROUP BY ALL", "avg_similarity")
def j19(v):
    return fr.pairwise_similarity(v.vec, "v", "song", "frame", 0.3).select("song", "frame", "avg_similarity", "repeat_count")


def window(f, before, after):
    return f"{f} OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


@query("W18_applause_mask", f"""WITH {FEATURED}, q AS (SELECT media_id, quantile_cont(zcr, 0.6) AS a, quantile_cont(flatness, 0.5) AS b, quantile_cont(pitch, 0.6) AS c, quantile_cont(rms, 0.15) AS d FROM fs GROUP BY media_id),
    f0 AS (SELECT media_id, frame, (zcr > a AND flatness > b AND pitch < c AND rms > d)::INT AS f FROM fs JOIN q USING (media_id)), f1 AS (SELECT media_id, frame, {window('min(f)', 1, 0)} AS f FROM f0), f2 AS (SELECT media_id, frame, {window('max(f)', 0, 1)} AS f FROM f1),
    f3 AS (SELECT media_id, frame, {window('max(f)', 1, 2)} AS f FROM f2), f4 AS (SELECT media_id, frame, {window('min(f)', 2, 1)} = 1 AS flag FROM f3) SELECT * FROM f4""")
def w18(v):
    return fr.applause_mask(featured(v), M, "frame", 2).select("media_id", "frame", "flag")


@query("W19_voice_mask", f"WITH {FEATURED}, q AS (SELECT media_id, quantile_cont(rms, 0.2) AS p20 FROM fs GROUP BY media_id) SELECT media_id, frame, rms > p20 AND zcr > 0.02 AND zcr < 0.20 AND centroid > 300 AND centroid < 4000 AS flag FROM fs JOIN q USING (media_id)")
def w19(v):
    return fr.voice_mask(featured(v), M).select("media_id", "frame", "flag")


@query("W20_intervals_to_mask", "SELECT DISTINCT media_id, unnest(range(floor(start_s / 10)::BIGINT, ceil(end_s / 10)::BIGINT)) AS hop FROM seg WHERE end_s > start_s")
def w20(v):
    return fr.intervals_to_mask(v.seg, M, 10.0)


#: the signs: the change of the energy and others from frame numbers
SIGNS = """media_id, frame, change AS mfcc, CAST(frame * 3 % 7 AS DOUBLE) AS chroma, CAST(frame * 5 % 11 AS DOUBLE) AS centroid, CAST(frame * 7 % 13 AS DOUBLE) AS beat, CAST(frame % 5 AS DOUBLE) AS crowd, CAST(frame * 11 % 17 AS DOUBLE) AS key_drop, 1 / (1 + rms) AS valley,
    CASE WHEN frame % 3 = 0 THEN 1 / (1 + rms) ELSE 0 * rms END AS applause_low"""
SCORE = " + ".join(f"CASE WHEN max({c}) OVER (PARTITION BY media_id) > 0 THEN {c} / max({c}) OVER (PARTITION BY media_id) * {w}::DOUBLE ELSE 0.0 END" for c, w in fr.SIGNS.items())


@query("W22_boundary_score_curve", f"WITH {CHANGE}, z AS (SELECT {SIGNS} FROM c) SELECT media_id, frame, {SCORE} AS score FROM z", "score")
def w22(v):
    rows = fr.change_rate(v.tl, "rms", M, "frame", 5).selectExpr(*SIGNS.replace("\n", " ").split(", "))
    return fr.boundary_score_curve(rows, M).select("media_id", "frame", "score")


AGREEING = """g AS (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t, source) AS gap FROM bnd), i AS (SELECT *, sum(CASE WHEN gap > 15 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, source ROWS UNBOUNDED PRECEDING) AS island FROM g),
    ag AS (SELECT media_id, avg(t) AS t, count(DISTINCT source) AS n_signals FROM i GROUP BY media_id, island HAVING count(DISTINCT source) >= 2)"""


@query("Q07_agreeing_signals", f"WITH {AGREEING} SELECT * FROM ag", "t")
def q07(v):
    return fr.agreeing_signals(v.bnd, M, "t", "source", 15.0)


@query("Q07_strong_peaks_apart", f"""WITH {AGREEING}, p AS (SELECT media_id, quantile_cont(rms, 0.85) AS p FROM tl GROUP BY media_id)
    SELECT media_id, tl.t, rms FROM tl JOIN p USING (media_id) WHERE rms >= p AND NOT EXISTS (SELECT 1 FROM ag WHERE ag.media_id = tl.media_id AND abs(ag.t - tl.t) <= 15)""", "t")
def q07_peaks(v):
    groups = fr.agreeing_signals(v.bnd, M, "t", "source", 15.0)
    return fr.strong_peaks_apart(v.tl.select("media_id", "t", "rms"), groups, M, "t", "rms", 15.0)
