"""Label rules, reports and votes on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuesheet.functions import labels as lb
from cuesheet.operators import frames as fr
from cuesheet.operators import intervals as iv
from cuesheet.operators import reports as rp
from cuesheet.plans.interval_queries import RATIO, TOTALS, merged_sql, totals
from cuesheet.plans.registry import query

M = ["media_id"]
#: the driver's event types as segment labels
NAMES = {"view": " Verse", "click": "pre-chorus", "signup": "合唱", "error": "Silence", "purchase": "chorus"}
RAW = "CASE label " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in NAMES.items()) + " END"
CANON = "CASE label WHEN 'view' THEN 'verse' WHEN 'click' THEN 'prechorus' WHEN 'signup' THEN 'crowd' WHEN 'error' THEN 'silence' ELSE 'chorus' END"
TYPE = "CASE label WHEN 'view' THEN '主歌' WHEN 'click' THEN '副歌' WHEN 'signup' THEN '合唱' WHEN 'purchase' THEN '副歌' END"


def named(v):
    return v.seg.withColumn("raw", lb.looked_up(F.col("label"), NAMES))


@query("P04_canonical_label", f"SELECT media_id, seg_index, {RAW} AS raw, {CANON} AS label FROM seg")
def p04(v):
    return named(v).select("media_id", "seg_index", "raw", lb.canonical_label(F.col("raw")).alias("label"))


@query("P05_export_type", f"SELECT media_id, seg_index, {TYPE} AS type FROM seg")
def p05(v):
    return named(v).select("media_id", "seg_index", lb.export_type(F.col("raw")).alias("type"))


@query("P06_display_type", "SELECT media_id, seg_index, CASE label WHEN 'view' THEN '主歌' WHEN 'purchase' THEN '副歌' ELSE '未标注' END AS type FROM seg")
def p06(v):
    return named(v).select("media_id", "seg_index", lb.display_type(F.col("raw")).alias("type"))


HIGH = f"(({TYPE} IN ('副歌', '合唱') AND confidence >= 0.55) IS TRUE OR {CANON} IN ('chorus', 'crowd') OR (end_s - start_s) / 50 >= 1.35 OR seg_index % 10 / 10.0 >= 0.9)"


@query("P07_is_highlight", f"SELECT media_id, seg_index, {HIGH} AS highlight FROM seg")
def p07(v):
    rows = named(v)
    flag = lb.is_highlight(F.col("raw"), lb.export_type(F.col("raw")), F.col("confidence"), (F.col("end_s") - F.col("start_s")) / 50, F.lit(None).cast("double"), F.col("seg_index") % 10 / 10)
    return rows.select("media_id", "seg_index", flag.alias("highlight"))


@query("F24_type_priority", f"SELECT media_id, seg_index, CASE {TYPE} WHEN '主歌' THEN 60 WHEN '副歌' THEN 80 WHEN '合唱' THEN 90 ELSE 0 END + CASE WHEN confidence > 0.5 THEN 20 ELSE 0 END AS priority FROM seg")
def f24(v):
    return named(v).select("media_id", "seg_index", lb.type_priority(lb.export_type(F.col("raw")), F.col("confidence") > 0.5).alias("priority"))


@query("P09_scene_structure_label", "SELECT media_id, seg_index, CASE WHEN label = 'view' THEN CASE WHEN confidence < 0.3 THEN 'verse' WHEN confidence < 0.6 THEN 'interlude' ELSE 'other' END WHEN label = 'click' THEN 'crowd' WHEN label = 'error' THEN 'speech' ELSE 'other' END AS label, (confidence + 0.5) / 2 AS confidence FROM seg", "confidence")
def p09(v):
    scene = lb.looked_up(F.col("label"), {"view": "music", "click": "clap", "error": "speech"})
    structure = F.when(F.col("confidence") < 0.3, "verse").when(F.col("confidence") < 0.6, "bridge").otherwise("music")
    return v.seg.select("media_id", "seg_index", lb.scene_structure_label(scene, structure).alias("label"), ((F.col("confidence") + 0.5) / 2).alias("confidence"))


@query("P10_scene_by_rule", "SELECT media_id, frame, CASE WHEN rms / 1000 >= 0.01 AND frame % 10 / 40.0 > 0.15 AND t < 2000 THEN 'clap' ELSE 'music' END AS scene, CASE WHEN rms / 1000 < 0.01 THEN 0.7 WHEN frame % 10 / 40.0 > 0.15 AND t < 2000 THEN 0.4 WHEN frame % 10 / 40.0 < 0.08 AND rms / 1000 > 0.05 THEN 0.7 ELSE 0.4 END::DOUBLE AS p FROM tl")
def p10(v):
    return v.tl.select("media_id", "frame", lb.scene_by_rule(F.col("rms") / 1000, F.col("frame") % 10 / 40, F.col("t")).alias("s")).select("media_id", "frame", "s.scene", "s.p")


@query("P11_structure_by_rule", "SELECT media_id, frame, CASE WHEN t / 4320 < 0.1 THEN 'intro' WHEN t / 4320 > 0.9 THEN 'outro' WHEN rms / 50 > 1.2 THEN 'chorus' WHEN rms / 50 < 0.8 AND frame % 10 / 10.0 < 0.9 THEN 'bridge' ELSE 'verse' END AS structure, CASE WHEN t / 4320 < 0.1 OR t / 4320 > 0.9 THEN 0.6 WHEN rms / 50 > 1.2 THEN 0.65 WHEN rms / 50 < 0.8 AND frame % 10 / 10.0 < 0.9 THEN 0.5 ELSE 0.6 END::DOUBLE AS p FROM tl")
def p11(v):
    return v.tl.select("media_id", "frame", lb.structure_by_rule(F.col("t") / 4320, F.col("rms") / 50, F.col("frame") % 10 / 10).alias("s")).select("media_id", "frame", "s.structure", "s.p")


@query("P12_relabel_by_position", f"SELECT media_id, seg_index, CASE WHEN {CANON} = 'verse' AND start_s / 4320 < 0.15 AND end_s - start_s < 30 THEN 'intro' WHEN {CANON} = 'verse' AND start_s / 4320 > 0.85 THEN 'outro' ELSE {CANON} END AS label FROM seg")
def p12(v):
    return named(v).select("media_id", "seg_index", lb.relabel_by_position(lb.canonical_label(F.col("raw")), F.col("start_s"), F.col("end_s") - F.col("start_s"), F.lit(4320.0)).alias("label"))


@query("P19_infer_type_from_filename", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '主歌' WHEN page_id % 3 = 1 THEN '乐器SOLO' ELSE '未标注' END AS type FROM path")
def p19(v):
    mark = F.when(F.col("page_id") % 3 == 0, "_Verse_").when(F.col("page_id") % 3 == 1, "独奏").otherwise("_")
    return v.path.select("page_id", lb.type_from_filename(F.concat(F.lit("a"), mark, F.lit("b.mp4"))).alias("type"))


@query("P21_resolve_output_spec", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 1080 WHEN page_id % 4 = 2 THEN 1080 ELSE 1920 END AS width, CASE WHEN page_id % 4 = 0 THEN 1920 WHEN page_id % 4 = 2 THEN 1440 ELSE 1080 END AS height, CASE WHEN page_id % 4 IN (0, 2) THEN 'portrait' ELSE 'landscape' END AS orientation FROM path")
def p21(v):
    choice = F.when(F.col("page_id") % 4 == 2, " 1080×1440 ").when(F.col("page_id") % 4 == 3, "huge").otherwise("1920x1080")
    choice = F.replace(F.lower(F.trim(choice)), F.lit("×"), F.lit("x"))
    # The output sizes on offer; the first is the default.
    sizes = {"1920x1080": (1920, 1080), "1080x1440": (1080, 1440), "1080x1920": (1080, 1920)}
    rows = v.path.withColumn("c", F.when(F.col("page_id") % 4 == 0, "1080x1920").otherwise(F.when(choice.isin(*sizes), choice).otherwise("1920x1080")))
    w, h = lb.looked_up(F.col("c"), {k: x[0] for k, x in sizes.items()}), lb.looked_up(F.col("c"), {k: x[1] for k, x in sizes.items()})
    return rows.select("page_id", w.alias("width"), h.alias("height"), F.when(h > w, "portrait").otherwise("landscape").alias("orientation"))


@query("P25_chorus_at_least", "SELECT media_id, seg_index FROM seg WHERE label = 'purchase' AND end_s - start_s >= 30")
def p25(v):
    return v.seg.where((F.col("label") == "purchase") & (F.col("end_s") - F.col("start_s") >= 30)).select("media_id", "seg_index")


REFINED = "CASE WHEN click > 0.5 AND label IN ('error', 'signup') THEN 'verse' WHEN label = 'purchase' AND view > 0.65 AND click < 0.45 THEN 'talk' WHEN view > 0.75 AND click < 0.25 THEN 'talk' ELSE label END"


def ratio_rows(v):
    return iv.overlap_ratio(v.part, v.act, M, ["seg_index", "label", "confidence"], ["click", "view"])


@query("J10_refine_labels_by_activity", f"WITH r AS ({RATIO.format(extra='s.label, s.confidence,')}) SELECT media_id, seg_index, {REFINED} AS label, least(1.0, confidence + CASE WHEN click > 0.5 AND label IN ('error', 'signup') THEN 0.3 WHEN {REFINED} = 'talk' THEN 0.1 ELSE 0 END) AS confidence FROM r", "confidence")
def j10(v):
    found = lb.refined_by_activity(F.col("label"), F.col("confidence"), F.col("click"), F.col("view"), intro="purchase", spoken=("error", "signup"))
    return ratio_rows(v).select("media_id", "seg_index", found.alias("x")).select("media_id", "seg_index", "x.*")


@query("J11_upgrade_by_region_overlap", f"""WITH {TOTALS}, {merged_sql('m', 'act')}, cr AS (SELECT t.media_id, coalesce(sum(m.end_s - m.start_s), 0.0) / any_value(t.total_s) AS ratio FROM totals t LEFT JOIN m USING (media_id) GROUP BY t.media_id),
    o AS (SELECT s.media_id, s.seg_index, max(greatest(0.0, least(s.end_s, b.end_s) - greatest(s.start_s, b.start_s)) / (s.end_s - s.start_s)) FILTER (b.act_id IS NOT NULL) AS share FROM part_ s LEFT JOIN act b ON s.media_id = b.media_id AND s.start_s < b.end_s AND s.end_s > b.start_s GROUP BY ALL)
    SELECT media_id, seg_index, CASE WHEN share > 0.5 AND share * confidence > 0.3 AND label IN ('error', 'signup') AND ratio <= 0.25 THEN 'chorus' ELSE label END AS label FROM o JOIN part_ USING (media_id, seg_index) JOIN cr USING (media_id)""")
def j11(v):
    return iv.upgrade_by_region_overlap(v.part, v.act, totals(v), M, ["seg_index"], ("error", "signup"), most=0.25).select("media_id", "seg_index", "label")


@query("A29_weighted_condition_score", "SELECT media_id, frame, CASE WHEN rms > 50 THEN 2.0 ELSE 0 END + CASE WHEN t < 1000 THEN 1.5 ELSE 0 END - CASE WHEN kind = 'error' THEN 3.0 ELSE 0 END AS score FROM tl", "score")
def a29(v):
    return v.tl.select("media_id", "frame", lb.weighted_condition_score([("rms > 50", 2), ("t < 1000", 1.5), ("kind = 'error'", -3)]).alias("score"))


@query("F19_feature_value", "SELECT media_id, frame, CASE WHEN frame % 2 = 0 THEN rms ELSE -1.0 END AS value FROM tl", "value")
def f19(v):
    features = F.when(F.col("frame") % 2 == 0, F.create_map(F.lit("rms"), F.col("rms"))).otherwise(F.create_map(F.lit("zcr"), F.col("t")))
    return v.tl.select("media_id", "frame", lb.feature_value(features, "rms", -1.0).alias("value"))


FLAGGED = """media_id, frame, rms, CAST(frame % 10 AS DOUBLE) / 10 AS voice_ratio, CAST(frame * 3 % 7 AS DOUBLE) / 7 AS beat_regularity, CAST(frame * 7 % 11 AS DOUBLE) AS zcr, CAST(5 AS DOUBLE) AS zcr_mean, CAST(frame * 5 % 9 AS DOUBLE) AS flatness, CAST(4 AS DOUBLE) AS flatness_mean,
    rms / 45 AS relative_energy, CAST(frame % 4 * 20 AS DOUBLE) AS song_rms_baseline, CAST(frame % 3 * 40 AS DOUBLE) AS song_rms_p85"""


@query("F25_feature_flags", f"WITH q AS (SELECT media_id, quantile_cont(rms, 0.5) AS rms_p50, quantile_cont(rms, 0.75) AS rms_p75 FROM tl GROUP BY media_id), f AS (SELECT {FLAGGED} FROM tl) SELECT media_id, frame, {', '.join(f'{x} AS {k}' for k, x in lb.FLAGS.items())} FROM f JOIN q USING (media_id)")
def f25(v):
    q = v.tl.groupBy("media_id").agg(F.percentile("rms", F.lit(0.5)).alias("rms_p50"), F.percentile("rms", F.lit(0.75)).alias("rms_p75"))
    return v.tl.selectExpr(*FLAGGED.replace("\n", " ").split(", ")).join(q, "media_id").select("media_id", "frame", *lb.feature_flags())


@query("A17_rebalance_over_predicted", """WITH k AS (SELECT *, CASE WHEN label IN ('click', 'view', 'purchase') THEN 'chorus' ELSE 'verse' END AS type FROM seg), c AS (SELECT *, count(*) OVER (PARTITION BY media_id, song_index) AS n, avg((type = 'chorus')::INT) OVER (PARTITION BY media_id, song_index) AS share FROM k)
    SELECT media_id, seg_index, CASE WHEN n >= 4 AND share >= 0.72 AND type = 'chorus' AND confidence < 0.45 THEN 'verse' ELSE type END AS type FROM c""")
def a17(v):
    rows = v.seg.withColumn("type", F.when(F.col("label").isin("click", "view", "purchase"), "chorus").otherwise("verse"))
    return rp.rebalance_over_predicted(rows, ["media_id", "song_index"], "type", F.col("confidence") < 0.45, "chorus", "verse").select("media_id", "seg_index", "type")


@query("A04_label_distribution", "SELECT media_id, label, count(*) AS n FROM seg GROUP BY ROLLUP (media_id, label)")
def a04(v):
    return rp.label_distribution(v.seg, "media_id", "label")


@query("A05_modification_rate", "SELECT lang, count(*) AS n, count(*) FILTER (is_modified) AS modified, avg(is_modified::INT) AS rate FROM lab GROUP BY lang", "rate")
def a05(v):
    return rp.modification_rate(v.lab, ["lang"], "is_modified")


@query("A06_error_patterns", 'SELECT "old", "new", count(*) AS n FROM lab WHERE is_modified GROUP BY GROUPING SETS (("old", "new"), ("new"), ())')
def a06(v):
    return rp.error_patterns(v.lab)


@query("A07_label_accuracy", 'SELECT "old", count(*) AS n, avg((NOT is_modified)::INT) AS accuracy FROM lab GROUP BY ROLLUP ("old")', "accuracy")
def a07(v):
    return rp.label_accuracy(v.lab)


@query("A08_acceptance_check", """WITH m AS (SELECT avg((NOT is_modified)::INT) FILTER (sample_id % 2 = 0) AS a, avg((NOT is_modified)::INT) FILTER (sample_id % 2 = 1) AS b, avg(("new" = 'solo')::INT) FILTER (sample_id % 2 = 0) AS c, avg(("new" = 'solo')::INT) FILTER (sample_id % 2 = 1) AS d, count(*) FILTER (is_modified AND sample_id % 2 = 1) AS g, count(*) FILTER (sample_id % 2 = 1) AS n FROM lab)
    SELECT concat_ws(',', CASE WHEN b < a - 0.05 THEN 'overall' END, CASE WHEN d < c - 0.1 THEN 'solo' END, CASE WHEN n > 0 AND g / n > 0.1 THEN 'degraded' END) AS reasons, NOT coalesce(b < a - 0.05 OR d < c - 0.1 OR g / n > 0.1, false) AS passed FROM m""")
def a08(v):
    half = lambda k: v.lab.where(F.col("sample_id") % 2 == k).agg(F.avg((~F.col("is_modified")).cast("double")).alias("overall"), F.avg((F.col("new") == "solo").cast("double")).alias("solo"), F.count_if("is_modified").alias("degraded"), F.count("*").alias("samples"))
    return rp.acceptance_check(half(0), half(1))


@query("A09_suggest_adjustments", """SELECT "old", "new", n, 'solo' AS threshold, 'lower' AS direction, 0.5::DOUBLE AS delta, 'high' AS priority FROM (SELECT "old", "new", count(*) AS n FROM lab WHERE is_modified GROUP BY ALL) WHERE n >= 2 AND "new" = 'solo'""")
def a09(v):
    return rp.suggest_adjustments(v.lab)


SOURCE = "CASE WHEN track_id < 2 THEN 'track' WHEN probe = 2 AND song % 2 = 0 THEN 'ocr' WHEN probe = 2 THEN 'merged' ELSE 'unknown' END"


def identified(v):
    ocr = F.when((F.col("probe") == 2) & (F.col("song") % 2 == 0), F.col("title")).when(F.col("probe") == 2, "another")
    track = F.when(F.col("track_id") < 2, F.col("track_id").cast("string"))
    return v.probe.withColumn("origin", rp.identification_source(F.col("title"), track, ocr, "unknown song"))


@query("A10_identification_report", f"SELECT origin, count(*) AS n, avg((origin <> 'unknown')::INT) AS identified FROM (SELECT {SOURCE} AS origin FROM probe) GROUP BY ROLLUP (origin)", "identified")
def a10(v):
    return rp.identification_report(identified(v), "origin")


@query("A30_unknown_rate", f"SELECT pos_weight, count(*) AS n, count(DISTINCT song) AS songs, avg((origin = 'unknown')::INT) AS unknown_rate FROM (SELECT *, {SOURCE} AS origin FROM probe) GROUP BY pos_weight", "unknown_rate")
def a30(v):
    return identified(v).groupBy("pos_weight").agg(F.count("*").alias("n"), F.countDistinct("song").alias("songs"), F.avg((F.col("origin") == "unknown").cast("double")).alias("unknown_rate"))


@query("A16_probe_vote", """WITH t AS (SELECT * REPLACE (CASE WHEN track_id >= 3 THEN track_id END AS track_id) FROM probe), p AS (SELECT *, CASE WHEN track_id IS NOT NULL THEN count(*) OVER (PARTITION BY song, track_id) ELSE 0 END AS k, pos_weight * (1 + least(confidence, 1.0)) AS score, probe = 1 AND (track_id IS NOT NULL OR confidence >= 0.82) AS sure FROM t),
    r AS (SELECT *, CASE WHEN sure THEN 2 WHEN k >= 2 THEN 1 ELSE 0 END AS rank FROM p), q AS (SELECT *, round(CASE WHEN rank = 1 THEN confidence * pos_weight ELSE score END, 9) AS val, CASE WHEN rank = 1 THEN k ELSE 0 END AS votes FROM r),
    o AS (SELECT *, lead(val) OVER w AS nxt, row_number() OVER w AS nr FROM q WINDOW w AS (PARTITION BY song ORDER BY rank DESC, votes DESC, val DESC, probe))
    SELECT song, probe, track_id, title, CASE WHEN rank = 0 AND (val - nxt) / val < 0.15 THEN confidence * 0.6 ELSE confidence END AS confidence, CASE rank WHEN 2 THEN 'first' WHEN 1 THEN 'track' ELSE 'score' END AS how FROM o WHERE nr = 1""", "confidence")
def a16(v):
    return rp.probe_vote(some_tracks(v), "song")


def some_tracks(v):
    """Probes of which two in five have a track."""
    return v.probe.withColumn("track_id", F.when(F.col("track_id") >= 3, F.col("track_id")))


@query("A16_vote_by_titles")
def a16_titles(v):
    rows = some_tracks(v)
    return rp.probe_vote(rows, "song", agreement=rp.title_agreement(rows, "song"))


EDITS = "edits AS (SELECT media_id, seg_index, start_s + 1.5 AS new_start_s, end_s + 2.0 AS new_end_s, CASE WHEN seg_index % 10 = 5 THEN 'solo' END AS new_label FROM seg WHERE seg_index % 5 = 0)"
EDITED = """edited AS (SELECT media_id, seg_index, coalesce(new_start_s, lag(new_end_s) OVER w, start_s) AS start_s, coalesce(new_end_s, lead(new_start_s) OVER w, end_s) AS end_s, coalesce(new_label, label) AS label, new_start_s IS NOT NULL AS modified FROM seg LEFT JOIN edits USING (media_id, seg_index) WINDOW w AS (PARTITION BY media_id ORDER BY start_s, seg_index))"""


def edited(v):
    edits = v.seg.where("seg_index % 5 = 0").select("media_id", "seg_index", (F.col("start_s") + 1.5).alias("new_start_s"), (F.col("end_s") + 2.0).alias("new_end_s"), F.when(F.col("seg_index") % 10 == 5, "solo").alias("new_label"))
    return rp.apply_edits(v.seg, edits, M, "seg_index")


@query("Q38_apply_edit", f"WITH {EDITS}, {EDITED} SELECT * FROM edited", "start_s end_s")
def q38(v):
    return edited(v)


@query("Q46_edit_cascade_metrics", f"WITH {EDITS}, {EDITED} SELECT * FROM (SELECT e.media_id, e.seg_index, e.start_s - s.start_s AS start_shift, e.end_s - s.end_s AS end_shift FROM edited e JOIN seg s USING (media_id, seg_index)) WHERE abs(start_shift) > 0.01 OR abs(end_shift) > 0.01", "start_shift end_shift")
def q46(v):
    return rp.edit_cascade_metrics(v.seg, edited(v), M, "seg_index")


@query("Q39_flatten_for_review", f"WITH {EDITS}, {EDITED} SELECT media_id, seg_index, e.start_s, e.end_s, s.label AS current_label, false AS modified, coalesce(s.confidence, 0.0) AS confidence FROM edited e JOIN seg s USING (media_id, seg_index)", "start_s end_s confidence")
def q39(v):
    first = v.seg.select("media_id", "seg_index", F.col("label").alias("current_label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return edited(v).select("media_id", "seg_index", "start_s", "end_s").join(first, ["media_id", "seg_index"]).withColumn("modified", F.lit(False))


@query("J17_merge_edits", f"WITH {EDITS} SELECT media_id, seg_index, coalesce(new_start_s, start_s) AS start_s, coalesce(new_end_s, end_s) AS end_s, coalesce(new_label, label) AS label FROM seg LEFT JOIN edits USING (media_id, seg_index)", "start_s end_s")
def j17(v):
    edits = v.seg.where("seg_index % 5 = 0").select("media_id", "seg_index", F.struct(F.lit(2).alias("at"), (F.col("start_s") + 1.5).alias("s"), (F.col("end_s") + 2.0).alias("e"), F.when(F.col("seg_index") % 10 == 5, "solo").alias("l")).alias("x"))
    older = edits.select("media_id", "seg_index", F.struct(F.lit(1).alias("at"), F.lit(0.0).alias("s"), F.lit(0.0).alias("e"), F.lit("older").alias("l")).alias("x"))
    last = edits.unionByName(older).groupBy("media_id", "seg_index").agg(F.max_by("x", "x.at").alias("x"))
    return v.seg.join(last, ["media_id", "seg_index"], "left").select("media_id", "seg_index", F.coalesce("x.s", "start_s").alias("start_s"), F.coalesce("x.e", "end_s").alias("end_s"), F.coalesce("x.l", "label").alias("label"))


@query("W15_renumber", "SELECT media_id, seg_index, row_number() OVER (PARTITION BY media_id ORDER BY start_s, seg_index) AS sequence, dense_rank() OVER (PARTITION BY media_id ORDER BY song_index) AS song, 'song_' || lpad(dense_rank() OVER (PARTITION BY media_id ORDER BY song_index)::VARCHAR, 2, '0') AS name FROM seg")
def w15(v):
    w = Window.partitionBy("media_id")
    song = F.dense_rank().over(w.orderBy("song_index")).cast("long")
    return v.seg.select("media_id", "seg_index", F.row_number().over(w.orderBy("start_s", "seg_index")).cast("long").alias("sequence"), song.alias("song"), F.format_string("song_%02d", song).alias("name"))


@query("Q45_top_k", "SELECT media_id, seg_index, confidence FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY confidence DESC, seg_index) AS nr FROM seg) WHERE nr <= 8")
def q45(v):
    nr = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("confidence"), "seg_index"))
    return v.seg.withColumn("nr", nr).where("nr <= 8").select("media_id", "seg_index", "confidence")


RUNS = "r AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY media_id ORDER BY start_s, seg_index) THEN 0 ELSE 1 END AS f FROM seg), g AS (SELECT *, sum(f) OVER (PARTITION BY media_id ORDER BY start_s, seg_index ROWS UNBOUNDED PRECEDING) AS island FROM r)"


@query("Q09_merge_same_label_runs", f"WITH {RUNS} SELECT media_id, label, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM g GROUP BY media_id, label, island", "start_s end_s")
def q09(v):
    w = Window.partitionBy("media_id").orderBy("start_s", "seg_index")
    runs = iv.islands(v.seg, M, ["start_s", "seg_index"], ~F.coalesce(F.col("label") == F.lag("label").over(w), F.lit(False)))
    return runs.groupBy("media_id", "label", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n")).drop("island")


T03 = "SELECT media_id, bucket, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY media_id, bucket ORDER BY n DESC, kind) AS nr FROM (SELECT media_id, floor(t / 720)::BIGINT AS bucket, kind, count(*) AS n FROM tl GROUP BY ALL)) WHERE nr <= 3"


@query("T03_tumbling_profile", T03)
def t03(v):
    counts = v.tl.groupBy("media_id", F.floor(F.col("t") / 720).alias("bucket"), "kind").agg(F.count("*").alias("n"))
    nr = F.row_number().over(Window.partitionBy("media_id", "bucket").orderBy(F.desc("n"), "kind"))
    return counts.withColumn("nr", nr).where("nr <= 3").drop("nr")


@query("T04_sliding_profile", "SELECT media_id, k AS bucket, count(*) AS n, avg(rms) AS mean FROM tl, LATERAL (SELECT unnest([floor(t / 360)::BIGINT - 1, floor(t / 360)::BIGINT]) AS k) GROUP BY ALL", "mean")
def t04(v):
    last = F.floor(F.col("t") / 360)
    return v.tl.select("media_id", "rms", F.explode(F.array(last - 1, last)).alias("bucket")).groupBy("media_id", "bucket").agg(F.count("*").alias("n"), F.avg("rms").alias("mean"))


@query("T05_session_regions", "WITH g AS (SELECT *, sum(CASE WHEN gap > 100 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t) AS gap FROM tl)) SELECT media_id, min(t) AS start_s, max(t) AS end_s, count(*) AS n FROM g GROUP BY media_id, island", "start_s end_s")
def t05(v):
    return fr.time_sessions(v.tl, M, "t", 100.0)
