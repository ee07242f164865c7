"""Song operators on the driver's tables; those on difflib's similarity and k-means have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import snapping as sn
from cuesheet.operators import songs as so
from cuesheet.plans.registry import query


def songs(v):
    first = v.vec.withColumn("media", F.col("song"))
    other = v.vec.select("song", (F.col("frame") - 1).alias("frame"), F.col("v").alias("w"))
    rows = first.join(other, ["song", "frame"], "left")
    names = F.when(F.col("frame") % 3 == 0, "").when(F.col("frame") % 3 == 1, "Red Song").otherwise("red song (live)")
    return rows.select("media", "frame", names.alias("title"), F.when(F.col("frame") % 5 == 0, F.col("frame")).alias("track_id"), F.col("v").alias("head_sig"), F.coalesce("w", "v").alias("tail_sig"), (F.col("frame") % 200).cast("double").alias("size_s"), (F.col("frame") * 10.0).alias("start_s"), (F.col("frame") * 10.0 + 8).alias("end_s"), (F.col("frame") % 10 / 10).alias("confidence"))


@query("J22_best_catalog_match")
def j22(v):
    return so.best_catalog_match(v.title, v.table("part").select("p_partkey", "p_name"), "page_id", "title", "p_partkey", "p_name", 0.3)


@query("J20_best_line_window")
def j20(v):
    lines = v.probe.select("song", F.col("probe").alias("line"), F.col("title").alias("text"))
    said = lines.groupBy("song").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "").alias("transcript"))
    return so.best_line_window(lines, said, ["song"], 3)


@query("J23_adjacent_merge_score")
def j23(v):
    return so.adjacent_merge_score(songs(v), ["media"], "frame")


@query("Q40_merge_song_chain")
def q40(v):
    return so.merge_song_chain(songs(v), so.adjacent_merge_score(songs(v), ["media"], "frame"), ["media"], "frame")


@query("A23_cross_source_agreement")
def a23(v):
    return so.cross_source_agreement(v.probe.withColumn("source", F.col("probe").cast("string")), ["song"], "source", "title", "confidence")


@query("A27_dominant_cluster_label")
def a27(v):
    return so.dominant_cluster_label(v.vec.withColumn("energy", F.abs(F.element_at("v", 1))), "song", "v", "energy")


FIT = """WITH p AS (SELECT song, probe AS i, probe * 10.0 + track_id AS x, probe * 10.0 * (1 + track_id / 10.0) + confidence AS y, confidence AS w FROM probe),
    m AS (SELECT DISTINCT song, scale, round(ya - scale * xa, 6) AS off FROM (SELECT a.song, a.x AS xa, a.y AS ya, round((b.y - a.y) / (b.x - a.x), 6) AS scale FROM p a JOIN p b ON a.song = b.song AND b.x > a.x) WHERE scale BETWEEN 0.45 AND 1.85),
    f AS (SELECT m.song, m.scale, m.off, count(*) AS inliers, round(2 * count(*) + sum(w), 6) AS v FROM m JOIN p ON m.song = p.song AND abs(m.scale * p.x + m.off - p.y) <= 1.2 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY v DESC, round(-abs(scale - 1), 6) DESC, round(-abs(off), 6) DESC, -off DESC) AS nr FROM f), b AS (SELECT song, avg(y - x) AS mean FROM p GROUP BY song)
    SELECT b.song, coalesce(r.scale, 1.0)::DOUBLE AS scale, coalesce(r.off, b.mean)::DOUBLE AS "offset", coalesce(r.inliers, 0) AS inliers FROM b LEFT JOIN r ON r.song = b.song AND r.nr = 1"""


@query("Q33_fit_time_transform", FIT, 'scale "offset"')
def q33(v):
    x = F.col("probe") * 10.0 + F.col("track_id")
    y = F.col("probe") * 10.0 * (1 + F.col("track_id") / 10) + F.col("confidence")
    return so.fit_time_transform(v.probe.select("song", x.alias("x"), y.alias("y"), F.col("confidence").alias("w")), ["song"])


LABEL = "CASE label WHEN 'view' THEN 'verse' WHEN 'signup' THEN 'verse' WHEN 'purchase' THEN 'chorus' WHEN 'click' THEN 'prechorus' ELSE 'silence' END"
ONCE = "{name} AS (SELECT * REPLACE (CASE WHEN f AND seg_index = {pick}(CASE WHEN f THEN seg_index END) OVER (PARTITION BY media_id, song_index) THEN '{label}' ELSE label END AS label) FROM (SELECT *, coalesce(({fits}) AND max((label = '{label}')::INT) OVER (PARTITION BY media_id, song_index) = 0, false) AS f FROM {rows}))"
REMAP = f"""WITH a AS (SELECT media_id, song_index, seg_index, start_s, end_s, confidence AS energy, {LABEL} AS label FROM seg),
    q AS (SELECT media_id, song_index, min(start_s) AS s, max(end_s) AS e, quantile_cont(energy, 0.25) AS p25, quantile_cont(energy, 0.75) AS p75 FROM a GROUP BY ALL),
    b AS (SELECT a.*, p25, p75, (start_s - s) / (e - s) AS pos, (end_s - s) / (e - s) AS upto, false AS f FROM a JOIN q USING (media_id, song_index)),
    {ONCE.format(name='c1', rows='(SELECT * EXCLUDE (f) FROM b)', pick='min', label='intro', fits="label = 'verse' AND pos < 0.05 AND end_s - start_s < 30")},
    {ONCE.format(name='c2', rows='(SELECT * EXCLUDE (f) FROM c1)', pick='max', label='outro', fits="label = 'verse' AND (upto > 0.92 OR upto > 0.85 AND energy < p25)")},
    d AS (SELECT *, sum((label = 'chorus')::INT) OVER (PARTITION BY media_id, song_index ORDER BY seg_index ROWS UNBOUNDED PRECEDING) AS nr FROM c2), g AS (SELECT * EXCLUDE (f), min(CASE WHEN nr = 2 AND label = 'chorus' THEN pos END) OVER (PARTITION BY media_id, song_index) AS second FROM d),
    {ONCE.format(name='c3', rows='g', pick='min', label='bridge', fits="label IN ('verse', 'intro') AND pos > second + 0.03 AND pos BETWEEN 0.15 AND 0.70 AND energy BETWEEN p25 AND p75 AND end_s - start_s < 45")},
    {ONCE.format(name='c4', rows='(SELECT * EXCLUDE (f) FROM c3)', pick='min', label='inst', fits="label IN ('verse', 'intro', 'prechorus') AND energy < p25 AND end_s - start_s >= 5")}
    SELECT media_id, song_index, seg_index, label FROM c4"""


@query("W16_structural_remap", REMAP)
def w16(v):
    names = F.when(F.col("label").isin("view", "signup"), "verse").when(F.col("label") == "purchase", "chorus").when(F.col("label") == "click", "prechorus").otherwise("silence")
    rows = v.seg.select("media_id", "song_index", "seg_index", "start_s", "end_s", F.col("confidence").alias("energy"), names.alias("label"))
    return so.structural_remap(rows, ["media_id", "song_index"], "seg_index")


SNAP = """WITH a AS (SELECT media_id, list({'s': start_s, 'e': end_s} ORDER BY start_s, end_s) AS x FROM sent GROUP BY media_id), g AS (SELECT seg.*, coalesce(x, []) AS x FROM seg LEFT JOIN a USING (media_id)),
    h AS (SELECT *, list_filter(x, lambda q: q.s + 0.05 < start_s AND start_s < q.e - 0.05)[1] AS hs, list_filter(x, lambda q: q.s + 0.05 < end_s AND end_s < q.e - 0.05)[1] AS he,
        list_min(list_transform(x, lambda q, i: {'d': abs(q.s - start_s), 'i': i, 'e': q.s})) AS ns, list_min(list_transform(x, lambda q, i: {'d': abs(q.e - end_s), 'i': i, 'e': q.e})) AS ne, list_max(list_transform(list_filter(x, lambda q: q.e <= end_s), lambda q: q.e)) AS sung FROM g),
    m AS (SELECT *, CASE WHEN abs(hs.s - start_s) <= 4 THEN hs.s WHEN ns.d <= 2 THEN ns.e ELSE start_s END AS a, CASE WHEN end_s - sung <= 2.15 THEN sung - 0.15 WHEN abs(he.e - end_s) <= 4 THEN he.e - 0.15 WHEN ne.d <= 2 THEN ne.e ELSE end_s END AS b FROM h),
    t AS (SELECT *, list_filter(x, lambda q: q.s <= b AND q.e >= a) AS k FROM m), c AS (SELECT *, CASE WHEN k[1].s < a AND a - k[1].s <= 4 THEN k[1].s ELSE a END AS a2, CASE WHEN k[-1].e > b AND k[-1].e - b <= 4 THEN k[-1].e ELSE b END AS b2 FROM t)
    SELECT media_id, seg_index, CASE WHEN b2 > a2 THEN a2 ELSE start_s END AS start_s, CASE WHEN b2 > a2 THEN b2 ELSE end_s END AS end_s FROM c"""


@query("Q31_snap_to_sentences", SNAP, "start_s end_s")
def q31(v):
    return sn.snap_to_sentences(v.seg, v.sent, ["media_id"]).select("media_id", "seg_index", "start_s", "end_s")


MARKS = "。！？、，；：,.;:!? "
SPLIT = f"""WITH RECURSIVE x AS (SELECT media_id, pos, trim(text) AS t, length(trim(text)) AS l, start_s, end_s FROM sent), y AS (SELECT *, CASE WHEN l <= 10 THEN 1 ELSE greatest(2, ceil(l / 8.0), ceil(l / 10.0))::INT END AS n FROM x WHERE l > 0),
    w AS (SELECT media_id, pos, t, l, n, start_s, end_s, 0 AS k, [0::BIGINT] AS cuts FROM y UNION ALL
      SELECT media_id, pos, t, l, n, start_s, end_s, k + 1, list_append(cuts, list_min(list_transform(range(greatest(cuts[-1] + 1, l - 10 * (n - k - 1), ceil(l * (k + 1) / n)::BIGINT - 2), least(cuts[-1] + 10, CASE WHEN k + 1 = n - 1 THEN l - 4 ELSE l - (n - k - 1) END, ceil(l * (k + 1) / n)::BIGINT + 2) + 1), lambda i: {{'c': abs(i - ceil(l * (k + 1) / n)) + CASE WHEN contains('{MARKS}', substr(t, i, 1)) THEN 0 ELSE 3 END, 'i': i}})).i) FROM w WHERE k < n - 1),
    d AS (SELECT media_id, pos, t, start_s, end_s, list_append(cuts, l) AS c FROM w WHERE k = n - 1), p AS (SELECT media_id, pos, start_s, end_s, list_filter(list_transform(range(1, len(c)), lambda i: trim(substr(t, c[i] + 1, c[i + 1] - c[i]))), lambda q: q <> '') AS parts FROM d),
    z AS (SELECT *, greatest(0.0, end_s - start_s) AS size, list_sum(list_transform(parts, lambda q: length(q))) AS total FROM p), s AS (SELECT *, list_transform(parts, lambda q: CASE WHEN size <= 0.12 THEN 0.06::DOUBLE ELSE greatest(0.06::DOUBLE, size * length(q) / total) END) AS share FROM z), e AS (SELECT *, unnest(range(0, len(parts)))::INT AS part FROM s)
    SELECT media_id, pos, part, parts[part + 1] AS text, least(end_s, start_s + coalesce(list_sum(share[1:part]), 0.0)) AS start_s, CASE WHEN part = len(parts) - 1 THEN end_s ELSE least(end_s, start_s + list_sum(share[1:part + 1])) END AS end_s FROM e"""


@query("Q21_split_subtitle", f"SELECT * FROM ({SPLIT})", "start_s end_s")
def q21(v):
    return sn.split_subtitles(v.sent)


@query("F07_title_score", r"""WITH x AS (SELECT page_id, trim(title) AS t, length(trim(title)) AS n, len(regexp_extract_all(title, '[a-zA-Z0-9]')) AS k FROM title)
    SELECT page_id, greatest(0.0, least(100.0, round(50 + CASE WHEN n BETWEEN 3 AND 15 THEN 20 WHEN n BETWEEN 16 AND 25 THEN 8 ELSE 0 END + CASE WHEN NOT regexp_matches(t, '[，。！？、；：""''【】《》()（）\[\].,!?;:\-]') THEN 8 ELSE 0 END + 5 + CASE WHEN regexp_matches(t, '^ *[A-Z][A-Za-z ]*$') THEN 8 ELSE 0 END
    - CASE WHEN n <= 2 OR n > 35 THEN 40 ELSE 0 END - CASE WHEN len(regexp_extract_all(t, '[，。！？!?;；]')) >= 2 THEN 25 ELSE 0 END - CASE WHEN t <> '' AND len(string_split_regex(t, '\s+')) >= 6 THEN least(25.0, 12.0 + 3 * (len(string_split_regex(t, '\s+')) - 6)) ELSE 0 END
    - CASE WHEN len(regexp_extract_all(t, '[@_:;/\&*#%$~^]')) > 2 THEN 20 ELSE 0 END - CASE WHEN n > 0 AND k < 2 THEN 30 ELSE 0 END - CASE WHEN len(list_filter(range(1, n - 1), lambda i: substr(t, i, 1) = substr(t, i + 1, 1) AND substr(t, i, 1) = substr(t, i + 2, 1))) > 0 THEN 22 ELSE 0 END, 1))) AS score FROM x""", "score")
def f07(v):
    return v.title.select("page_id", sn.title_score(F.col("title")).alias("score"))
