"""Interval operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import intervals as iv
from cuesheet.plans.registry import query

M = ["media_id"]
SONG = ["media_id", "song_index"]
OVERLAP = "greatest(0.0, least(s.end_s, b.end_s) - greatest(s.start_s, b.start_s))"
TOTALS = "totals AS (SELECT media_id, max(end_s) AS total_s FROM seg GROUP BY media_id)"


def totals(v):
    return v.seg.groupBy("media_id").agg(F.max("end_s").alias("total_s"))


def merged_sql(name, source, gap=0.0, keys="media_id"):
    return f"""{name}_a AS (SELECT *, max(end_s) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
    {name}_b AS (SELECT *, sum(CASE WHEN start_s > reach + {gap} OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM {name}_a),
    {name} AS (SELECT {keys}, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM {name}_b GROUP BY {keys}, island)"""


@query("J01_interval_overlap_join", f"SELECT s.media_id, s.seg_index, b.act_id, {OVERLAP} AS overlap_s FROM part_ s JOIN act b ON s.media_id = b.media_id AND s.start_s < b.end_s AND s.end_s > b.start_s", "overlap_s")
def j01(v):
    return iv.overlap_join(v.part, v.act, M).select("media_id", "seg_index", F.col("b_act_id").alias("act_id"), "overlap_s")


@query("J02_segment_subtitles", "SELECT s.media_id, s.seg_index, b.pos, b.start_s < s.start_s - 0.05 AS truncated_start, b.end_s > s.end_s + 0.05 AS truncated_end FROM seg s JOIN sent b ON s.media_id = b.media_id AND s.start_s < b.end_s AND s.end_s > b.start_s")
def j02(v):
    return iv.segment_subtitles(v.seg, v.sent, M).select("media_id", "seg_index", F.col("b_pos").alias("pos"), "truncated_start", "truncated_end")


@query("J03_subtitle_cut_audit", "SELECT s.media_id, s.seg_index, b.pos, CASE WHEN b.start_s < s.start_s - 0.05 THEN 'start' ELSE 'end' END AS cut_type FROM seg s JOIN sent b ON s.media_id = b.media_id AND s.start_s < b.end_s AND s.end_s > b.start_s WHERE b.start_s < s.start_s - 0.05 OR b.end_s > s.end_s + 0.05")
def j03(v):
    return iv.subtitle_cut_audit(v.seg, v.sent, M).select("media_id", "seg_index", F.col("b_pos").alias("pos"), "cut_type")


@query("J04_covering_interval", "SELECT p.media_id, p.point_id, p.t, min(s.start_s) AS start_s, arg_min(s.end_s, s.start_s) AS end_s FROM bnd p JOIN sent s ON s.media_id = p.media_id AND s.start_s + 0.05 < p.t AND p.t < s.end_s - 0.05 GROUP BY ALL", "t start_s end_s")
def j04(v):
    return iv.covering_interval(v.bnd, v.sent, M, ["point_id"])


RATIO = "SELECT s.media_id, s.seg_index, {extra} coalesce(sum(" + OVERLAP + ") FILTER (b.event = 'click'), 0) / (s.end_s - s.start_s) AS click, coalesce(sum(" + OVERLAP + ") FILTER (b.event = 'view'), 0) / (s.end_s - s.start_s) AS view FROM part_ s LEFT JOIN act b ON s.media_id = b.media_id AND s.start_s < b.end_s AND s.end_s > b.start_s GROUP BY s.media_id, s.seg_index, s.start_s, s.end_s, s.label, s.confidence"


@query("J09_overlap_ratio", RATIO.format(extra=""), "click view")
def j09(v):
    return iv.overlap_ratio(v.part, v.act, M, ["seg_index"], ["click", "view"])


@query("Q01_merge_intervals", f"WITH {merged_sql('m', 'seg', 5.0)} SELECT * FROM m", "start_s end_s")
def q01(v):
    return iv.merge_intervals(v.seg, M, gap=5.0)


def from_points(source):
    return f"""WITH {TOTALS}, p AS (SELECT media_id, t FROM bnd {source} UNION SELECT media_id, 0.0 FROM totals UNION SELECT media_id, total_s FROM totals),
    l AS (SELECT media_id, t AS start_s, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS end_s FROM p), k AS (SELECT * FROM l WHERE end_s - start_s >= 60)
    SELECT * FROM k UNION ALL SELECT media_id, 0.0, total_s FROM totals WHERE media_id NOT IN (SELECT media_id FROM k)"""


@query("Q03_intervals_from_boundaries", from_points(""), "start_s end_s")
def q03(v):
    return iv.intervals_from_boundaries(v.bnd, totals(v), M)


@query("Q06_primary_source_boundaries", from_points("WHERE source = 'title'"), "start_s end_s")
def q06(v):
    return iv.primary_source_boundaries(v.bnd, totals(v), M)


@query("Q11_split_long", "SELECT media_id, seg_index, i::INT AS part, start_s + i * 30 AS start_s, least(end_s, start_s + i * 30 + 30) AS end_s FROM seg, LATERAL (SELECT unnest(range(0, greatest(1, ceil((end_s - start_s) / 30))::INT)) AS i)", "start_s end_s")
def q11(v):
    return iv.split_long(v.seg.select("media_id", "seg_index", "start_s", "end_s"), 30.0).select("media_id", "seg_index", "part", "start_s", "end_s")


@query("Q12_split_range", """WITH n AS (SELECT *, CASE WHEN end_s - start_s <= 18 + 1e-6 THEN 1 ELSE ceil((end_s - start_s) / 18)::INT END AS n FROM seg WHERE end_s > start_s),
    p AS (SELECT *, unnest(range(0, n))::INT AS part FROM n)
    SELECT media_id, seg_index, part, CASE WHEN n = 1 THEN start_s ELSE round(start_s + (end_s - start_s) * part / n + 1e-9, 3) END AS start_s, CASE WHEN part = n - 1 THEN end_s ELSE round(start_s + (end_s - start_s) * (part + 1) / n + 1e-9, 3) END AS end_s FROM p
    WHERE (CASE WHEN part = n - 1 THEN end_s ELSE round(start_s + (end_s - start_s) * (part + 1) / n + 1e-9, 3) END) - (CASE WHEN n = 1 THEN start_s ELSE round(start_s + (end_s - start_s) * part / n + 1e-9, 3) END) > 0.05""", "start_s end_s")
def q12(v):
    return iv.split_range(v.seg.select("media_id", "seg_index", "start_s", "end_s"), 8.0, 18.0)


@query("Q13_split_gap", """WITH g AS (SELECT *, end_s - start_s AS size FROM seg WHERE end_s - start_s > 0.05), h AS (SELECT *, greatest(1, floor((size + 15 - 0.05) / 15)) AS k FROM g),
    n AS (SELECT *, CASE WHEN size <= 15.05 THEN 1 ELSE k + CASE WHEN start_s + k * 15 < end_s - 0.05 THEN 1 ELSE 0 END END::INT AS n FROM h), p AS (SELECT *, unnest(range(0, n))::INT AS part FROM n)
    SELECT media_id, seg_index, part, round(start_s + size / n * part + 1e-9, 3) AS start_s, round(CASE WHEN part = n - 1 THEN end_s ELSE start_s + size / n * (part + 1) END + 1e-9, 3) AS end_s FROM p""", "start_s end_s")
def q13(v):
    return iv.split_gap(v.seg.select("media_id", "seg_index", "start_s", "end_s"), 15.0)


@query("Q26_complement_intervals", f"""WITH {TOTALS}, {merged_sql('m', 'part_')}, i AS (SELECT media_id, coalesce(lag(end_s) OVER (PARTITION BY media_id ORDER BY start_s), 0.0) AS start_s, start_s AS end_s FROM m)
    SELECT * FROM i WHERE end_s - start_s >= 5 UNION ALL SELECT * FROM (SELECT t.media_id, coalesce(max(m.end_s), 0.0) AS start_s, t.total_s AS end_s FROM totals t LEFT JOIN m USING (media_id) GROUP BY t.media_id, t.total_s) WHERE end_s - start_s >= 10""", "start_s end_s")
def q26(v):
    return iv.complement_intervals(v.part, totals(v), M)


@query("U04_timeline_except", f"""WITH {TOTALS}, {merged_sql('m', 'act')}, i AS (SELECT media_id, coalesce(lag(end_s) OVER (PARTITION BY media_id ORDER BY start_s), 0.0) AS start_s, start_s AS end_s FROM m)
    SELECT * FROM i WHERE end_s - start_s >= 0.001 UNION ALL SELECT * FROM (SELECT t.media_id, coalesce(max(m.end_s), 0.0) AS start_s, t.total_s AS end_s FROM totals t LEFT JOIN m USING (media_id) GROUP BY t.media_id, t.total_s) WHERE end_s - start_s >= 0.001""", "start_s end_s")
def u04(v):
    return iv.complement_intervals(v.act, totals(v), M, 0.001, 0.001)


@query("Q30_remaining_overlaps", "SELECT * FROM (SELECT media_id, seg_index, end_s, lead(start_s) OVER w AS next_start_s, end_s - lead(start_s) OVER w AS overlap_s FROM seg WINDOW w AS (PARTITION BY media_id ORDER BY start_s, end_s)) WHERE overlap_s > 0.3", "end_s next_start_s overlap_s")
def q30(v):
    return iv.remaining_overlaps(v.seg, M).select("media_id", "seg_index", "end_s", "next_start_s", "overlap_s")


def songs(v):
    return v.seg.groupBy(*SONG).agg(F.min("start_s").alias("song_start_s"), F.max("end_s").alias("song_end_s"))


SONGS = "songs AS (SELECT media_id, song_index, min(start_s) AS song_start_s, max(end_s) AS song_end_s FROM seg GROUP BY ALL)"
ITEMS = "items AS (SELECT media_id, (pos % 4)::INT AS song_index, pos, text, start_s, end_s FROM sent)"


def items(v):
    return v.sent.select("media_id", (F.col("pos") % 4).cast("int").alias("song_index"), "pos", "text", "start_s", "end_s")


@query("J16_song_dim_lookup", f"WITH {SONGS}, {ITEMS} SELECT media_id, song_index, pos, coalesce(song_start_s, 0.0) AS song_start_s FROM items LEFT JOIN songs USING (media_id, song_index)", "song_start_s")
def j16(v):
    return iv.song_starts(items(v), songs(v), SONG).select("media_id", "song_index", "pos", "song_start_s")


@query("P13_to_global_timeline", f"WITH {SONGS}, {ITEMS} SELECT media_id, song_index, pos, start_s + coalesce(song_start_s, 0.0) AS start_s, end_s + coalesce(song_start_s, 0.0) AS end_s FROM items LEFT JOIN songs USING (media_id, song_index) WHERE end_s > start_s AND trim(text) <> ''", "start_s end_s")
def p13(v):
    return iv.to_global_timeline(items(v), songs(v), SONG).select("media_id", "song_index", "pos", "start_s", "end_s")


@query("P14_clip_relative", "SELECT s.media_id, s.seg_index, b.pos, least(s.end_s - s.start_s, greatest(0.0, b.start_s - s.start_s)) AS start_s, least(s.end_s - s.start_s, greatest(0.0, b.end_s - s.start_s)) AS end_s FROM seg s JOIN sent b ON s.media_id = b.media_id AND s.start_s < b.end_s AND s.end_s > b.start_s", "start_s end_s")
def p14(v):
    return iv.clip_relative(v.sent, v.seg, M).select("media_id", "seg_index", F.col("b_pos").alias("pos"), F.col("b_start_s").alias("start_s"), F.col("b_end_s").alias("end_s"))


@query("P15_apply_offset", "SELECT media_id, pos, trim(text) AS text, round(greatest(0.0, start_s - 3.5) + 1e-9, 3) AS start_s, round(least(240.0, greatest(end_s - 3.5, greatest(0.0, start_s - 3.5) + 0.2)) + 1e-9, 3) AS end_s FROM sent WHERE end_s - 3.5 > 0 AND start_s - 3.5 < 240 AND trim(text) <> ''", "start_s end_s")
def p15(v):
    return iv.apply_offset(v.sent, 240.0, -3.5)


@query("P26_clip_to_song", "SELECT * FROM (SELECT media_id, seg_index, greatest(start_s, song_index * 720.0 + 30) AS start_s, least(end_s, song_index * 720.0 + 650) AS end_s FROM seg) WHERE end_s - start_s >= 8", "start_s end_s")
def p26(v):
    rows = v.seg.withColumns({"song_start_s": F.col("song_index") * 720.0 + 30, "song_end_s": F.col("song_index") * 720.0 + 650})
    return iv.clip_to_song(rows).select("media_id", "seg_index", "start_s", "end_s")


@query("P28_add_position_ratio", f"WITH {SONGS} SELECT media_id, seg_index, CASE WHEN song_end_s > song_start_s THEN (start_s - song_start_s) / (song_end_s - song_start_s) ELSE 0.5 END AS position_ratio FROM seg JOIN songs USING (media_id, song_index)", "position_ratio")
def p28(v):
    rows = v.seg.join(songs(v), SONG)
    return rows.select("media_id", "seg_index", iv.position_ratio(F.col("start_s"), F.col("song_start_s"), F.col("song_end_s")).alias("position_ratio"))


@query("A11_coverage_seconds", f"SELECT s.media_id, s.seg_index, coalesce(sum({OVERLAP}) FILTER (b.pos IS NOT NULL), 0.0) AS covered_s FROM seg s LEFT JOIN sent b ON s.media_id = b.media_id AND s.start_s < b.end_s AND s.end_s > b.start_s GROUP BY ALL", "covered_s")
def a11(v):
    return iv.coverage_seconds(v.seg, v.sent, M, ["seg_index"])


@query("A24_covered_ratio", f"WITH {TOTALS}, {merged_sql('m', 'act')} SELECT t.media_id, least(1.0, coalesce(sum(m.end_s - m.start_s), 0.0) / any_value(t.total_s)) AS ratio FROM totals t LEFT JOIN m USING (media_id) GROUP BY t.media_id", "ratio")
def a24(v):
    return iv.covered_ratio(v.act, totals(v), M)


@query("U01_union_sources", "SELECT media_id, t, 'title' AS source, 0.6 AS weight FROM bnd WHERE source = 'title' UNION ALL SELECT media_id, t, 'audio', 0.25 FROM bnd WHERE source = 'audio' UNION ALL SELECT media_id, t, 'structure', 0.15 FROM bnd WHERE source = 'structure'", "t")
def u01(v):
    parts = [v.bnd.where(F.col("source") == s).select("media_id", "t", F.lit(s).alias("source"), F.lit(w).alias("weight")) for s, w in (("title", 0.6), ("audio", 0.25), ("structure", 0.15))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("U02_distinct_points", f"WITH {TOTALS} SELECT media_id, round(t, 1) AS t FROM bnd UNION SELECT media_id, 0.0 FROM totals UNION SELECT media_id, round(total_s, 1) FROM totals", "t")
def u02(v):
    ends = totals(v).select("media_id", F.explode(F.array(F.lit(0.0), F.col("total_s"))).alias("t"))
    return v.bnd.select("media_id", "t").union(ends).select("media_id", F.round("t", 1).alias("t")).distinct()


@query("U03_safe_boundary_set", "SELECT media_id, round(start_s + 1e-9, 3) AS t FROM seg UNION SELECT media_id, round(end_s + 1e-9, 3) FROM seg UNION SELECT media_id, round(start_s + 1e-9, 3) FROM sent UNION SELECT media_id, round(end_s + 1e-9, 3) FROM sent", "t")
def u03(v):
    return iv.safe_boundary_set(v.seg, v.sent, M)


@query("U05_timeline_intersect", f"WITH {merged_sql('m', 'part_')}, {merged_sql('n', 'act')} SELECT m.media_id, greatest(m.start_s, n.start_s) AS start_s, least(m.end_s, n.end_s) AS end_s FROM m JOIN n ON m.media_id = n.media_id AND m.start_s < n.end_s AND m.end_s > n.start_s", "start_s end_s")
def u05(v):
    return iv.timeline_intersect(v.part, v.act, M)
