"""Cut safety on the driver's tables: cuts of pairs of clips, repairs, and whole chains of both, which tests/test_cutsafety.py compares with a plain version."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuesheet.functions import labels as lb
from cuesheet.operators import cuts as ct
from cuesheet.operators import cutsafety as cs
from cuesheet.operators import snapping as sn
from cuesheet.plans.fold_queries import JOINED
from cuesheet.plans.registry import query
from cuesheet.plans.song_queries import SNAP
from cuesheet.plans.views import Views


def export_segments(v: Views):
    kind = lb.looked_up(F.col("label"), {"view": "主歌", "click": "副歌", "signup": "合唱", "purchase": "副歌", "error": "讲话串场"})
    return v.seg.select("media_id", "song_index", "seg_index", "start_s", "end_s", kind.alias("type"), (F.col("confidence") > 0.5).alias("is_highlight"))


def on_songs(rows):
    """Sentences and words belong to the song of their start."""
    return rows.withColumn("song_index", F.floor(F.col("start_s") / 720).cast("int"))


def normalized(v: Views, *steps: str):
    return cs.normalize_overlaps(export_segments(v), on_songs(v.sent), on_songs(v.word), ["media_id"], 8.0, 18.0, steps or cs.STEPS)


KINDS = "CASE label WHEN 'view' THEN '主歌' WHEN 'click' THEN '副歌' WHEN 'signup' THEN '合唱' WHEN 'purchase' THEN '副歌' ELSE '讲话串场' END"
#: clips with the next of their timeline, of one song; sentences and words with the song of their start
PAIRS = f"""c AS (SELECT media_id, song_index, seg_index, start_s, end_s, {KINDS} AS type, confidence > 0.5 AS hl, CASE label WHEN 'view' THEN 60 WHEN 'signup' THEN 90 WHEN 'error' THEN 40 ELSE 80 END + CASE WHEN confidence > 0.5 THEN 20 ELSE 0 END AS wt FROM seg),
    n AS (SELECT media_id, song_index, seg_index, start_s AS ls, end_s AS le, type, hl, wt, lead(song_index) OVER w AS rg, lead(seg_index) OVER w AS next_id, lead(start_s) OVER w AS rs, lead(end_s) OVER w AS re, lead(type) OVER w AS rtype, lead(hl) OVER w AS rhl, lead(wt) OVER w AS rwt FROM c WINDOW w AS (PARTITION BY media_id ORDER BY start_s, end_s, seg_index)),
    pr AS (SELECT * FROM n WHERE rg = song_index), sn AS (SELECT media_id, floor(start_s / 720)::INT AS song_index, start_s AS s, end_s AS e FROM sent WHERE end_s > start_s)"""
RATED = """SELECT {keys}, CASE WHEN x >= 8 AND y >= 8 AND x <= 18 * 1.10::DOUBLE AND y <= 18 * 1.10::DOUBLE THEN 0 ELSE 1 END AS rk, cost + abs(cut - ref) * 0.05::DOUBLE + CASE WHEN x < 8 THEN (8 - x) * 20 ELSE 0 END + CASE WHEN y < 8 THEN (8 - y) * 20 ELSE 0 END + CASE WHEN x > 18 * 1.10::DOUBLE THEN (x - 18) * 4 ELSE 0 END + CASE WHEN y > 18 * 1.10::DOUBLE THEN (y - 18) * 4 ELSE 0 END AS sc, abs(cut - ref) AS ds, cut
    FROM (SELECT *, cut - ls AS x, re - cut AS y FROM {rows}) WHERE x > 0.1 AND y > 0.1"""


@query("Q17_overlap_cut", f"""WITH {PAIRS}, o AS (SELECT *, greatest(ls, rs) AS a, least(le, re) AS b, (greatest(ls, rs) + least(le, re)) / 2 AS ref FROM pr WHERE le - rs > 0.3),
    g AS (SELECT * FROM (SELECT media_id, song_index, e AS s, lead(s) OVER (PARTITION BY media_id, song_index ORDER BY s, e) AS e FROM sn) WHERE e > s),
    k AS (SELECT o.*, (greatest(g.s, a) + least(g.e, b)) / 2 AS cut, 0.0::DOUBLE AS cost FROM o JOIN g USING (media_id, song_index) WHERE a < g.e + 1e-9 AND b > g.s - 1e-9
      UNION ALL SELECT o.*, unnest([sn.s, sn.e]), 1.0 FROM o JOIN sn USING (media_id, song_index) WHERE a < sn.e + 1e-9 AND b > sn.s - 1e-9
      UNION ALL SELECT o.*, CASE WHEN least(sn.e, le) - greatest(sn.s, ls) >= least(sn.e, re) - greatest(sn.s, rs) THEN sn.e ELSE sn.s END, 2.0 FROM o JOIN sn USING (media_id, song_index) WHERE least(sn.e, le) - greatest(sn.s, ls) > 0 AND least(sn.e, re) - greatest(sn.s, rs) > 0),
    l AS (SELECT * FROM k WHERE cost <> 1 OR cut BETWEEN a AND b), u AS (SELECT media_id, seg_index, bool_or(cut - ls > 0.1 AND re - cut > 0.1) AS usable FROM l GROUP BY ALL), i AS (SELECT DISTINCT o.media_id, o.seg_index FROM o JOIN sn USING (media_id, song_index) WHERE sn.s + 0.05 < ref AND ref < sn.e - 0.05),
    z AS (SELECT * FROM l UNION ALL SELECT o.*, ref, CASE WHEN u.usable AND i.seg_index IS NOT NULL THEN 500.0 ELSE 5.0 END FROM o LEFT JOIN u USING (media_id, seg_index) LEFT JOIN i USING (media_id, seg_index)),
    r AS ({RATED.format(keys='media_id, seg_index', rows='z')}), f AS (SELECT *, row_number() OVER (PARTITION BY media_id, seg_index ORDER BY rk, sc, ds, cut) AS nr FROM r)
    SELECT o.media_id, o.seg_index, o.next_id, round(coalesce(f.cut, o.ref) + 1e-9, 3) AS cut FROM o LEFT JOIN f ON f.media_id = o.media_id AND f.seg_index = o.seg_index AND f.nr = 1""", "cut")
def q17(v):
    return ct.overlap_cuts(export_segments(v), on_songs(v.sent), ["media_id"], "seg_index", 8.0, 18.0)


TOUCHING = "tl2 AS (SELECT media_id, song_index, seg_index, ls, re, next_id, (le + rs) / 2 AS ref FROM pr WHERE abs(rs - le) <= 0.5)"


def touching(v):
    """Clips whose overlaps are parted already, so that neighbours share a boundary: each ends where the next begins."""
    rows = export_segments(v)
    w = Window.partitionBy("media_id").orderBy("start_s", "end_s", "seg_index")
    return rows.withColumn("end_s", F.coalesce(F.lead("start_s").over(w), F.col("end_s")))


PARTED = PAIRS.replace("start_s, end_s, CASE label WHEN 'view' THEN '主歌'", "start_s, coalesce(lead(start_s) OVER (PARTITION BY media_id ORDER BY start_s, end_s, seg_index), end_s) AS end_s, CASE label WHEN 'view' THEN '主歌'", 1)


@query("Q18_adjacent_cut", f"""WITH {PARTED}, {TOUCHING}, h AS (SELECT b.*, s.s, s.e FROM (SELECT t.*, (SELECT min({{'s': sn.s, 'e': sn.e}}) FROM sn WHERE sn.media_id = t.media_id AND sn.song_index = t.song_index AND sn.s + 0.05 < t.ref AND t.ref < sn.e - 0.05) AS q FROM tl2 t) b, LATERAL (SELECT q.s AS s, q.e AS e) s WHERE q IS NOT NULL),
    wd AS (SELECT media_id, floor(start_s / 720)::INT AS song_index, start_s AS a, end_s AS b, greatest(1, length(regexp_replace(word, '\\s', '', 'g'))) AS u FROM word),
    d AS (SELECT h.media_id, h.seg_index, sum(CASE WHEN ref >= b THEN u WHEN ref <= a THEN 0 ELSE least(u, floor(u * ((ref - a) / greatest(0.05::DOUBLE, b - a)) + 0.5)) END) AS done, sum(u) AS total FROM h JOIN wd ON wd.media_id = h.media_id AND wd.song_index = h.song_index AND h.s < wd.b AND h.e > wd.a GROUP BY ALL),
    p AS (SELECT h.*, CASE WHEN total > 0 THEN done / total >= 0.6 AND (done > 3 OR e - ref <= 0.45) OR e - ref <= 0.45 AND done / total >= 0.5 ELSE (ref - s) / (e - s) >= 0.55 OR e - ref <= 0.45 END AS before FROM h LEFT JOIN d USING (media_id, seg_index)),
    z AS (SELECT *, e AS cut, CASE WHEN before THEN 0.0 ELSE 3.0 END::DOUBLE AS cost FROM p UNION ALL SELECT *, s, CASE WHEN before THEN 3.5 ELSE 0.0 END FROM p),
    r AS ({RATED.format(keys='media_id, seg_index, next_id, ref', rows='z')}), f AS (SELECT *, row_number() OVER (PARTITION BY media_id, seg_index ORDER BY rk, sc, ds, cut) AS nr FROM r)
    SELECT media_id, seg_index, next_id, ref AS t, round(cut + 1e-9, 3) AS cut FROM f WHERE nr = 1 AND abs(cut - ref) > 0.05""", "t cut")
def q18(v):
    return ct.adjacent_cuts(touching(v), on_songs(v.sent), on_songs(v.word), ["media_id"], "seg_index", 8.0, 18.0)


def ending(v):
    """Clips that end 0.02 s before the end of a sentence of their song, one after the other."""
    w = Window.partitionBy("media_id", "song_index").orderBy("start_s", "pos")
    rows = on_songs(v.sent).withColumn("_before", F.lag("end_s").over(w))
    return rows.select("media_id", "song_index", F.col("pos").alias("seg_index"), F.coalesce(F.col("_before") - 0.02, F.col("start_s")).alias("start_s"), (F.col("end_s") - 0.02).alias("end_s"))


@query("Q23_protect_boundaries", f"""WITH sn AS (SELECT media_id, floor(start_s / 720)::INT AS song_index, pos, start_s AS s, end_s AS e FROM sent), c AS (SELECT media_id, song_index, pos AS seg_index, coalesce(lag(e) OVER (PARTITION BY media_id, song_index ORDER BY s, pos) - 0.02::DOUBLE, s) AS start_s, e - 0.02::DOUBLE AS end_s FROM sn),
    n AS (SELECT media_id, song_index, seg_index, start_s AS ls, end_s AS le, lead(song_index) OVER w AS rg, lead(seg_index) OVER w AS next_id, lead(start_s) OVER w AS rs, lead(end_s) OVER w AS re FROM c WINDOW w AS (PARTITION BY media_id ORDER BY start_s, end_s, seg_index)),
    t AS (SELECT *, (le + rs) / 2 AS ref FROM n WHERE rg = song_index AND abs(rs - le) <= 0.5), q AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.media_id = t.media_id AND sn.song_index = t.song_index AND sn.s + 0.05 < t.ref AND t.ref < sn.e - 0.05)),
    m AS (SELECT q.*, (SELECT sn.e FROM sn WHERE sn.media_id = q.media_id AND sn.song_index = q.song_index AND sn.e > sn.s AND abs(sn.e - q.ref) <= 0.12 ORDER BY abs(sn.e - q.ref), sn.e LIMIT 1) AS e FROM q),
    x AS (SELECT m.*, (SELECT min(sn.s) FROM sn WHERE sn.media_id = m.media_id AND sn.song_index = m.song_index AND sn.e > sn.s AND sn.s > m.e + 0.05) AS nx FROM m WHERE e IS NOT NULL),
    z AS (SELECT *, 0.5::DOUBLE AS cost FROM (SELECT *, least(e + 0.35::DOUBLE, greatest(e, coalesce(nx - 0.05::DOUBLE, e + 0.35::DOUBLE))) AS cut FROM x) WHERE cut > ref + 0.05),
    r AS ({RATED.format(keys='media_id, seg_index, next_id, ref', rows='z')}) SELECT media_id, seg_index, next_id, ref AS t, round(cut + 1e-9, 3) AS cut FROM r""", "t cut")
def q23(v):
    return ct.padded_cuts(ending(v), on_songs(v.sent), ["media_id"], "seg_index", 8.0, 18.0)


@query("Q28_fill_covered_gaps", f"""WITH {PAIRS}, g AS (SELECT *, rs - le AS size FROM pr WHERE rs - le > 0.5), k AS (SELECT g.media_id, g.seg_index, sum(greatest(0.0, least(rs, sn.e) - greatest(le, sn.s))) AS sung FROM g JOIN sn USING (media_id, song_index) WHERE le < sn.e AND rs > sn.s GROUP BY ALL),
    f AS (SELECT g.*, CASE WHEN wt >= rwt THEN type ELSE rtype END AS kind FROM g JOIN k USING (media_id, seg_index) WHERE sung >= greatest(0.5, least(2.0, size * 0.2))), h AS (SELECT *, greatest(1, floor((size + 18 - 0.05) / 18)) AS j FROM f),
    m AS (SELECT *, CASE WHEN size <= 18.05 THEN 1 ELSE j + CASE WHEN le + j * 18 < rs - 0.05 THEN 1 ELSE 0 END END::INT AS n FROM h), p AS (SELECT *, unnest(range(0, n))::INT AS part FROM m)
    SELECT media_id, song_index, seg_index, kind AS type, hl OR rhl AS is_highlight, part, round(le + size / n * part + 1e-9, 3) AS start_s, round(CASE WHEN part = n - 1 THEN rs ELSE le + size / n * (part + 1) END + 1e-9, 3) AS end_s FROM p""", "start_s end_s")
def q28(v):
    rows = export_segments(v)
    return ct.covered_gap_fills(rows, on_songs(v.sent), ["media_id"], "seg_index", lb.type_priority(F.col("type"), F.col("is_highlight")), 18.0)


@query("Q32_deoverlap_aligned", f"""WITH sp AS (SELECT * FROM ({SNAP})), c AS (SELECT media_id, song_index, seg_index, sp.start_s AS start_s, sp.end_s AS end_s, seg.start_s AS os, seg.end_s AS oe FROM sp JOIN seg USING (media_id, seg_index)), sn AS (SELECT media_id, floor(start_s / 720)::INT AS song_index, start_s AS s, end_s AS e FROM sent WHERE end_s > start_s),
    n AS (SELECT media_id, song_index, seg_index, start_s AS ls, end_s AS le, oe AS we, lead(song_index) OVER w AS rg, lead(seg_index) OVER w AS next_id, lead(start_s) OVER w AS rs, lead(end_s) OVER w AS re, lead(os) OVER w AS ws FROM c WINDOW w AS (PARTITION BY media_id ORDER BY start_s, end_s, seg_index)),
    o AS (SELECT * FROM n WHERE rg = song_index AND le - rs > 0.05), h AS (SELECT o.media_id, o.seg_index, min({{'s': s, 'e': e}}) AS a, max({{'s': s, 'e': e}}) AS b FROM o JOIN sn USING (media_id, song_index) WHERE least(e, le) - greatest(s, ls) > 0 AND least(e, re) - greatest(s, rs) > 0 GROUP BY ALL),
    g AS (SELECT media_id, seg_index, list(x) AS xs FROM (SELECT o.media_id, o.seg_index, rs, le, unnest([s, e]) AS x FROM o JOIN sn USING (media_id, song_index) WHERE s <= le + 0.05 AND e >= rs - 0.05) WHERE x BETWEEN rs - 0.05::DOUBLE AND le + 0.05::DOUBLE GROUP BY ALL),
    k AS (SELECT o.*, round(unnest(CASE WHEN h.a IS NOT NULL THEN [h.a.s, h.b.e] WHEN g.xs IS NOT NULL THEN g.xs ELSE [greatest(rs, least(le, (we + ws) / 2))] END) + 1e-9, 6) AS cut FROM o LEFT JOIN h USING (media_id, seg_index) LEFT JOIN g USING (media_id, seg_index)),
    z AS (SELECT *, round(abs(we - cut) + abs(ws - cut) + CASE WHEN cut - ls < 4 THEN (4 - (cut - ls)) * 100 ELSE 0 END + CASE WHEN re - cut < 4 THEN (4 - (re - cut)) * 100 ELSE 0 END, 6) AS cost FROM k WHERE cut - ls > 0.05 AND re - cut > 0.05)
    SELECT media_id, seg_index, next_id, cut FROM (SELECT *, row_number() OVER (PARTITION BY media_id, seg_index ORDER BY cost, cut) AS nr FROM z) WHERE nr = 1""", "cut")
def q32(v):
    snapped = sn.snap_to_sentences(v.seg, v.sent, ["media_id"])
    return ct.aligned_cuts(snapped, on_songs(v.sent), ["media_id"], "seg_index")


SAFE_PARTS = """WITH RECURSIVE pt AS (SELECT DISTINCT media_id, round(unnest([start_s, end_s]) + 1e-9, 3) AS t FROM sent), c AS (SELECT media_id, seg_index, start_s, end_s, label, confidence > 0.5 AS hl FROM seg), h AS (SELECT * FROM c WHERE NOT (end_s - start_s <= 60 OR hl AND end_s - start_s <= 60 * 1.1::DOUBLE)),
    b AS (SELECT h.*, coalesce((SELECT list(t) FROM pt WHERE pt.media_id = h.media_id AND t >= start_s - 1e-9 AND t <= end_s + 1e-9), []) AS ps FROM h), w AS (SELECT media_id, seg_index, label, end_s, ps, start_s AS a, start_s AS z, 0 AS k FROM b
      UNION ALL SELECT media_id, seg_index, label, end_s, ps, z, least(end_s, greatest(coalesce(list_min(list_transform(list_filter(ps, lambda p: p >= greatest(z + 20, least(z + 60, end_s) - 10) AND p <= least(least(z + 60, end_s) + 1.0, end_s)), lambda p: {'d': abs(p - least(z + 60, end_s)), 'p': p})).p, least(z + 60, end_s)), z + 20)), k + 1 FROM w WHERE z < end_s - 0.5)
    SELECT media_id, seg_index, label, a AS start_s, z AS end_s FROM w WHERE k > 0 UNION ALL SELECT media_id, seg_index, label, start_s, end_s FROM c WHERE end_s - start_s <= 60 OR hl AND end_s - start_s <= 60 * 1.1::DOUBLE"""


@query("Q14_split_at_safe_boundaries", f"SELECT media_id, s.a AS start_s, s.b AS end_s, s.l AS label, s.n AS n FROM ({JOINED.replace('FROM seg)', f'FROM ({SAFE_PARTS}))').replace('<= 120', '<= 60')})", "start_s end_s")
def q14(v):
    rows = v.seg.select("media_id", "seg_index", "start_s", "end_s", F.col("label").alias("type"), (F.col("confidence") > 0.5).alias("is_highlight"))
    points = v.sent.select("media_id", F.explode(F.array("start_s", "end_s")).alias("t")).select("media_id", F.round(F.col("t") + 1e-9, 3).alias("t"))
    return ct.split_at_safe_boundaries(rows, points, ["media_id"], "seg_index", 20.0, 60.0)


#: one timeline's clips as a list, and the number of the clip that is looked at
REPAIRED = f"""SELECT * FROM (WITH RECURSIVE c0 AS (SELECT media_id, song_index, seg_index, start_s, end_s, {KINDS} AS k, confidence > 0.5 AS h FROM seg WHERE end_s - start_s > 0.05), g AS (SELECT media_id, list({{'s': start_s, 'e': end_s, 'k': k, 'h': h, 'g': song_index, 'id': seg_index}} ORDER BY start_s, end_s, seg_index) AS c FROM c0 GROUP BY media_id),
    sn AS (SELECT media_id, list({{'g': floor(start_s / 720)::INT, 's': start_s, 'e': end_s}}) AS said FROM sent WHERE end_s > start_s GROUP BY media_id), w AS (SELECT media_id, c, 1::BIGINT AS i, coalesce(said, []) AS said, 0 AS step FROM g LEFT JOIN sn USING (media_id) UNION ALL
      SELECT media_id, CASE act WHEN 1 THEN c[:i - 1] || [{{'s': x.s, 'e': later, 'k': x.k, 'h': x.h, 'g': x.g, 'id': x.id}}, {{'s': later, 'e': b.e, 'k': b.k, 'h': b.h, 'g': b.g, 'id': b.id}}] || c[i + 2:] WHEN 2 THEN c[:i - 2] || [{{'s': a.s, 'e': earlier, 'k': a.k, 'h': a.h, 'g': a.g, 'id': a.id}}, {{'s': earlier, 'e': x.e, 'k': x.k, 'h': x.h, 'g': x.g, 'id': x.id}}] || c[i + 1:]
          WHEN 3 THEN c[:i - 2] || [{{'s': least(a.s, x.s), 'e': greatest(a.e, x.e), 'k': x.k, 'h': a.h OR x.h, 'g': a.g, 'id': a.id}}] || c[i + 1:] WHEN 4 THEN c[:i - 1] || [{{'s': least(x.s, b.s), 'e': greatest(x.e, b.e), 'k': x.k, 'h': x.h OR b.h, 'g': x.g, 'id': x.id}}] || c[i + 2:] WHEN 6 THEN c[:i - 1] || c[i + 1:] ELSE c END,
        CASE WHEN act IN (0, 5) THEN i + 1 WHEN act = 3 THEN greatest(1, i - 2) ELSE greatest(1, i - 1) END, said, step + 1 FROM
        (SELECT *, round(x.e + missing + 1e-9, 3) AS later, round(x.s - missing + 1e-9, 3) AS earlier, CASE WHEN missing <= 0.05 THEN 0 WHEN i < len(c) AND b.s - x.e <= 0.3 AND b.e - b.s - missing >= 8 THEN 1 WHEN i > 1 AND x.s - a.e <= 0.3 AND a.e - a.s - missing >= 8 THEN 2 WHEN i > 1 AND a.k = x.k AND a.g = x.g AND x.e - a.s <= 18.05 THEN 3
          WHEN i < len(c) AND b.k = x.k AND b.g = x.g AND b.e - x.s <= 18.05 THEN 4 WHEN coalesce(list_sum(list_transform(list_filter(said, lambda q: q.g = x.g), lambda q: greatest(0.0, least(x.e, q.e) - greatest(x.s, q.s)))), 0) >= 0.3 THEN 5 ELSE 6 END AS act FROM
          (SELECT *, c[i] AS x, CASE WHEN i > 1 THEN c[i - 1] END AS a, c[i + 1] AS b, 8 - (c[i].e - c[i].s) AS missing FROM w WHERE i <= len(c) AND (step > 0 OR len(c) > 1)))),
    o AS (SELECT media_id, unnest(arg_max(c, step)) AS z FROM w GROUP BY media_id) SELECT media_id, z.g AS song_index, z.id AS seg_index, z.s AS start_s, z.e AS end_s, z.k AS type, z.h AS is_highlight, false AS filled FROM o)"""


@query("Q27_repair_short", REPAIRED, "start_s end_s")
def q27(v):
    return normalized(v, "repair")


@query("Q29_normalize_overlaps")
def q29(v):
    return normalized(v)


@query("Q44_build_export")
def q44(v):
    """Labels to types, highlights, over-predicted types taken back, then cut safety."""
    from cuesheet.operators.reports import rebalance_over_predicted

    rows = v.seg.withColumn("type", lb.export_type(lb.looked_up(F.col("label"), {"view": "verse", "click": "bridge", "signup": "crowd", "purchase": "chorus", "error": "silence"}))).where("type is not null")
    rows = rebalance_over_predicted(rows, ["media_id", "song_index"], "type", F.col("confidence") < 0.45, "副歌", "主歌")
    rows = rows.withColumn("is_highlight", lb.is_highlight(F.lit(None).cast("string"), F.col("type"), F.col("confidence"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")))
    return cs.normalize_overlaps(rows, on_songs(v.sent), None, ["media_id"], 8.0, 18.0)
