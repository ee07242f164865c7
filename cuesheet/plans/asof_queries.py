"""As-of operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import asof
from cuesheet.plans.registry import query

M = ["media_id"]


def edges(v):
    return v.sent.select("media_id", F.explode(F.array("start_s", "end_s")).alias("t")).select("media_id", F.round("t", 3).alias("t"))


EDGES = "edges AS (SELECT media_id, round(start_s, 3) AS t FROM sent UNION ALL SELECT media_id, round(end_s, 3) FROM sent)"


@query("J05_asof_nearest", f"""WITH {EDGES}, n AS (SELECT p.media_id, p.point_id, p.t, (SELECT e.t FROM edges e WHERE e.media_id = p.media_id ORDER BY abs(e.t - p.t), e.t LIMIT 1) AS near FROM bnd p)
    SELECT media_id, point_id, t, CASE WHEN abs(near - t) <= 3 THEN near ELSE t END AS snapped_t FROM n""", "t snapped_t")
def j05(v):
    return asof.asof_nearest(v.bnd.drop("source"), edges(v), M, 3.0).select("media_id", "point_id", "t", "snapped_t")


@query("J06_asof_backward", "SELECT media_id, point_id, p.t, (SELECT max(round(s.end_s, 3)) FROM sent s WHERE s.media_id = p.media_id AND round(s.end_s, 3) <= p.t AND p.t - round(s.end_s, 3) <= 2.5) AS ref_t FROM bnd p", "t ref_t")
def j06(v):
    return asof.asof_backward(v.bnd.drop("source"), v.sent.select("media_id", F.round("end_s", 3).alias("t")), M, 2.5).select("media_id", "point_id", "t", "ref_t")


@query("J07_asof_forward", "SELECT media_id, point_id, p.t, (SELECT min(round(s.start_s, 3)) FROM sent s WHERE s.media_id = p.media_id AND round(s.start_s, 3) > p.t) AS ref_t FROM bnd p", "t ref_t")
def j07(v):
    return asof.asof_forward(v.bnd.drop("source"), v.sent.select("media_id", F.round("start_s", 3).alias("t")), M).select("media_id", "point_id", "t", "ref_t")


@query("J08_lookup_with_tolerance", """WITH k AS (SELECT media_id, round(t + 1e-9, 1) AS t, max(rms) AS score FROM tl WHERE kind = 'click' GROUP BY ALL),
    p AS (SELECT media_id, point_id, t, round(t + 1e-9, 1) AS r FROM bnd), n AS (SELECT p.*, (SELECT k.t FROM k WHERE k.media_id = p.media_id ORDER BY round(abs(k.t - p.r), 6), k.t LIMIT 1) AS near FROM p)
    SELECT n.media_id, n.point_id, n.t, CASE WHEN abs(n.near - n.r) <= 5 + 1e-9 THEN k.score ELSE 0.0 END AS score FROM n LEFT JOIN k ON k.media_id = n.media_id AND k.t = n.near""", "t score")
def j08(v):
    scores = v.tl.where("kind = 'click'").select("media_id", "t", F.col("rms").alias("score"))
    return asof.lookup_with_tolerance(v.bnd.drop("source"), scores, M, 5.0).select("media_id", "point_id", "t", "score")


@query("W14_next_non_null_start", "SELECT * FROM (SELECT media_id, line, t, greatest(coalesce(first_value(t IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 300.0), t + 0.8) AS end_s FROM line) WHERE t IS NOT NULL", "t end_s")
def w14(v):
    return asof.next_non_null_start(v.line, M, ["line"], 300.0).select("media_id", "line", "t", "end_s")


#: the estimated length of a line
LINE_SECONDS = r"""greatest(0.9, least(4.5, 1.0 + 0.09::DOUBLE * length(regexp_replace(text, '[\s　、。！，．：；？（）—‘’"''…“”]', '', 'g'))))"""
FILLED = """WITH x AS (SELECT media_id, line, text, t, CASE WHEN line % 4 = 1 AND media_id % 7 <> 0 THEN 'confirmed' ELSE 'review' END AS status, CASE WHEN line % 4 = 1 THEN line * 3.3 + 2.0 WHEN line % 3 = 0 THEN line * 3.1 + 1.0 END::DOUBLE AS start_s, (line % 10) / 10.0::DOUBLE AS confidence FROM line),
    a AS (SELECT *, CASE WHEN t IS NOT NULL THEN {'o': line, 't': t} END AS tm, CASE WHEN status = 'confirmed' AND start_s IS NOT NULL AND t IS NOT NULL THEN {'own': t, 'placed': start_s, 'c': confidence} END AS an FROM x),
    b AS (SELECT *, last_value(tm IGNORE NULLS) OVER p AS p, first_value(tm IGNORE NULLS) OVER n AS n, last_value(an IGNORE NULLS) OVER p AS a, first_value(an IGNORE NULLS) OVER n AS b, first_value(an IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx,
      avg(an.c) OVER (PARTITION BY media_id ORDER BY line RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM a WINDOW p AS (PARTITION BY media_id ORDER BY line ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY media_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    c AS (SELECT *, coalesce(CASE WHEN p.o = n.o THEN p.t ELSE p.t + (n.t - p.t) * (line - p.o) / (n.o - p.o) END, p.t + 4.0 * (line - p.o), n.t - 4.0 * (n.o - line), line * 4.0)::DOUBLE AS own FROM b),
    d AS (SELECT *, coalesce(CASE WHEN abs(b.own - a.own) > 1e-6 THEN a.placed + greatest(0.0, least(1.0, (own - a.own) / (b.own - a.own))) * (b.placed - a.placed) END, a.placed + 1.1::DOUBLE * (own - a.own), b.placed - 1.1::DOUBLE * (b.own - own), own + 13.0)::DOUBLE AS predicted FROM c),
    e AS (SELECT *, greatest(0.0, coalesce(0.55::DOUBLE * predicted + (1 - 0.55::DOUBLE) * start_s, predicted)) AS s FROM d), f AS (SELECT *, s + {seconds} AS e0 FROM e),
    g AS (SELECT *, coalesce(CASE WHEN nx IS NOT NULL THEN least(e0, greatest(s + 0.35::DOUBLE, nx.placed - 0.05::DOUBLE)) END, e0) AS e1 FROM f)
    SELECT media_id, line, CASE WHEN status = 'confirmed' THEN start_s ELSE round(s + 1e-9, 3) END AS start_s, CASE WHEN status = 'confirmed' THEN start_s + 2 ELSE round(greatest(e1, s + 0.35::DOUBLE) + 1e-9, 3) END AS end_s,
      CASE WHEN status = 'confirmed' THEN confidence WHEN a IS NULL AND b IS NULL THEN 0.25 ELSE round(CASE WHEN near IS NULL THEN 0.32 ELSE greatest(0.26, least(0.62, 0.7::DOUBLE * near)) END + 1e-9, 4) END::DOUBLE AS confidence, CASE WHEN status = 'confirmed' THEN 'confirmed' ELSE 'interpolated' END AS status FROM g"""


@query("J15_anchor_interpolate", FILLED.replace("{seconds}", LINE_SECONDS), "start_s end_s confidence")
def j15(v):
    status = F.when((F.col("line") % 4 == 1) & (F.col("media_id") % 7 != 0), "confirmed").otherwise("review")
    start = F.when(F.col("line") % 4 == 1, F.col("line") * 3.3 + 2.0).when(F.col("line") % 3 == 0, F.col("line") * 3.1 + 1.0)
    rows = v.line.withColumns({"status": status, "start_s": start, "end_s": start + 2, "confidence": (F.col("line") % 10) / 10.0})
    return asof.fill_between_anchors(rows, M, "line", 1.1).select("media_id", "line", "start_s", "end_s", "confidence", "status")
