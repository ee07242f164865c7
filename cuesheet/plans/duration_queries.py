"""Legal lengths of segments on the driver's tables; the SQL repairs each timeline as one sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import durations as du
from cuesheet.plans.registry import query

M = ["media_id"]
LEAST, MOST = 20, 60


def parts(rows: str, columns: str) -> str:
    return f"""SELECT {columns}, CASE WHEN n = 1 THEN a ELSE round(a + (b - a) * part / n + 1e-9, 3) END AS a, CASE WHEN part = n - 1 THEN b ELSE round(a + (b - a) * (part + 1) / n + 1e-9, 3) END AS b, part FROM
      (SELECT *, unnest(range(0, n))::INT AS part FROM (SELECT *, CASE WHEN b - a <= {MOST} + 1e-6 THEN 1 ELSE ceil((b - a) / {MOST})::INT END AS n FROM {rows} WHERE b > a))"""


REPAIRED = f"""WITH RECURSIVE s0 AS (SELECT media_id, seg_index, label AS t, confidence > 0.5 AS h, start_s AS a, end_s AS b FROM seg), s1 AS (SELECT * FROM ({parts('s0', 'media_id, seg_index, t, h')}) WHERE b - a > 0.05),
    i AS MATERIALIZED (SELECT media_id, row_number() OVER w AS nr, a, b, t, h, lead(a) OVER w AS na, lead(b) OVER w AS nb, lead(t) OVER w AS nt FROM s1 WINDOW w AS (PARTITION BY media_id ORDER BY a, b, t, seg_index, part)),
    w AS (SELECT media_id, 0::BIGINT AS nr, []::STRUCT(a DOUBLE, b DOUBLE, t VARCHAR, h BOOLEAN)[] AS acc, NULL::DOUBLE AS cs, false AS ch FROM i WHERE nr = 1 UNION ALL
      SELECT media_id, nr, CASE act WHEN 0 THEN list_append(acc, {{'a': ca, 'b': b, 't': t, 'h': hh}}) WHEN 1 THEN list_append(acc[:-2], {{'a': l.a, 'b': greatest(l.b, b), 't': l.t, 'h': l.h OR hh}}) ELSE acc END, CASE WHEN act = 2 THEN ca END, act = 2 AND hh FROM
        (SELECT *, CASE WHEN b - ca >= {LEAST} - 1e-6 THEN 0 WHEN like_last AND b - l.a <= {MOST} + 1e-6 THEN 1 WHEN NOT like_last AND like_next AND nb - ca <= {MOST} + 1e-6 THEN 2
          WHEN len(acc) > 0 AND ca - l.b <= 2.5 AND b - l.a <= {MOST} + 1e-6 AND b - l.a >= {LEAST} * 0.8::DOUBLE THEN 1 WHEN na IS NOT NULL AND na - b <= 2.5 AND nb - ca <= {MOST} + 1e-6 AND nb - ca >= {LEAST} * 0.8::DOUBLE THEN 2 ELSE 3 END AS act FROM
          (SELECT *, len(acc) > 0 AND coalesce(l.t = t AND ca - l.b <= 2, false) AS like_last, coalesce(nt = t AND na - b <= 2, false) AS like_next FROM
            (SELECT i.*, w.acc, w.acc[-1] AS l, least(coalesce(w.cs, i.a), i.a) AS ca, i.h OR w.ch AS hh FROM w JOIN i ON i.media_id = w.media_id AND i.nr = w.nr + 1)))),
    o AS (SELECT media_id, s.a AS a, s.b AS b, s.t AS t, s.h AS h FROM (SELECT media_id, unnest(arg_max(acc, nr)) AS s FROM w GROUP BY media_id))
    SELECT media_id, a AS start_s, b AS end_s, t AS type, h AS is_highlight FROM ({parts('o', 'media_id, t, h')}) WHERE b - a > 0.05 AND b - a >= {LEAST} - 1e-6"""


@query("Q15_enforce_durations", f"SELECT * FROM ({REPAIRED})", "start_s end_s")
def q15(v):
    rows = v.seg.select("media_id", "seg_index", "start_s", "end_s", F.col("label").alias("type"), (F.col("confidence") > 0.5).alias("is_highlight"))
    return du.enforce_durations(rows, M, "seg_index", float(LEAST), float(MOST))
