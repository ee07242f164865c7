"""Sequence folds on the driver's tables; their SQL folds lists in the same order."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import folds as fo
from cuesheet.operators import frames as fr
from cuesheet.plans.frame_queries import CHANGE
from cuesheet.plans.interval_queries import totals
from cuesheet.plans.registry import query

M = ["media_id"]


def walked(rows: str, keep: str, first: str = "true", keys: str = "media_id", order: str = "nr") -> str:
    """A recursive walk over `rows` (keys, nr from 1, columns as struct s), where `state` is the last kept struct."""
    return f"""WITH RECURSIVE i AS ({rows}), w AS (SELECT {keys}, nr, s AS state, {first} AS kept FROM i WHERE nr = 1
    UNION ALL SELECT i.{keys}, i.nr, CASE WHEN {keep} THEN i.s ELSE w.state END, {keep} FROM w JOIN i ON i.{keys} = w.{keys} AND i.nr = w.nr + 1)"""


POINTS = "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t) AS nr, {'t': t} AS s FROM bnd"


@query("Q02_min_spacing_filter", f"SELECT media_id, state.t AS t FROM ({walked(POINTS, 'i.s.t - w.state.t >= 60')} SELECT * FROM w) WHERE kept", "t")
def q02(v):
    return fo.min_spacing_filter(v.bnd, M, "t", 60.0, -60.0)


@query("T02_suppress_retries", f"SELECT cache_key, state.t AS t FROM ({walked('SELECT cache_key, row_number() OVER (PARTITION BY cache_key ORDER BY saved_at) AS nr, {0} AS s FROM ttl'.format(chr(123) + chr(39) + 't' + chr(39) + ': saved_at' + chr(125)), 'i.s.t - w.state.t >= 600', keys='cache_key')} SELECT * FROM w) WHERE kept", "t")
def t02(v):
    return fo.min_spacing_filter(v.ttl.select("cache_key", F.col("saved_at").alias("t")), ["cache_key"], "t", 600.0, -1e12)


BETTER = """WITH RECURSIVE i AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t, rms) AS nr, {'t': t, 'c': rms} AS s FROM tl WHERE kind = 'error'),
    w AS (SELECT media_id, nr, [s] AS acc FROM i WHERE nr = 1 UNION ALL
      SELECT i.media_id, i.nr, CASE WHEN i.s.t - w.acc[-1].t < 60 AND i.s.c > w.acc[-1].c THEN list_append(w.acc[:-2], i.s) WHEN i.s.t - w.acc[-1].t < 60 THEN w.acc ELSE list_append(w.acc, i.s) END FROM w JOIN i ON i.media_id = w.media_id AND i.nr = w.nr + 1)
    SELECT media_id, unnest(arg_max(acc, nr)) AS s FROM w GROUP BY media_id"""


@query("Q05_suppress_close_candidates", f"SELECT media_id, s.t AS t, s.c AS score FROM ({BETTER})", "t")
def q05(v):
    return fo.suppress_close_candidates(v.tl.where("kind = 'error'").withColumnRenamed("rms", "score"), M, "t", "score")


OVERLAPS = """WITH RECURSIVE i AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_s, end_s, confidence, seg_index) AS nr, {'a': start_s, 'b': end_s, 'c': confidence, 'i': seg_index} AS s FROM seg),
    w AS (SELECT media_id, nr, [s] AS acc FROM i WHERE nr = 1 UNION ALL
      SELECT i.media_id, i.nr, CASE WHEN w.acc[-1].b - i.s.a > 1 AND i.s.c > w.acc[-1].c THEN list_append(w.acc[:-2], i.s) WHEN w.acc[-1].b - i.s.a > 1 THEN w.acc ELSE list_append(w.acc, i.s) END FROM w JOIN i ON i.media_id = w.media_id AND i.nr = w.nr + 1)
    SELECT media_id, unnest(arg_max(acc, nr)) AS s FROM w GROUP BY media_id"""


@query("J24_suppress_overlaps_by_confidence", f"SELECT media_id, s.i AS seg_index, s.a AS start_s, s.b AS end_s FROM ({OVERLAPS})", "start_s end_s")
def j24(v):
    return fo.suppress_overlaps_by_confidence(v.seg, M, "seg_index").select("media_id", "seg_index", "start_s", "end_s")


SHORT = """WITH RECURSIVE i AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_s, end_s, label) AS nr, {'a': start_s, 'b': end_s, 'l': label} AS s FROM seg),
    w AS (SELECT media_id, nr, [s] AS acc FROM i WHERE nr = 1 UNION ALL
      SELECT i.media_id, i.nr, CASE WHEN i.s.b - i.s.a < 12 THEN list_append(w.acc[:-2], {'a': w.acc[-1].a, 'b': greatest(w.acc[-1].b, i.s.b), 'l': w.acc[-1].l}) ELSE list_append(w.acc, i.s) END FROM w JOIN i ON i.media_id = w.media_id AND i.nr = w.nr + 1)
    SELECT media_id, unnest(arg_max(acc, nr)) AS s FROM w GROUP BY media_id"""


@query("Q09_merge_short_runs", f"SELECT media_id, s.a AS start_s, s.b AS end_s, s.l AS label FROM ({SHORT})", "start_s end_s")
def q09_short(v):
    return fo.merge_short_runs(v.seg, M, 12.0)


@query("W17_first_last_relabel", f"SELECT media_id, start_s, end_s, CASE WHEN nr = 1 AND end_s - start_s < 25 THEN 'intro' WHEN nr = n AND end_s - start_s < 25 THEN 'outro' ELSE label END AS label FROM (SELECT media_id, s.a AS start_s, s.b AS end_s, s.l AS label, row_number() OVER (PARTITION BY media_id ORDER BY s.a, s.b) AS nr, count(*) OVER (PARTITION BY media_id) AS n FROM ({SHORT}))", "start_s end_s")
def w17(v):
    return fo.first_last_relabel(v.seg, M)


JOINED = """WITH RECURSIVE i AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_s, end_s, label, seg_index) AS nr, {'a': start_s, 'b': end_s, 'l': label, 'n': 1} AS s FROM seg),
    w AS (SELECT media_id, nr, [s] AS acc FROM i WHERE nr = 1 UNION ALL
      SELECT i.media_id, i.nr, CASE WHEN w.acc[-1].l = i.s.l AND i.s.a - w.acc[-1].b <= 2 AND greatest(w.acc[-1].b, i.s.b) - w.acc[-1].a <= 120 THEN list_append(w.acc[:-2], {'a': w.acc[-1].a, 'b': greatest(w.acc[-1].b, i.s.b), 'l': i.s.l, 'n': w.acc[-1].n + 1}) ELSE list_append(w.acc, i.s) END FROM w JOIN i ON i.media_id = w.media_id AND i.nr = w.nr + 1)
    SELECT media_id, unnest(arg_max(acc, nr)) AS s FROM w GROUP BY media_id"""


@query("Q15_join_within_limit", f"SELECT media_id, s.a AS start_s, s.b AS end_s, s.l AS label, s.n AS n FROM ({JOINED})", "start_s end_s")
def q15(v):
    return fo.enforce_max_length(v.seg, M, "seg_index", 120.0)


EDGES = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_s, end_s, seg_index) AS nr FROM seg),
    f AS (SELECT media_id, arg_min(start_s, nr) AS s0, arg_max(end_s, nr) AS e0 FROM a GROUP BY media_id),
    k AS (SELECT media_id, s0, e0, coalesce(min(nr) FILTER (end_s - s0 >= 20), max(nr)) AS k FROM a JOIN f USING (media_id) GROUP BY media_id, s0, e0),
    b AS (SELECT media_id, nr, CASE WHEN nr = k THEN s0 ELSE start_s END AS start_s, end_s, label, k, e0 FROM a JOIN k USING (media_id) WHERE nr >= k),
    j AS (SELECT media_id, coalesce(max(nr) FILTER (e0 - start_s >= 20), max(k)) AS j FROM b GROUP BY media_id),
    c AS (SELECT media_id, nr, start_s, CASE WHEN nr = j THEN e0 ELSE end_s END AS end_s, label FROM b JOIN j USING (media_id) WHERE nr <= j),
    x AS (SELECT media_id, arg_min(label, nr) AS l0, arg_max(label, nr) AS l1 FROM c GROUP BY media_id),
    m AS (SELECT media_id, min(nr) FILTER (label <> l0) AS head, max(nr) FILTER (label <> l1) AS tail FROM c JOIN x USING (media_id) GROUP BY media_id),
    p AS (SELECT *, CASE WHEN head IS NULL OR nr < head THEN 0 WHEN nr > tail THEN -1 ELSE nr END AS part FROM c JOIN m USING (media_id))
    SELECT media_id, arg_min(start_s, nr) AS start_s, arg_max(end_s, nr) AS end_s, arg_min(label, nr) AS label FROM p GROUP BY media_id, part"""


@query("Q10_trim_edge_runs", EDGES, "start_s end_s")
def q10(v):
    return fo.trim_edge_runs(v.seg, M, "seg_index", 20.0)


GREEDY = """WITH RECURSIVE i AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY {score} DESC, {time}) AS nr, {{'t': {time}, 'c': {score}}} AS s FROM {rows}),
    w AS (SELECT media_id, nr, [s] AS acc FROM i WHERE nr = 1 UNION ALL
      SELECT i.media_id, i.nr, CASE WHEN len(list_filter(w.acc, lambda k: abs(k.t - i.s.t) < {distance})) = 0 THEN list_append(w.acc, i.s) ELSE w.acc END FROM w JOIN i ON i.media_id = w.media_id AND i.nr = w.nr + 1)
    SELECT media_id, unnest(arg_max(acc, nr)) AS s FROM w GROUP BY media_id"""


@query("Q08_select_by_score", f"SELECT media_id, s.t AS t, s.c AS score FROM ({GREEDY.format(score='rms', time='t', rows='tl', distance=90)})", "t")
def q08(v):
    return fo.select_by_score(v.tl.withColumnRenamed("rms", "score"), M, "t", "score", 90.0)


PEAKS = "(SELECT * FROM (SELECT *, lag(rms) OVER w AS a, lead(rms) OVER w AS b FROM tl WINDOW w AS (PARTITION BY media_id ORDER BY frame)) WHERE rms > a AND rms > b AND rms >= 30)"


@query("W06_peaks_with_min_distance", f"SELECT media_id, s.t AS frame, s.c AS rms FROM ({GREEDY.format(score='rms', time='frame', rows=PEAKS, distance=5)})")
def w06(v):
    return fo.peaks_with_min_distance(v.tl, "rms", M, "frame", 5, 30.0)


WEIGHTS = {"title": 0.6, "audio": 0.25, "structure": 0.15}
CLUSTERS = """WITH RECURSIVE i AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t, source) AS nr, t, source, CASE source WHEN 'title' THEN 0.6 WHEN 'audio' THEN 0.25 ELSE 0.15 END::DOUBLE AS w FROM bnd),
    g AS (SELECT media_id, nr, [{'center': t, 'total': w, 'weighted': t * w, 'n': 1, 'sources': [source]}] AS acc FROM i WHERE nr = 1 UNION ALL
      SELECT i.media_id, i.nr, CASE WHEN len(list_filter(g.acc, lambda c: abs(i.t - c.center) <= 40)) = 0 THEN list_append(g.acc, {'center': i.t, 'total': i.w, 'weighted': i.t * i.w, 'n': 1, 'sources': [i.source]})
        ELSE list_transform(g.acc, lambda c, k: CASE WHEN k = list_min(list_filter(list_transform(g.acc, lambda d, j: CASE WHEN abs(i.t - d.center) <= 40 THEN j END), lambda j: j IS NOT NULL))
          THEN {'center': (c.weighted + i.t * i.w) / (c.total + i.w), 'total': c.total + i.w, 'weighted': c.weighted + i.t * i.w, 'n': c.n + 1, 'sources': list_distinct(list_append(c.sources, i.source))} ELSE c END) END
      FROM g JOIN i ON i.media_id = g.media_id AND i.nr = g.nr + 1)
    SELECT media_id, unnest(arg_max(acc, nr)) AS s FROM g GROUP BY media_id"""


@query("Q04_cluster_boundaries", f"SELECT media_id, round(s.center + 1e-7, 3) AS center, list_sum(list_transform(s.sources, lambda x: CASE x WHEN 'title' THEN 0.6 WHEN 'audio' THEN 0.25 ELSE 0.15 END::DOUBLE)) AS score, s.n AS n FROM ({CLUSTERS}) WHERE list_sum(list_transform(s.sources, lambda x: CASE x WHEN 'title' THEN 0.6 WHEN 'audio' THEN 0.25 ELSE 0.15 END::DOUBLE)) >= 0.55 - 1e-9", "center score")
def q04(v):
    return fo.cluster_boundaries(v.bnd, M, "t", "source", WEIGHTS, 40.0).withColumn("center", F.round(F.col("center") + 1e-7, 3))


CHUNKS = """WITH RECURSIVE i AS (SELECT media_id * 100000 + pos AS k, row_number() OVER (PARTITION BY media_id, pos ORDER BY word_pos) AS nr, {'text': trim(word), 'a': start_s, 'b': end_s} AS s FROM word WHERE trim(word) <> ''),
    w AS (SELECT k, nr, [s] AS acc FROM i WHERE nr = 1 UNION ALL
      SELECT i.k, i.nr, CASE WHEN greatest(0, i.s.a - w.acc[-1].b) > 0.6 OR length(w.acc[-1].text) + length(i.s.text) > 24 OR contains('。！？!?,，、；;：:', right(w.acc[-1].text, 1)) THEN list_append(w.acc, i.s)
        ELSE list_append(w.acc[:-2], {'text': w.acc[-1].text || CASE WHEN regexp_matches(w.acc[-1].text, '[A-Za-z0-9]$') AND regexp_matches(i.s.text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || i.s.text, 'a': w.acc[-1].a, 'b': i.s.b}) END FROM w JOIN i ON i.k = w.k AND i.nr = w.nr + 1)
    SELECT k, unnest(arg_max(acc, nr)) AS s FROM w GROUP BY k"""


@query("Q19_words_to_chunks", f"SELECT k // 100000 AS media_id, k % 100000 AS pos, s.text AS text, s.a AS start_s, s.b AS end_s FROM ({CHUNKS})", "start_s end_s")
def q19(v):
    return fo.words_to_chunks(v.word, ["media_id", "pos"])


FRAGMENTS = """WITH RECURSIVE i AS (SELECT media_id * 100000 + pos AS k, row_number() OVER (PARTITION BY media_id, pos ORDER BY start_s, end_s, word) AS nr, {'a': start_s, 'b': end_s, 'text': trim(word)} AS s FROM word WHERE trim(word) <> ''),
    w AS (SELECT k, nr, [s] AS acc FROM i WHERE nr = 1 UNION ALL
      SELECT i.k, i.nr, CASE WHEN greatest(0, i.s.a - w.acc[-1].b) <= 0.45 AND length(w.acc[-1].text) + length(i.s.text) <= 15 AND greatest(w.acc[-1].b, i.s.b) - w.acc[-1].a <= 5 AND (length(w.acc[-1].text) <= 2 OR length(i.s.text) <= 2 OR NOT contains('。！？!?,，、；;：:.', right(w.acc[-1].text, 1)))
        THEN list_append(w.acc[:-2], {'a': w.acc[-1].a, 'b': greatest(w.acc[-1].b, i.s.b), 'text': w.acc[-1].text || CASE WHEN regexp_matches(w.acc[-1].text, '[A-Za-z0-9]$') AND regexp_matches(i.s.text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || i.s.text}) ELSE list_append(w.acc, i.s) END FROM w JOIN i ON i.k = w.k AND i.nr = w.nr + 1),
    d AS (SELECT k, arg_max(acc, nr) AS m FROM w GROUP BY k),
    y AS (SELECT k, m, 1 AS o, [m[1]] AS r FROM d UNION ALL
      SELECT k, m, o + 1, CASE WHEN m[o + 1].a - r[-1].b <= 0.5 AND (length(r[-1].text) <= 1 AND length(m[o + 1].text) <= 24 OR length(m[o + 1].text) <= 1 AND length(r[-1].text) <= 24)
        THEN list_append(r[:-2], {'a': r[-1].a, 'b': greatest(r[-1].b, m[o + 1].b), 'text': r[-1].text || CASE WHEN regexp_matches(r[-1].text, '[A-Za-z0-9]$') AND regexp_matches(m[o + 1].text, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || m[o + 1].text}) ELSE list_append(r, m[o + 1]) END FROM y WHERE o < len(m))
    SELECT k, unnest(arg_max(r, o)) AS s FROM y GROUP BY k"""


@query("Q20_merge_fragments", f"SELECT k // 100000 AS media_id, k % 100000 AS pos, s.text AS text, s.a AS start_s, s.b AS end_s FROM ({FRAGMENTS})", "start_s end_s")
def q20(v):
    return fo.merge_fragments(v.word.select("media_id", "pos", "start_s", "end_s", F.col("word").alias("text")), ["media_id", "pos"])


PARTS = f"""WITH RECURSIVE {CHANGE}, q AS (SELECT media_id, quantile_cont(change, 0.7) AS p70, quantile_cont(change, 0.5) AS p50 FROM c GROUP BY media_id), n AS (SELECT media_id, count(*) FILTER (change > p70) < 3 AS few FROM c JOIN q USING (media_id) GROUP BY media_id),
    st AS (SELECT media_id, list({{'t': t, 'c': change}} ORDER BY t, change) AS x FROM c JOIN q USING (media_id) JOIN n USING (media_id) WHERE change > p70 OR few AND change > p50 GROUP BY media_id), be AS (SELECT media_id, list(t ORDER BY t) AS b FROM (SELECT DISTINCT media_id, t FROM bnd) GROUP BY media_id),
    g AS (SELECT o.media_id, o.total_s, coalesce(x, []) AS x, coalesce(b, []) AS b FROM (SELECT media_id, max(end_s) AS total_s FROM seg GROUP BY media_id) o LEFT JOIN st USING (media_id) LEFT JOIN be USING (media_id)),
    w AS (SELECT media_id, total_s, x, b, [0.0::DOUBLE] AS cuts, 0 AS k FROM g UNION ALL
      SELECT media_id, total_s, x, b, list_append(cuts, CASE WHEN beat IS NOT NULL THEN greatest(cuts[-1] + 150, least(beat, least(cuts[-1] + 450, total_s))) ELSE best END), k + 1 FROM (SELECT *, list_min(list_transform(list_filter(b, lambda y: abs(y - best) < 2), lambda y: {{'d': abs(y - best), 'b': y}})).b AS beat FROM
        (SELECT *, coalesce(list_min(list_transform(list_filter(x, lambda y: y.t >= cuts[-1] + 150 AND y.t <= least(cuts[-1] + 450, total_s)), lambda y: {{'c': round(abs(y.t - (cuts[-1] + 300)) / 300 - y.c * 0.3::DOUBLE, 9), 't': y.t}})).t, least(least(cuts[-1] + 450, total_s), cuts[-1] + 300)) AS best FROM w WHERE cuts[-1] < total_s - 150))),
    e AS (SELECT media_id, list_append(arg_max(cuts, k), any_value(total_s)) AS c FROM w GROUP BY media_id), p AS (SELECT media_id, c, unnest(range(1, len(c))) AS i FROM e)
    SELECT media_id, c[i] AS start_s, c[i + 1] AS end_s FROM p WHERE c[i + 1] - c[i] >= 3"""


@query("Q35_structure_split", f"SELECT * FROM ({PARTS})", "start_s end_s")
def q35(v):
    changes = fr.change_rate(v.tl, "rms", M, "frame", 5).select("media_id", "t", "change")
    return fo.structure_split(changes, v.bnd.select("media_id", "t"), totals(v), M, 300.0, 150.0, 450.0)
