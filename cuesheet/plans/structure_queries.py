"""Structure of frame series on the driver's tables."""

from __future__ import annotations

from cuesheet.operators import structure as st
from cuesheet.plans.fold_queries import GREEDY, walked
from cuesheet.plans.interval_queries import totals
from cuesheet.plans.registry import query

M = ["media_id"]


def flat(rows: str, value: str, order: str = "nr", key: str = "song") -> str:
    """Runs of equal values above both neighbours, at their middle."""
    return f"""(SELECT {key}, (a + b) // 2 AS {order}, {value} FROM (SELECT *, lag({value}) OVER f AS before, lead({value}) OVER f AS after FROM (SELECT {key}, island, min({order}) AS a, max({order}) AS b, any_value({value}) AS {value} FROM
      (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, coalesce({value} <> lag({value}) OVER (PARTITION BY {key} ORDER BY {order}), true) AS fresh FROM {rows})) GROUP BY {key}, island)
      WINDOW f AS (PARTITION BY {key} ORDER BY island)) WHERE {value} > before AND {value} > after)"""


def merged(rows: str, hole: int) -> str:
    """Runs of a diagonal not more than `hole` apart."""
    return f"""SELECT song, lag, min(first) AS first, max(last) AS last FROM (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY song, lag ORDER BY first ROWS UNBOUNDED PRECEDING) AS island FROM
      (SELECT *, coalesce(first - lag(last) OVER (PARTITION BY song, lag ORDER BY first) - 1 > {hole}, true) AS apart FROM {rows})) GROUP BY song, lag, island"""


BLOCK = 6
BLOCKS = f"""x AS (SELECT song, row_number() OVER (PARTITION BY song ORDER BY frame) - 1 AS nr, v FROM vec), sz AS (SELECT song, count(*) AS n FROM x GROUP BY song),
    pr AS (SELECT a.song, b.nr - a.nr AS lag, a.nr, floor(list_cosine_similarity(a.v, b.v) * 1000 + 0.5)::INT AS g FROM x a JOIN x b ON a.song = b.song AND b.nr BETWEEN a.nr + 1 AND a.nr + {2 * BLOCK}),
    th AS (SELECT song, quantile_disc(g, 0.7) AS g0 FROM pr WHERE g > 0 GROUP BY song), so AS (SELECT pr.song, lag, nr, nr - row_number() OVER (PARTITION BY pr.song, lag ORDER BY nr) AS d FROM pr JOIN th ON th.song = pr.song WHERE g > g0),
    r0 AS (SELECT song, lag, min(nr) AS first, max(nr) AS last FROM so GROUP BY song, lag, d HAVING count(*) >= 2), rn AS ({merged('r0', 1)}),
    ev AS (SELECT rn.song, nr, sum(d) AS d FROM rn JOIN sz ON sz.song = rn.song, LATERAL (VALUES (first, 1), (last + 1, -1), (first + lag, 1), (last + lag + 1, -1)) e(nr, d) WHERE lag <= n // 2 GROUP BY rn.song, nr),
    hd AS (SELECT x.song, x.nr, (1 + coalesce(sum(d) OVER (PARTITION BY x.song ORDER BY x.nr ROWS UNBOUNDED PRECEDING), 0))::DOUBLE AS held FROM x LEFT JOIN ev ON ev.song = x.song AND ev.nr = x.nr),
    sc AS (SELECT song, nr, held / max(held) OVER (PARTITION BY song) AS held FROM hd),
    tp AS ({{top}}), bl AS (SELECT tp.song, greatest(tp.s.t - {BLOCK // 2}, 0)::BIGINT AS first, least(tp.s.t + {BLOCK // 2}, n)::BIGINT AS last, tp.s.c AS score, n FROM tp JOIN sz ON sz.song = tp.song),
    lg AS (SELECT bl.song, bl.first, bl.last, score, n, lag, coalesce(sum(greatest(0, least(bl.last - lag, rn.last + 1) - greatest(bl.first, rn.first))), 0) AS inside, sum(greatest(0, least(bl.last, rn.last + 1) - greatest(bl.first, rn.first))) AS met
      FROM bl LEFT JOIN rn ON rn.song = bl.song AND rn.first < bl.last AND rn.last + 1 > bl.first GROUP BY ALL)
    SELECT song, first, last, score, (last - first + 2 * sum(inside)) / ((last - first) * (last - first))::DOUBLE AS similarity, 1 + count(*) FILTER (lag >= last - first AND lag < least(n - last + 1, n // 2, {2 * BLOCK + 1}) AND (lag - (last - first)) % greatest(1, (last - first) // 2) = 0 AND last + lag <= n AND met / (last - first) > 0.5) AS occurrences
    FROM lg GROUP BY song, first, last, score, n"""
#: peaks of at least 0.3, best first, a block apart
TOPS = GREEDY.format(score="held", time="spot", rows=f"(SELECT song, nr AS spot, held FROM {flat('sc', 'held')} WHERE held >= 0.3)", distance=BLOCK).replace("media_id", "song")


@query("Q24_repeating_blocks", "WITH " + BLOCKS.format(top=TOPS), "score similarity")
def q24(v):
    return st.repeating_blocks(v.vec, ["song"], "frame", "v", BLOCK, shortest=2)


SMOOTH = "x AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY frame) - 1 AS nr, avg(rms) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM tl), lv AS (SELECT media_id, quantile_cont(v, 0.5) AS p50, max(v) AS highest, count(*) AS n FROM x GROUP BY media_id)"
ENERGY_TOPS = GREEDY.format(score="v", time="spot", rows=f"(SELECT q.media_id, q.nr AS spot, q.v FROM {flat('x', 'v', key='media_id')} q JOIN lv ON lv.media_id = q.media_id WHERE q.v >= p50)", distance=6)


@query("Q25_energy_regions", f"""WITH {SMOOTH}, pk AS (SELECT media_id, s.t AS nr, s.c AS v FROM ({ENERGY_TOPS})),
    ed AS (SELECT pk.media_id, pk.nr, pk.v, max(x.nr) FILTER (x.nr < pk.nr AND x.v > pk.v) AS a, min(x.nr) FILTER (x.nr > pk.nr AND x.v > pk.v) AS b FROM pk JOIN x ON x.media_id = pk.media_id GROUP BY pk.media_id, pk.nr, pk.v),
    pm AS (SELECT ed.media_id, ed.nr, ed.v, ed.v - greatest(min(x.v) FILTER (x.nr <= ed.nr AND x.nr > coalesce(a, -1)), min(x.v) FILTER (x.nr >= ed.nr AND x.nr < coalesce(b, 1e18))) AS prominence FROM ed JOIN x ON x.media_id = ed.media_id GROUP BY ed.media_id, ed.nr, ed.v, a, b)
    SELECT * FROM (SELECT pm.media_id, greatest(nr - 3, 0) AS first, least(nr + 4, n) AS last, prominence, v / highest AS confidence FROM pm JOIN lv ON lv.media_id = pm.media_id WHERE prominence >= 8) WHERE last - first >= 5""", "prominence confidence")
def q25(v):
    return st.energy_regions(v.tl, M, "frame", "rms", 3, 6, 3, 4, 5, prominence=8.0, chunk=32)


VALLEYS = "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t) AS nr, {'t': t} AS s FROM va"
NEIGHBOURS = "min(rms) OVER (PARTITION BY tl.media_id ORDER BY t ROWS BETWEEN {} AND {})"


@query("Q08_song_boundaries", f"""WITH en AS (SELECT media_id, max(end_s) AS total_s FROM seg GROUP BY media_id), er AS (SELECT tl.media_id, t, rms FROM tl JOIN en ON en.media_id = tl.media_id WHERE kind = 'error' AND total_s - t >= 15),
    ch AS (SELECT media_id, s.t AS t FROM ({GREEDY.format(score='rms', time='t', rows='er', distance=60)})), fw AS (SELECT en.media_id, total_s FROM en LEFT JOIN ch ON ch.media_id = en.media_id GROUP BY ALL HAVING total_s > 250 AND count(t) < greatest(5, floor(total_s / 250))),
    nb AS (SELECT tl.media_id, t, rms, {NEIGHBOURS.format('2 PRECEDING', '1 PRECEDING')} AS a, {NEIGHBOURS.format('1 FOLLOWING', '2 FOLLOWING')} AS b, total_s FROM tl JOIN fw ON fw.media_id = tl.media_id), va AS (SELECT media_id, t FROM nb WHERE rms < a AND rms < b AND total_s - t >= 15 AND t >= 60),
    sp AS (SELECT media_id, state.t AS t FROM ({walked(VALLEYS, 'i.s.t - w.state.t >= 60')} SELECT * FROM w) WHERE kept)
    SELECT media_id, t, 'score' AS origin FROM ch UNION ALL SELECT media_id, t, 'valley' FROM sp WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.media_id = sp.media_id AND abs(ch.t - sp.t) <= 60)""", "t")
def q08(v):
    points = v.tl.where("kind = 'error'").select("media_id", "t", "rms")
    return st.song_boundaries(points, v.tl.select("media_id", "frame", "t", "rms"), totals(v), M, "t", "rms", "rms", distance=60.0, song=250.0, reach=2, order="frame")
