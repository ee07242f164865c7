"""Edges of timelines and left-over characters against plain versions."""

from __future__ import annotations

import random

from cuesheet.operators import folds


def plain_edges(rows, shortest):
    rows = [list(x) for x in rows]
    while len(rows) > 1 and rows[0][1] - rows[0][0] < shortest:
        start = rows.pop(0)[0]
        rows[0][0] = start
    while len(rows) > 1 and rows[-1][1] - rows[-1][0] < shortest:
        end = rows.pop()[1]
        rows[-1][1] = end
    while len(rows) > 1 and rows[0][2] == rows[1][2]:
        start = rows.pop(0)[0]
        rows[0][0] = start
    while len(rows) > 1 and rows[-1][2] == rows[-2][2]:
        end = rows.pop()[1]
        rows[-1][1] = end
    return [tuple(x) for x in rows]


def test_edges(spark):
    rng, rows, want = random.Random(4), [], []
    for m in range(150):
        at, mine = 0.0, []
        for _ in range(rng.randrange(1, 9)):
            end = at + rng.choice([0.25, 0.5, 1.0, 4.0])
            mine.append((at, end, rng.choice("ab")))
            at = end
        rows += [(m, i, *x) for i, x in enumerate(mine)]
        want += [(m, *x) for x in plain_edges(mine, 1.0)]
    df = spark.createDataFrame(rows, "media_id int, nr int, start_s double, end_s double, label string")
    got = [tuple(r) for r in folds.trim_edge_runs(df, ["media_id"], "nr").collect()]
    assert sorted(got) == sorted(want)


def test_single_characters_join_a_neighbour(spark):
    rows = [(0.0, 6.0, "a long first piece"), (6.3, 6.4, "x"), (10.0, 10.1, "y"), (10.6, 16.0, "and the piece after."), (30.0, 30.1, "z")]
    df = spark.createDataFrame([(1, *r) for r in rows], "media_id int, start_s double, end_s double, text string")
    got = sorted((r.start_s, r.end_s, r.text) for r in folds.merge_fragments(df, ["media_id"]).collect())
    assert got == [(0.0, 6.4, "a long first piece x"), (10.0, 16.0, "y and the piece after."), (30.0, 30.1, "z")]
