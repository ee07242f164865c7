"""The vote of title probes against a plain version."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

from cuesheet.operators.reports import probe_vote, title_agreement


def test_titles_that_agree_win(spark):
    rng = random.Random(5)
    titles = ["Blue Moon", "blue moon (live)", "Blue Mood", "Red Sun", "red suns", "Yellow", "", "Blue Moon"]
    rows = [(s, p, rng.choice((None, None, None, 1, 2)), rng.choice(titles), round(rng.random(), 2), 1.2 if p == 2 else 1.0) for s in range(60) for p in range(1, rng.randrange(2, 6))]
    df = spark.createDataFrame(rows, "song int, probe int, track_id int, title string, confidence double, pos_weight double")
    plain = lambda t: re.sub("[^0-9a-z一-龥]+", "", re.sub("live", " ", re.sub(r"[\(\[].*?[\)\]]", " ", t.lower())))
    alike = lambda a, b: SequenceMatcher(None, plain(a), plain(b)).ratio() if plain(a) and plain(b) else 0.0
    want = {}
    for song in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == song]
        first = mine[0]
        if first[2] is not None or first[4] >= 0.82:
            want[song] = (first[1], first[4], "first")
            continue
        counts = {t: sum(r[2] == t for r in mine) for t in (1, 2)}
        track = max(counts, key=lambda t: (counts[t], max((r[4] * r[5], -r[1]) for r in mine if r[2] == t) if counts[t] else (0, 0)))
        if counts[track] >= 2:
            best = max((r for r in mine if r[2] == track), key=lambda r: (r[4] * r[5], -r[1]))
            want[song] = (best[1], best[4], "track")
            continue
        scored = sorted(((round(r[5] * (1 + r[4]) + sum(0.5 * alike(r[3], o[3]) for o in mine if o is not r) / max(1, len(mine) - 1), 9), -r[1], r[4]) for r in mine), reverse=True)
        close = len(scored) > 1 and (scored[0][0] - scored[1][0]) / scored[0][0] < 0.15
        want[song] = (-scored[0][1], scored[0][2] * (0.6 if close else 1), "score")
    got = {r.song: (r.probe, r.confidence, r.how) for r in probe_vote(df, "song", agreement=title_agreement(df, "song")).collect()}
    assert {k: (a, round(b, 9), c) for k, (a, b, c) in got.items()} == {k: (a, round(b, 9), c) for k, (a, b, c) in want.items()}
    assert {x[2] for x in want.values()} == {"first", "track", "score"}
