"""Repeating blocks, prominence, classification in order, legal lengths and sequential matches against plain versions and planted cases."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.operators import alignment, asof, classification, durations, frames, structure


def test_a_passage_that_comes_again_is_found(spark):
    rng = np.random.default_rng(4)
    noise = lambda n: rng.normal(size=(n, 16))
    chorus = noise(12)
    series = np.concatenate([noise(10), chorus, noise(6), chorus + noise(12) / 9, noise(12)])
    rows = [(1, i, x.tolist()) for i, x in enumerate(series)] + [(2, i, x.tolist()) for i, x in enumerate(noise(30))] + [(3, 0, [0.0] * 16), (3, 1, None)]
    df = spark.createDataFrame(rows, "song int, frame int, v array<double>")
    got = structure.repeating_blocks(df, ["song"], "frame", "v", 12, share=0.8, shortest=4).collect()
    best = max((r for r in got if r.song == 1), key=lambda r: r.score)
    assert abs(best.first - 10) <= 8 or abs(best.first - 28) <= 8
    assert best.score == 1.0
    runs = structure.diagonal_runs(df, ["song"], "frame", "v", 24, share=0.8, shortest=4).where("song = 1").collect()
    assert any(r.lag == 18 and r["first"] <= 10 and r["last"] >= 21 for r in runs)
    chunked = structure.diagonal_runs(df, ["song"], "frame", "v", 5, share=0.7, chunk=5).collect()
    whole = structure.diagonal_runs(df, ["song"], "frame", "v", 5, share=0.7, chunk=512).collect()
    assert sorted(map(tuple, chunked)) == sorted(map(tuple, whole)) and whole
    assert structure.repeating_blocks(df.where("song = 3"), ["song"], "frame", "v", 4).count() == 0


def plain_prominence(values, at):
    sides = []
    for way in (values[: at + 1][::-1], values[at:]):
        low = way[0]
        for x in way:
            if x > values[at]:
                break
            low = min(low, x)
        sides.append(low)
    return values[at] - max(sides)


@pytest.mark.parametrize("shape", ["random", "falling", "rising", "flat"])
def test_prominence(spark, shape):
    rng = random.Random(2)
    values = [float(rng.randrange(30)) for _ in range(300)]
    if shape in ("falling", "rising"):
        values = [x % 3 + i / 10 for i, x in enumerate(values)]
        values = values[::-1] if shape == "falling" else values
    if shape == "flat":
        values = [float(int(x) // 10) for x in values]
    series = spark.createDataFrame([(k, i, x) for k in (1, 2) for i, x in enumerate(values)], "m int, nr long, v double")
    tops = structure.flat_peaks(series, "v", ["m"], "nr")
    want, i = [], 1
    while i < len(values) - 1:
        j = i
        while j < len(values) - 1 and values[j] == values[i]:
            j += 1
        if values[i - 1] < values[i] > values[j]:
            want.append((i + j - 1) // 2)
        i = j
    assert sorted(r.nr for r in tops.where("m = 1").collect()) == want and want
    got = {(r.m, r.nr): r.prominence for r in structure.prominences(series, tops, ["m"], chunk=16).collect()}
    assert got == {(m, i): plain_prominence(values, i) for m in (1, 2) for i in want}


def test_prominence_over_arrow_batches(spark):
    """Chunks of many timelines are read one after the other, not as a group each, and go on over the ends of batches."""
    rng = random.Random(4)
    values = {m: [float(rng.randrange(9)) for _ in range(40)] for m in range(30)}
    series = spark.createDataFrame([(m, i, x) for m, xs in values.items() for i, x in enumerate(xs)], "m int, nr long, v double")
    at = {(m, i) for m, xs in values.items() for i in range(1, 39) if xs[i - 1] < xs[i] > xs[i + 1]}
    tops = spark.createDataFrame([(m, i, values[m][i]) for m, i in sorted(at)], "m int, nr long, v double")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        found = structure.prominences(series, tops, ["m"], chunk=16)
        assert "CoGroup" not in found._jdf.queryExecution().toString()
        assert {(r.m, r.nr): r.prominence for r in found.collect()} == {(m, i): plain_prominence(values[m], i) for m, i in at}
    finally:
        spark.conf.set(size, before)


def test_states_run_on_over_chunks(spark):
    rng = random.Random(6)
    labels = ["verse", "chorus", "intro", "solo"]
    rows = [(m, i, [(rng.choice(labels), rng.random()) for _ in range(3)]) for m in (1, 2) for i in range(100)] + [(3, 0, [("solo", None)] * 3)]
    df = spark.createDataFrame(rows, "m int, nr int, after array<struct<label: string, confidence: double>>")
    want, state = [], {}
    for m, i, after in rows:
        label, sure = after[state.get(m, 0)]
        state[m] = {"verse": 1, "chorus": 2}.get(label, 0)
        want.append((m, i, label, sure))
    for chunk in (1, 7, 256):
        assert sorted(map(tuple, classification.scanned(df, ["m"], "nr", "after", chunk).collect())) == want


def repaired(segs, least, most):
    """One timeline's repair, step by step over a list of [start, end, type, highlight]."""

    def split(s):
        n = 1 if s[1] - s[0] <= most + 1e-6 else int(np.ceil((s[1] - s[0]) / most))
        at = [s[0] + (s[1] - s[0]) * i / n for i in range(n + 1)]
        return [[a if n == 1 else round(a, 3), b if i == n - 1 else round(b, 3), *s[2:]] for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b - a > 0.05]

    todo = sorted((p for s in segs if s[1] > s[0] for p in split(s)), key=lambda s: s[:3])
    i = 0
    while i < len(todo):
        s = todo[i]
        if s[1] - s[0] >= least - 1e-6:
            i += 1
            continue
        before, after = todo[i - 1] if i else None, todo[i + 1] if i + 1 < len(todo) else None
        like_before = bool(before and before[2] == s[2] and s[0] - before[1] <= 2)
        like_after = bool(not like_before and after and after[2] == s[2] and after[0] - s[1] <= 2)
        near = lambda a, b: b[0] - a[1] <= 2.5
        fits = lambda size: least * 0.8 <= size <= most + 1e-6
        if like_before and s[1] - before[0] <= most + 1e-6:
            to = "before"
        elif like_after and after[1] - s[0] <= most + 1e-6:
            to = "after"
        elif before and near(before, s) and fits(s[1] - before[0]):
            to = "before"
        elif after and near(s, after) and fits(after[1] - s[0]):
            to = "after"
        else:
            to = ""
        if to == "before":
            before[1], before[3] = max(before[1], s[1]), before[3] or s[3]
        elif to == "after":
            after[0], after[3] = min(after[0], s[0]), after[3] or s[3]
        del todo[i]
        i = max(0, i - 1) if to else i
    return sorted(tuple(p) for s in todo for p in split(s) if p[1] - p[0] >= least - 1e-6)


def test_lengths_become_legal(spark):
    rng = random.Random(7)
    for touching in (True, False):
        rows, t = [], 0.0
        for i in range(400):
            start = t + (0 if touching else rng.choice((-1.0, 0, 0, 1.5, 2.25, 4)))
            t = round(start + rng.choice((0.5, 1, 2, 3, 5, 8, 12, 20, 40)), 3)
            rows.append((1, i, start, t, rng.choice("aab"), rng.random() < 0.2))
        df = spark.createDataFrame(rows, "m int, nr int, start_s double, end_s double, type string, is_highlight boolean")
        got = durations.enforce_durations(df, ["m"], "nr", 8.0, 15.0).drop("m").collect()
        want = repaired([list(r[2:]) for r in rows], 8.0, 15.0)
        assert sorted((round(r[0], 6), round(r[1], 6), r[2], r[3]) for r in got) == sorted((round(a, 6), round(b, 6), c, d) for a, b, c, d in want)
    assert durations.enforce_durations(df.limit(0), ["m"], "nr", 8.0, 15.0).count() == 0


def matched(lines, words, least=0.25):
    out, cursor = [], 0
    chars = [(c, i) for i, w in enumerate(words) for c in alignment.SKIPPED.sub("", w[1])]
    for k, (n, text, t) in enumerate(lines):
        text = alignment.SKIPPED.sub("", text)
        left = [x for x in chars if x[1] >= cursor]
        size, best = max(len(text) - 2, min(len(text) + 5, 20)), (-1, 0)
        if len(text) >= 2 and left:
            for i in range(min(len(left), 3 * len(text) + 2)):
                ratio = SequenceMatcher(None, text, "".join(c for c, _ in left[i : i + size])).ratio()
                best = max(best, (ratio, -i))
        if best[0] < least:
            out.append((n, 0.0, t, lines[k + 1][2] if k + 1 < len(lines) else t + 5, None, None))
            continue
        a = -best[1]
        last = left[min(a + size, len(left) - 1)][1]
        out.append((n, round(best[0], 3), round(words[left[a][1]][2], 2), round(words[last][3], 2), left[a][1], last))
        cursor = last + 1
    return out


def test_lines_follow_each_other(spark):
    rng = random.Random(3)
    lines, words = {}, {}
    for song in range(8):
        said = ["".join(rng.choice("abcdef ，") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
        words[song] = [(i, w, i * 0.5, i * 0.5 + 0.4) for i, w in enumerate(said)]
        lines[song] = [(i, ("".join(said[i * 6 : i * 6 + 5])[: rng.randrange(1, 18)] if i % 3 else "zzzzyyyy"), i * 4.0) for i in range(10)]
    words[8], lines[8], words[9], lines[9] = [], [(0, "alone", 1.0)], [(0, "a", 0.0, 1.0)], [(0, "", 2.0), (1, "ab", 3.0)]
    ldf = spark.createDataFrame([(s, *x) for s, xs in lines.items() for x in xs], "song int, line int, text string, t double")
    wdf = spark.createDataFrame([(s, *x) for s, xs in words.items() for x in xs], "song int, nr int, word string, start_s double, end_s double")
    got = alignment.sequential_line_match(ldf, wdf, ["song"]).collect()
    for song in lines:
        mine = sorted((r.line, r.score, r.start_s, r.end_s, r.first_word, r.last_word) for r in got if r.song == song)
        assert mine == matched(lines[song], words[song]), song


def test_every_line_has_a_time(spark):
    rows = [(1, i, "some words", None if i % 3 == 2 else i * 4.0, 10 + i * 4.4 if i in (1, 6) else None, 0.9, "confirmed" if i in (1, 6) else "review") for i in range(9)]
    rows += [(2, i, "la", None, None, None, "interpolated") for i in range(3)] + [(3, 0, None, 5.0, 7.0, 0.2, "review")]
    df = spark.createDataFrame(rows, "song int, line int, text string, t double, start_s double, confidence double, status string").withColumn("end_s", F.col("start_s") + 1)
    got = {(r.song, r.line): r for r in asof.fill_between_anchors(df, ["song"], "line", 1.1).collect()}
    assert all(r.start_s is not None and r.end_s > r.start_s for r in got.values())
    assert got[1, 1].start_s == pytest.approx(14.4) and got[1, 1].time_source == "anchor"
    assert got[1, 3].start_s == pytest.approx(14.4 + (12 - 4) / (24 - 4) * (36.4 - 14.4)) and got[1, 3].confidence == pytest.approx(0.62)
    assert got[1, 5].start_s == pytest.approx(14.4 + (20 - 4) / 20 * 22) and got[1, 5].end_s <= 36.35
    assert got[3, 0].start_s == pytest.approx(0.55 * 18 + 0.45 * 7) and got[3, 0].confidence == 0.25


def test_chunks_give_what_whole_timelines_give(spark):
    """Half of all frames are in one recording."""
    rng = random.Random(8)
    rows = [(m, i, float(rng.randrange(50)), rng.random() < 0.5) for m, n in ((1, 600), (2, 200), (3, 1), (4, 399)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "m int, frame long, rms double, flag boolean")
    for reach, f in (
        (4, lambda x, k: x.withColumn("rms", frames.moving_average("rms", k, "frame", 8))),
        (5, lambda x, k: frames.local_extrema(x, "rms", k, "frame", 5, "min")),
        (12, lambda x, k: frames.binary_close(frames.binary_open(x, "flag", k, "frame", 4), "flag", k, "frame", 8)),
    ):
        want = sorted(map(str, f(df, ["m"]).select("m", "frame", "rms", "flag").collect()))
        assert want and all(sorted(map(str, frames.in_chunks(df, ["m"], "frame", reach, f, chunk).select("m", "frame", "rms", "flag").collect())) == want for chunk in (16, 64, 1 << 16))
