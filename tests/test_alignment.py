"""Synthetic lyrics with a known offset and scale are found again; the path is the best by brute force."""

from __future__ import annotations

import random
from difflib import SequenceMatcher
from itertools import product
from pathlib import Path

import numpy as np
import pytest

from cuesheet.operators.alignment import best_path, line_window_candidates, monotone_alignment
from cuesheet.operators.lyrics import time_windows, transcript_quality
from cuesheet.plans import alignment_queries
from cuesheet.plans.views import Views


def value(groups, path, scale, drift):
    total, last = 0.0, None
    for i, (k, (t, c, s)) in enumerate(zip(path, groups, strict=True)):
        total += s[k]
        if last is not None:
            j, t0 = last
            step = c[k] - j
            if step < -0.2:
                return -np.inf
            total += 0.12 * max(-0.4, 1 - abs(step - (t - t0) * scale) / max(drift, 0.8))
        last = (c[k], t)
    return total


def test_best_path():
    rng = random.Random(3)
    for _ in range(60):
        groups = [(i * 3.0, np.array(sorted(rng.uniform(0, 15) for _ in range(4))), np.array([rng.random() for _ in range(4)])) for i in range(5)]
        got = best_path(groups, 1.0, 6.0)
        assert value(groups, got, 1.0, 6.0) == pytest.approx(max(value(groups, p, 1.0, 6.0) for p in product(range(4), repeat=5)))


def test_lines_are_found_in_time(spark):
    rng = random.Random(1)
    lines = [(1, i, "".join(rng.choice("abcdefghijklmnop") for _ in range(12)), i * 5.0) for i in range(6)]
    words = [(1, i * 4 + k, text[k * 3 : k * 3 + 3], 2 + 1.1 * t + k * 0.8, 2 + 1.1 * t + k * 0.8 + 0.7) for _, i, text, t in lines for k in range(4)]
    ldf = spark.createDataFrame(lines, "song int, line int, text string, t double")
    wdf = spark.createDataFrame(words, "song int, pos int, word string, start_s double, end_s double")
    windows = time_windows(wdf, ["song"], ["pos"], 0.25, 1.6)
    found = line_window_candidates(ldf, windows, ["song"], 1.1, 2.0)
    got = monotone_alignment(ldf, found, ["song"], 1.1).orderBy("line").collect()
    assert [r.status for r in got] == ["confirmed"] * 6
    # windows that hold a whole line are centred 0.8 to 2.3 s after its start, and the earliest is nearest to the expected time
    assert all(0.7 <= r.start_s - (2 + 1.1 * t) <= 1.3 for r, (*_, t) in zip(got, lines, strict=True))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_windows_of_the_queries_are_dense(spark):
    """Every quarter of a second a window of 6.4 s, over all words of a sentence."""
    v = Views(spark, "/root/testdata/sf0.001")
    words = [r for r in v.word.where("pos = 1").collect()]
    got = {(r.media_id, r.center): r.text for r in alignment_queries.parts(v)[1].where("pos = 1").collect()}
    some = {}
    for w in sorted(words, key=lambda w: w.word_pos):
        for c in range(int(w.end_s * 4) + 16):
            if w.start_s - 3.2 <= c / 4 <= w.end_s + 3.2:
                some[w.media_id, c / 4] = some.get((w.media_id, c / 4), "") + w.word
    assert sum(got.get(k) != x for k, x in some.items()) + len(got.keys() - some.keys()) <= 0.01 * len(some)  # edges that rounding moves


def test_a_far_window_is_found(spark):
    """A line whose words come a minute after its expected time is still compared with them."""
    lines = spark.createDataFrame([(1, 0, "silver rivers run below", 0.0)], "song int, line int, text string, t double")
    words = spark.createDataFrame([(1, i, w, 60.0 + i, 60.8 + i) for i, w in enumerate(["silver", "rivers", "run", "below"])], "song int, pos int, word string, start_s double, end_s double")
    found = line_window_candidates(lines, time_windows(words, ["song"], ["pos"]), ["song"], drift=12.0).collect()
    assert max(r.similarity for r in found) > 0.9 and all(r.center > 55 for r in found)


def test_transcript_quality(spark):
    said = {1: ["good", "morning", "sun"], 2: ["la", "lo"]}
    times = {1: [(0.0, 0.5), (1.0, 1.5), (0.5, 9.0)], 2: [(0.0, 0.5), (1.0, 1.5)]}
    lyrics = {1: "good morning moon", 2: "nothing here"}
    words = [(k, i, w, *times[k][i]) for k, x in said.items() for i, w in enumerate(x)]
    got = transcript_quality(spark.createDataFrame(words, "song int, pos int, word string, start_s double, end_s double"), spark.createDataFrame(list(lyrics.items()), "song int, lyrics string"), ["song"], ["pos"])
    for r in got.collect():
        t = times[r.song]
        valid = np.mean([0.02 <= e - s <= 4 for s, e in t])
        forward = np.mean([i == 0 or s >= t[i - 1][0] - 0.15 for i, (s, _) in enumerate(t)])
        a, b = "".join(said[r.song]), lyrics[r.song].replace(" ", "")
        assert r.coverage == pytest.approx(SequenceMatcher(None, a, b).ratio())
        assert r.quality == pytest.approx(0.72 * r.coverage + 0.28 * (valid + forward) / 2)
