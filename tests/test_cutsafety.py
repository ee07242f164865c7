"""Cut safety: golden cases with their expected cuts, and invariants on random timelines."""

from __future__ import annotations

import random

import pytest

from cuesheet.operators.cutsafety import STEPS, normalize_overlaps
from tests.plain_cutsafety import Clip, Limits, Sung, normalize


def run(segments, sentences=(), words=(), limits=(8, 18)):
    clips = [Clip(a, b, 1, "x", False, i) for i, (a, b) in enumerate(segments)]
    return normalize(clips, Sung({1: list(sentences)}, {1: list(words)}), Limits(*limits))


LYRICS = [(101.32, 106.30), (107.48, 112.46), (113.68, 119.70), (121.04, 123.46)]
WORDS = [(64.80, 65.00, 1), (65.00, 65.20, 1), (65.20, 65.50, 1), (65.50, 66.10, 1), (66.10, 67.00, 1), (67.00, 68.20, 1)]


@pytest.mark.parametrize(
    ("segments", "sentences", "words", "limits", "cut"),
    [
        ([(52.62, 65.62), (65.62, 80.16)], [(64.80, 66.20)], [], (8, 15), 66.55),
        ([(52.62, 65.62), (65.62, 80.16)], [(65.50, 67.20)], [], (8, 15), 65.50),
        ([(52.62, 65.62), (65.62, 80.16)], [(64.80, 65.62), (67.00, 69.00)], [], (8, 15), 65.97),
        ([(177.96, 190.00), (190.00, 205.09)], [(188.50, 193.40)], [], (13, 18), 193.40),
        ([(222.21, 238.06), (238.06, 256.06)], [(235.20, 240.20)], [], (13, 18), 240.55),
        ([(52.62, 65.62), (65.62, 80.16)], [(64.80, 68.20)], WORDS, (8, 15), 64.80),
        ([(52.62, 67.20), (67.20, 82.16)], [(64.80, 68.20)], WORDS, (8, 15), 68.55),
        ([(52.62, 65.62), (65.62, 80.16)], [(64.80, 68.20)], [(64.80, 66.00, 3), (66.00, 68.20, 3)], (8, 15), 64.80),
    ],
)
def test_cut(segments, sentences, words, limits, cut):
    left, right = run(segments, sentences, words, limits)[:2]
    assert left.end == pytest.approx(cut, abs=1e-3) and right.start == pytest.approx(cut, abs=1e-3)


def test_overlap_parts_between_sentences():
    left, right = run([(190.9, 203.9), (196.9, 214.3)], [(192.0, 196.4), (197.0, 202.8), (203.2, 207.5)])
    assert left.end == right.start and left.size >= 8 and right.size >= 8


def test_impossible_minimum_leaves_something():
    got = run([(190.9, 203.9), (196.9, 214.3)], [(198.0, 204.5)], limits=(12, 18))
    assert got and all(c.size >= 12 - 1e-3 for c in got) and all(a.end <= b.start + 1e-3 for a, b in zip(got, got[1:], strict=False))


def test_short_ones_with_lyrics_stay_and_sung_gaps_are_filled():
    got = run([(85.96, 100.43), (100.43, 112.81), (112.81, 123.75), (123.75, 136.72)], LYRICS, limits=(13, 15))
    assert len(got) == 4 and all(b.start - a.end <= 0.5 for a, b in zip(got, got[1:], strict=False))
    got = run([(85.96, 100.43), (123.75, 136.72)], LYRICS, limits=(13, 15))
    assert len(got) > 2 and any(c.filled for c in got) and all(b.start - a.end <= 0.5 for a, b in zip(got, got[1:], strict=False))


def test_no_overlap_is_left():
    rng = random.Random(1)
    for _ in range(200):
        at, segments = 0.0, []
        for _ in range(rng.randrange(1, 12)):
            at += rng.uniform(0, 15)
            segments.append((round(at, 3), round(at + rng.uniform(9, 25), 3)))
        got = run(segments)
        assert all(a.end - b.start <= 0.3 + 1e-6 or b.end < a.end for a, b in zip(got, got[1:], strict=False))


def test_as_a_query(spark):
    segments = spark.createDataFrame([(7, 1, 0, 190.9, 203.9, "x", False), (7, 1, 1, 196.9, 214.3, "x", True), (8, 1, 0, 0.0, 9.0, "x", None)], "media_id long, song_index int, seg_index long, start_s double, end_s double, type string, is_highlight boolean")
    sentences = spark.createDataFrame([(7, 1, 192.0, 196.4), (7, 1, 197.0, 202.8), (7, 1, 203.2, 207.5), (9, 1, 1.0, 2.0)], "media_id long, song_index int, start_s double, end_s double")
    got = normalize_overlaps(segments, sentences, None, ["media_id"], 8.0, 18.0).collect()
    assert sorted((r.media_id, r.seg_index) for r in got) == [(7, 0), (7, 1), (8, 0)]


SEGMENTS = "media_id long, song_index int, seg_index long, start_s double, end_s double, type string, is_highlight boolean"
SENTENCES, WORD_ROWS = "media_id long, song_index int, start_s double, end_s double", "media_id long, song_index int, start_s double, end_s double, word string"


def plain(segments, sentences, words, limits, steps):
    out = []
    for m in sorted({r[0] for r in segments}):
        clips = [Clip(a, b, song, kind, bool(high), i) for k, song, i, a, b, kind, high in segments if k == m]
        sung = Sung()
        for k, song, a, b in sorted(sentences):
            if k == m:
                sung.sentences.setdefault(song, []).append((a, b))
        for k, song, a, b, w in sorted(words):
            if k == m:
                sung.words.setdefault(song, []).append((a, b, len(w)))
        out += [(m, round(c.start, 2), round(c.end, 2), c.kind, c.highlight, c.filled) for c in normalize(clips, sung, Limits(*limits), steps)]
    return sorted(out)


def native(spark, segments, sentences, words, limits, steps):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((segments, SEGMENTS), (sentences, SENTENCES), (words, WORD_ROWS))]
    got = normalize_overlaps(*frames, ["media_id"], *map(float, limits), steps).collect()
    return sorted((r.media_id, round(r.start_s, 2), round(r.end_s, 2), r.type, r.is_highlight, r.filled) for r in got)


@pytest.mark.parametrize("steps", [STEPS, ("repair",), ("part", "protect")])
def test_all_timelines_at_once_are_each_by_itself(spark, steps):
    """Random timelines with overlaps, chains, short clips, gaps, several songs and many sentences, as the plain version does them."""
    rng = random.Random(11)
    segments, sentences, words = [], [], []
    for m in range(24):
        t = 0.0
        for i in range(rng.randrange(1, 14)):
            t = round(t + rng.choice((-6, -3, -0.2, 0, 0, 0, 0.4, 1.5, 9)) + rng.random() / 3, 3)
            size = rng.choice((0.3, 2, 5, 7, 9, 12, 15, 20, 26)) + rng.random()
            segments.append((m, int(t > 60), i, max(0.0, t), round(max(0.0, t) + size, 3), rng.choice(("主歌", "副歌", "合唱")), rng.choice((True, False, None))))
            t += size
        at = 0.0
        while at < t and m % 5:
            size = rng.uniform(0.5, 6)
            sentences.append((m, int(at > 60), round(at, 3), round(at + size, 3)))
            for k in range(4 if m % 2 else 0):
                words.append((m, int(at > 60), round(at + size * k / 4, 3), round(at + size * (k + 1) / 4, 3), "ab"[: 1 + k % 2]))
            at += size + rng.choice((0.02, 0.3, 1, 4))
    limits = (8, 18)
    want = plain(segments, sentences, words, limits, steps)
    assert native(spark, segments, sentences, words, limits, steps) == want and len(want) > 100


def test_cases_together(spark):
    """The golden cases as timelines of one catalogue."""
    cases = [
        ([(52.62, 65.62), (65.62, 80.16)], [(64.80, 66.20)], [], 66.55), ([(52.62, 65.62), (65.62, 80.16)], [(65.50, 67.20)], [], 65.50), ([(52.62, 65.62), (65.62, 80.16)], [(64.80, 65.62), (67.00, 69.00)], [], 65.97),
        ([(52.62, 65.62), (65.62, 80.16)], [(64.80, 68.20)], WORDS, 64.80), ([(52.62, 67.20), (67.20, 82.16)], [(64.80, 68.20)], WORDS, 68.55), ([(52.62, 65.62), (65.62, 80.16)], [(64.80, 68.20)], [(64.80, 66.00, 3), (66.00, 68.20, 3)], 64.80),
    ]
    segments = [(m, 1, i, a, b, "x", False) for m, (clips, *_) in enumerate(cases) for i, (a, b) in enumerate(clips)]
    sentences = [(m, 1, *x) for m, (_, said, *_) in enumerate(cases) for x in said]
    words = [(m, 1, a, b, "x" * n) for m, (_, _, heard, _) in enumerate(cases) for a, b, n in heard]
    got = native(spark, segments, sentences, words, (8, 15), STEPS)
    for m, (*_, cut) in enumerate(cases):
        mine = [r for r in got if r[0] == m]
        assert mine[0][2] == mine[1][1] == pytest.approx(cut, abs=0.011)
    empty = native(spark, [], [], [], (8, 15), STEPS)
    assert empty == []
