"""Lines in the words of a song: few exact comparisons for each, and the results of comparing everything."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np

from cuesheet.functions import text as tx
from cuesheet.operators import alignment as al
from cuesheet.operators.lyrics import time_windows

SYLLABLES = ["the", "on", "er", "ing", "ha", "ti", "on", "re", "ed", "st", "wh", "and", "nt", "ly", "ou", "es"]


def sung(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def test_few_windows_are_compared(monkeypatch):
    """Natural words share most of their characters, so that counting characters alone leaves many windows."""
    rng, calls, lifted = random.Random(3), [0], tx.lifted_ratio
    monkeypatch.setattr(tx, "lifted_ratio", lambda *args: (calls.__setitem__(0, calls[0] + 1), lifted(*args))[1])
    words = sung(rng, 200)
    texts = ["".join(words[i : i + 12]) for i in range(len(words))]
    known = al.WindowTexts(texts, np.arange(len(texts)) * 0.5)
    lines = ["".join(words[at : at + rng.randint(6, 12)]) for at in range(0, 180, 4)]
    for at, line in enumerate(lines):
        known.best(line, at * 2.0, 0.0, 12.0, 8, 0.06, None)
    assert calls[0] < 6 * len(lines)


def test_windows_made_of_words_are_those_of_time_windows(spark):
    rng = random.Random(8)
    words, lines = [], []
    for song in range(4):
        said, at = sung(rng, 70), 0.0
        for i, w in enumerate(said):
            start = at if song < 3 else rng.uniform(0, 60)  # one song's words are out of time
            words.append((song, i, "，" if i % 9 == 4 else w, None if i == 11 else start, start + 0.08 * len(w)))
            at += 0.08 * len(w) + 0.08
        lines += [(song, i, " ".join(said[i * 9 : i * 9 + 7]) + "，" * (i % 2), None if i == 2 else i * 4.0) for i in range(7)] + [(song, 7, "the", 3.0), (song, 8, "the，", 9.0), (song, 9, " ，", 9.0)]
    lines.append((9, 0, "nobody sings", 1.0))
    ldf = spark.createDataFrame(lines, "song int, line int, text string, t double")
    wdf = spark.createDataFrame(words, "song int, pos int, word string, start_s double, end_s double")
    want = al.line_window_candidates(ldf, time_windows(wdf, ["song"], ["pos"]), ["song"], drift=12.0)
    got = al.line_word_candidates(ldf, wdf, ["song"], "pos", drift=12.0)
    assert got.columns == want.columns
    rows = sorted(got.collect(), key=str)
    assert rows == sorted(want.collect(), key=str) and len({(r.song, r.line) for r in rows}) == 36


def test_songs_are_read_whole_from_any_batches(spark):
    rng = random.Random(4)
    lines = [(song if song < 9 else None, i, " ".join(sung(rng, 4)), i * 2.0) for song in range(10) for i in range(6)]
    words = [(song, 100 + k, w, i + k / 9, i + k / 9 + 0.3) for song, i, text, _ in lines for k, w in enumerate(text.split(), i * 4)]
    ldf = spark.createDataFrame(lines, "song int, line int, text string, t double")
    wdf = spark.createDataFrame(words, "song int, nr int, word string, start_s double, end_s double")
    size, found = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    for n in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        some = al.line_word_candidates(ldf, wdf, ["song"], "nr")
        each = (some, al.monotone_alignment(ldf, some, ["song"]), al.sequential_line_match(ldf, wdf, ["song"]))
        found.append([sorted(map(str, x.collect())) for x in each])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found[0] == found[1] == found[2] and [len(x) for x in found[0][1:]] == [60, 60]


def match(line, chars, least, reach):
    """Every window compared."""
    if len(line) < 2 or not chars:
        return None
    size, n = max(len(line) - 2, min(len(line) + 5, 20)), min(len(chars), reach * len(line) + 2)
    ratio, first = max((SequenceMatcher(None, line, chars[i : i + size]).ratio(), -i) for i in range(n))
    return (ratio, -first, min(size - first, len(chars))) if ratio >= least else None


def test_next_match_is_the_best_of_all_windows(monkeypatch):
    rng = random.Random(6)
    for k in range(150):
        monkeypatch.setattr(al.Likeness, "MOST", 0 if k % 5 == 0 else 1 << 22)
        letters = rng.choice(("ab", "abcdefgh", "etaoinshrdlu" * 3 + "xyz", "é鼠😀abc"))
        text = lambda *n: "".join(rng.choice(letters) for _ in range(rng.choice(n)))  # noqa: B023, E731
        line, chars = text(0, 1, 2, 5, 18, 23, 40, 202, 260), text(0, 1, 5, 30, 120, 300)
        chars += line[rng.choice((0, 2)) :] + text(0, 9, 60)
        assert al.next_match(line, chars, 0.25, 3) == match(line, chars, 0.25, 3)


def test_a_line_that_is_not_sung_is_compared_with_few_windows(monkeypatch):
    """Between random words the likeness of all windows is about the same; the matches that they share are found once."""
    rng, calls, ratio = random.Random(9), [0], SequenceMatcher.find_longest_match
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", lambda *args: (calls.__setitem__(0, calls[0] + 1), ratio(*args))[1])
    for _ in range(20):
        al.next_match("".join(sung(rng, 8)), "".join(sung(rng, 40)), 0.25, 3)
    assert calls[0] < 20
