"""Similarities and what rests on them against plain versions over difflib; planted clusters."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators import alignment as al
from cuesheet.operators import songs as so

BLANKS = re.compile("[\\s　、。！，．：；？（）—‘’\"'…“”]")


def aligned(text):
    return BLANKS.sub("", (text or "").lower())


def similar(a, b):
    a, b = aligned(a), aligned(b)
    if not a or not b:
        return 0.0
    ratio = SequenceMatcher(None, a, b).ratio()
    if b in a:
        ratio = max(ratio, 0.45 * len(b) / len(a) + 0.08)
    elif a in b:
        ratio = max(ratio, 0.40 * len(a) / len(b) + 0.08)
    return min(1.0, ratio)


def title(text):
    text = re.sub(r"[\(\[\{<].*?[\)\]\}>]", " ", (text or "").strip().lower())
    return re.sub("[^0-9a-z一-龥]+", "", re.sub(f"({tx.TITLE_NOISE})", " ", text))


def alike(a, b):
    a, b = title(a), title(b)
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def words(rng, n):
    return "".join(rng.choice("abcdé fgh，。 ABC漢字()live") for _ in range(rng.randrange(n)))


def test_ten_thousand_pairs(spark):
    rng = random.Random(1)
    pairs = [(i, words(rng, 30), words(rng, 30)) for i in range(10_000)]
    pairs = [(i, a, a[rng.randrange(len(a) + 1) :] + b if i % 3 else b) for i, a, b in pairs] + [(10_000, None, "a"), (10_001, "", "")]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    low = tx.norm_text_align(F.col("a"))
    got = {r.i: r for r in df.select("i", tx.text_similarity(F.col("a"), F.col("b")).alias("s"), tx.title_similarity(F.col("a"), F.col("b")).alias("t"), low.alias("n"), tx.norm_title(F.col("a")).alias("m")).collect()}
    plain = BLANKS.sub("", pairs[5][1])
    assert got[5].n in (plain, plain.lower())
    for i, a, b in pairs:
        x, y = (re.sub("", "", v or "") for v in (a, b))
        if got[5].n == plain and plain != plain.lower():  # case is kept
            x, y = BLANKS.sub("", x), BLANKS.sub("", y)
            want = 0.0 if not x or not y else min(1.0, max(SequenceMatcher(None, x, y).ratio(), 0.45 * len(y) / len(x) + 0.08 if y in x else 0.40 * len(x) / len(y) + 0.08 if x in y else 0.0))
        else:
            want = similar(a, b)
        assert got[i].s == pytest.approx(want, abs=1e-12), (a, b)
        assert got[i].m == title(a) and got[i].t == pytest.approx(alike(a, b), abs=1e-12)


def test_every_wanted_title_meets_its_best(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("abcdeghklm no") for _ in range(rng.randrange(1, 25)))
    catalog = [(i, name()) for i in range(300)] + [(500, None), (501, "")]
    wanted = [(i, name() if i % 2 else catalog[i][1][::-1][:3] + catalog[i][1]) for i in range(200)] + [(900, ""), (901, None), (902, catalog[7][1])]
    w, c = spark.createDataFrame(wanted, "w int, a string"), spark.createDataFrame(catalog, "c int, b string")
    for least, block in ((0.45, 64), (0.7, 4096)):
        got = {r.w: (r.c, r.similarity) for r in so.best_catalog_match(w, c, "w", "a", "c", "b", least, block).collect()}
        for i, a in wanted:
            found = [(alike(a, b), -j) for j, b in catalog if title(a) and title(b)]
            best = max(found, default=(0.0, 0))
            assert got.get(i) == ((-best[1], best[0]) if best[0] >= least else None), a
    assert so.best_catalog_match(w, c.limit(0), "w", "a", "c", "b").count() == 0 == so.best_catalog_match(w.limit(0), c, "w", "a", "c", "b").count()


def test_best_window_of_lines(spark):
    rng = random.Random(3)
    lines = [(s, i, words(rng, 12)) for s in range(20) for i in range(6)]
    said = [(s, "".join(t for k, i, t in lines if k == s and s % 4 <= i < s % 4 + 2)) for s in range(20)]
    got = so.best_line_window(spark.createDataFrame(lines, "s int, line int, text string"), spark.createDataFrame(said, "s int, transcript string"), ["s"], 3).collect()
    text = tx.norm_text_align
    assert text is not None
    ratio = {}
    rows = [(s, i, n, "".join(t for k, j, t in lines if k == s and i <= j < i + n), said[s][1]) for s in range(20) for i in range(6) for n in range(1, min(3, 6 - i) + 1)]
    for r in spark.createDataFrame(rows, "s int, i int, n int, a string, b string").select("s", "i", "n", tx.text_similarity(F.col("a"), F.col("b")).alias("x")).collect():
        ratio.setdefault(r.s, []).append((r.x, -r.i, -r.n))
    assert {r.s: (r.similarity, -r["first"], -r["size"]) for r in got} == {s: max(x) for s, x in ratio.items()}


def test_neighbours_that_are_one_song(spark):
    rng = random.Random(4)
    titles = ["", "Blue Moon", "blue moon (live)", "Blue Mood", "Red"]
    vectors = [[1.0, 0.0], [0.95, 0.3], [0.86, 0.5], [0.0, 1.0], [0.0, 0.0]]
    rows = [(m, i, rng.choice(titles), rng.choice((None, None, 1, 2)), rng.choice(vectors), rng.choice(vectors), float(rng.randrange(20, 200)), i * 10.0, i * 10.0 + 8, rng.random()) for m in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "m int, i int, title string, track_id int, head_sig array<double>, tail_sig array<double>, size_s double, start_s double, end_s double, confidence double")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5 or 1.0)
    want = {}
    for a, b in zip(rows, rows[1:], strict=False):
        if a[0] != b[0]:
            continue
        known, edge = a[2] and b[2], cos(a[5], b[4])
        track, same = a[3] is not None and a[3] == b[3], bool(known and title(a[2]) == title(b[2]))
        like = alike(a[2], b[2]) if known and not same else 0
        score = 4 * track + 4 * same + (2.5 * like if like > 0.6 else 0) + (3.5 if edge >= 0.9 else 2 if edge >= 0.84 else 0) + 2 * (not a[2] and not b[2]) + (a[6] + b[6] < 150)
        want[a[:2]] = (round(score, 9), score >= 3.5 and (track or same or edge >= 0.9))
    scores = so.adjacent_merge_score(df, ["m"], "i")
    assert {(r.m, r.i): (round(r.score, 9), r.merges) for r in scores.collect()} == want
    chains, last = [], None
    for r in rows:
        if last is not None and last[0] == r[0] and want[last[:2]][1]:
            chains[-1].append(r)
        else:
            chains.append([r])
        last = r
    plain = sorted((c[0][0], next((r[2] for r in c if r[2]), ""), c[0][7], c[-1][8], max(r[9] for r in c), len(c)) for c in chains)
    got = so.merge_song_chain(df, scores, ["m"], "i").select("m", "title", "start_s", "end_s", "confidence", "parts").collect()
    assert sorted(map(tuple, got)) == plain


def test_sources_that_agree(spark):
    rng = random.Random(5)
    rows = [(s, k, words(rng, 20) if s % 2 else f"same words here {k}", rng.random()) for s in range(20) for k in "abc"[: s % 3 + 1]]
    df = spark.createDataFrame(rows, "s int, source string, text string, score double")
    pairs = [(s, x[2], y[2]) for s in range(20) for x, y in combinations([r for r in rows if r[0] == s], 2)]
    sims = {}
    for r in spark.createDataFrame(pairs, "s int, a string, b string").select("s", tx.text_similarity(F.col("a"), F.col("b")).alias("x")).collect():
        sims.setdefault(r.s, []).append(r.x)
    for r in so.cross_source_agreement(df, ["s"], "source", "text", "score").collect():
        mean = sum(sims[r.s]) / len(sims[r.s]) if r.s in sims else None
        assert r.agreement == (None if mean is None else pytest.approx(mean)) and r.validated == (mean is not None and mean >= 0.7)
        assert r.best == max((x for x in rows if x[0] == r.s), key=lambda x: x[3])[1]


def test_the_cluster_of_most_energy_is_the_chorus(spark):
    rng = random.Random(6)
    centre = {"loud": ([9.0, 0.0], 5.0), "soft": ([0.0, 9.0], 1.0), "other": ([-9.0, -9.0], 2.0)}
    rows = []
    for g in range(9):
        kind = ("loud", "soft", "other")[g % 3]
        for i in range(12):
            at, energy = centre[kind if i < 8 else rng.choice(("loud", "soft", "other"))]
            rows.append((g, [x + rng.gauss(0, 0.3) for x in at], energy + rng.random() / 9))
    got = {r.g: r.label for r in so.dominant_cluster_label(spark.createDataFrame(rows, "g int, v array<double>, e double"), "g", "v", "e").collect()}
    assert got == {g: "chorus" if g % 3 == 0 else "verse" for g in range(9)}


def test_candidates_of_lines(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefg") for _ in range(n))
    lines = [(1, i, text(rng.randrange(1, 9)), None if i % 4 == 3 else i * 4.0) for i in range(12)] + [(1, 12, "", 1.0)]
    lines[5] = (1, 5, lines[4][2], 20.0)
    windows = [(1, i * 2.0, lines[rng.randrange(12)][2] + text(3)) for i in range(25)]
    got = al.line_window_candidates(spark.createDataFrame(lines, "s int, line int, text string, t double"), spark.createDataFrame(windows, "s int, center double, text string"), ["s"], 1.1, 2.0).collect()
    want = []
    for _, i, t, at in lines:
        if not t:
            continue
        often = sum(x[2] == t for x in lines)
        penalty = (0.08 if len(t) <= 3 else 0) + min(0.12, (often - 1) * 0.03)
        rated = []
        for _, c, w in windows:
            s = similar(w, t)
            if s >= 0.06:
                near = 0.5 if at is None else max(0.0, 1 - abs(c - (at * 1.1 + 2)) / 6)
                rated.append((-round(0.82 * s + 0.18 * near - penalty, 9), c))
        want += [(i, c, -s) for s, c in sorted(rated)[:8]]
    assert sorted((r.line, r.center, r.score) for r in got) == sorted(want)


def test_matches_are_those_of_difflib(monkeypatch):
    rng = random.Random(4)
    for k in range(1500):
        monkeypatch.setattr(tx.BitMatcher, "LEAST", 0 if k % 3 else 1000)
        letters = rng.choice(("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz鼠😀"))
        x, y = ("".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 7, 60, 199, 200, 320)))) for _ in "xy")
        assert tx.BitMatcher(None, x, y).get_matching_blocks() == SequenceMatcher(None, x, y).get_matching_blocks()


def test_texts_inside_each_other_and_repeated_pairs_are_not_compared_again(spark, monkeypatch):
    texts = ["", "abcabc", "bca", "😀鼠a", "xx 😀鼠a yy", "q" * 150 + "abc", "abc" * 66 + "zz", "abcabcabc", "zab", "ab" * 99 + "abc", "a, b!c"]
    rows = [(x, y) for x in texts for y in texts]
    bare = lambda t: t.replace(" ", "")
    want = {(x, y): tx.lifted_ratio(SequenceMatcher(None, "", bare(y)), bare(x), bare(y)) if bare(x) and bare(y) else 0.0 for x, y in rows}
    df = spark.createDataFrame(rows, "x string, y string")
    assert {(r.x, r.y): r.s for r in df.select("x", "y", tx.text_similarity(F.col("x"), F.col("y")).alias("s")).collect()} == want
    calls = []
    monkeypatch.setattr(tx, "short_ratio", tx.lru_cache(1 << 16)(lambda x, y: calls.append((x, y)) or 0.5))
    assert [tx.ratio("old ring", "hot bolt") for _ in range(50)] == [0.5] * 50 and len(calls) == 1
