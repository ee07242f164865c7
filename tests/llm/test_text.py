"""Decontamination, toxicity, quality, personal data and language against brute force, planted cases and held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import decontamination, language, privacy, quality, toxicity

DIR = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


def plain_tiles(item, text, least):
    """Longest first, all by comparing everything."""
    a, b, out = [True] * len(item), [x is not None for x in text], []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and a[i + n] and b[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return out
        a[i : i + n] = b[t : t + n] = [False] * n
        out.append((i, t, n))


def test_tiles_are_greedy():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        text = [rng.choice([0, 1, 2, 3, 4, 5, None]) for _ in range(rng.randrange(0, 60))] + item[5:15]
        want, got = plain_tiles(item, text, 3), decontamination.tiles(item, text, 3)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
        used = [set(range(t, t + n)) for _, t, n in got]
        assert all(not x & y for x, y in combinations(used, 2)) and all(item[i : i + n] == text[t : t + n] for i, t, n in got)


def test_contaminated(spark, odd):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs away from here today"), (2, "short one"), (3, None), (4, "the quick brown fox jumps over the lazy dog and runs away from here today"), (5, "nothing like any other text that was ever written by these people at all")]
    a, b = items[0][1].split()[:7], items[0][1].split()[7:]
    docs = [(10, "Well. " + " ".join(b).upper() + ", or so; " + " ".join(a) + "!"), (11, " ".join(a[:5]) + " and no more"), (12, items[0][1]), (12, items[0][1]), (None, items[0][1]), (13, None), (14, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    got = sorted((str(r.doc_id), r.item_id, round(r.coverage, 3)) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    assert got == sorted((d, i, 1.0) for d in ("10", "12", "12", "None") for i in (1, 4))
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0
    assert decontamination.contaminated(odd.limit(0), bench).count() == 0


def plain_words(text):
    """Lower-case runs of letters and digits; each character of a script without blanks."""
    return decontamination.WORD.findall((text or "").lower())


def plain_contaminated(docs, items):
    out = set()
    for doc, text in docs:
        for item, passage in items:
            words = plain_words(passage)
            if words and sum(n for *_, n in plain_tiles(words, plain_words(text), min(4, len(words)))) / len(words) >= 0.6 - 1e-9:
                out.add((doc, item))
    return out


def test_words_of_scripts_without_blanks():
    assert plain_words("Abc_d é2 東京都です ไทย x") == ["abc", "d", "é2", *"東京都です", *"ไทย", "x"]


def test_short_and_unspaced_items(spark):
    items = [(1, "secret pass phrase"), (2, "これは試験の問題文です"), (3, "word"), (4, "two words"), (5, "!?"), (6, "three words here")]
    docs = [(1, "say the SECRET pass, phrase now"), (2, "secret of a pass phrase"), (3, "前文。これは試験の問題文です。後文"), (4, "これは問題です"), (5, "a word"), (6, "two, words"), (7, "words two"), (8, "three words there")]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == plain_contaminated(docs, items) and {(1, 1), (3, 2), (5, 3), (6, 4)} <= got and not {(2, 1), (7, 4), (8, 6)} & got


def test_contamination_is_that_of_brute_force(spark):
    """Items full of common turns of phrase, repeated words, reordered and cut passages."""
    rng = random.Random(12)
    turns = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(5)) for _ in range(4)]
    some = lambda n: " ".join(rng.choice(turns) if rng.random() < 0.35 else f"w{rng.randrange(60)}" for _ in range(n))
    items = [(i, some(rng.randrange(1, 14))) for i in range(60)] + [(100, turns[0]), (101, turns[0] + " " + turns[0]), (102, "x " * 12)]
    docs = []
    for i in range(150):
        words = rng.choice(items)[1].split()
        cut = rng.randrange(len(words) + 1)
        parts = [words[cut:], [f"w{rng.randrange(60)}" for _ in range(5)], words[:cut]]
        docs.append((i, " ".join(w for p in parts for w in p if rng.random() < 0.97) + " " + some(3)))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == plain_contaminated(docs, items) and len(got) > 50


def plain_segments(w):
    """Maximal segments by their definition: every part of one has a smaller sum, and none holds another."""
    n, total = len(w), np.concatenate(([0.0], np.cumsum(w)))
    good = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if all(total[i] < total[k] < total[j] for k in range(i + 1, j)) and total[j] > total[i]]
    return sorted(x for x in good if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in good))


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(4)
    for _ in range(200):
        w = rng.integers(-5, 6, rng.integers(1, 25)) + rng.random()
        assert [(a, b) for a, b, _ in toxicity.segments(w)] == plain_segments(w)
    assert toxicity.segments(np.zeros(0)) == []


@data
def test_toxicity_on_held_out_rows(spark, odd):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, DIR).collect()}
    assert len(got) == docs.count()
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(x.held_out for _, x in held) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for _, x in held)
    assert sum(x.predicted for y, x in held if y == 0) <= 0.02 * len(held)
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for ya, a in held for yb, b in held if ya > yb]
    assert np.mean(pairs) > 0.75
    model = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.score(odd, model).where("size(passages) > 0").count() == 0


def test_toxicity_is_that_of_brute_force(spark):
    """Weights, lambda, K, evidence over all segments, and the curve, each from its definition."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 6)))
    usual, bad = [word() for _ in range(150)], ["vilest", "hateful", "scum", "rotten"]
    docs, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        docs.append((i, " ".join(rng.choice(bad) if toxic and rng.random() < 0.3 else rng.choice(usual) for _ in range(rng.randrange(5, 60)))))
        labels.append((i, int(toxic)))
    docs += [(1000, ("scum hateful " + " ".join(usual[:9]) + " ") * 3), (1001, ""), (1002, None)]
    df, lf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(df.na.fill(""), lf)
    counts = np.zeros((2, toxicity.TOKENS), np.int64)
    for (_, text), (_, y) in zip(docs, labels, strict=False):
        for b in {b for t in text.split() for b in toxicity.buckets(t)}:
            counts[y, b] += 1
    total, share = counts.sum(), counts[1].sum() / counts.sum()
    for b in [x for t in (*bad, *usual[:20]) for x in toxicity.buckets(t)]:
        clean, toxic = counts[:, b]
        prior = toxicity.PRIOR * (clean + toxic + 0.01) / (total + 0.01 * toxicity.TOKENS)
        odds = np.log((toxic + prior) / (counts[1].sum() + toxicity.PRIOR - toxic - prior)) - np.log((clean + prior) / (counts[0].sum() + toxicity.PRIOR - clean - prior))
        g = 2 * sum(n * np.log(n / ((clean + toxic) * q)) for n, q in ((toxic, share), (clean, 1 - share)) if n)
        assert abs(model.weights[b] - np.clip(odds * max(0, 1 - 16 / g), -4, 6)) < 1e-9
    weigh = lambda text: np.array([max((model.weights[b] for b in toxicity.buckets(t)), key=abs) - toxicity.DRIFT for t in (text or "").split()])
    plain = {i: sorted((float(w[a:b].sum()) for a, b in plain_segments(w)), reverse=True) for i, t in docs for w in [weigh(t)]}
    clean = [(weigh(t), plain[i]) for (i, t), (_, y) in zip(docs, labels, strict=False) if y == 0]
    assert model.rate == toxicity.growth_rate(np.array([np.mean(np.exp(r * np.concatenate([w for w, _ in clean]))) for r in toxicity.RATES]))
    best = [(len(w), s[0] if s else 0.0) for w, s in clean]
    likelihood = lambda log_k: sum(log_k - np.exp(log_k) * n * np.exp(-model.rate * s) for n, s in best)
    assert likelihood(model.log_k) > max(likelihood(model.log_k + d) for d in (-0.05, 0.05))
    loss = lambda a, b: sum(np.logaddexp(0, a + b * x) - y * (a + b * x) for x, y in pairs) + 0.05 * (a * a + b * b)
    pairs = [(min(model.evidence(plain[i], len(docs[i][1].split())), 40.0), y) for i, y in labels]
    a, b = model.curve
    assert loss(a, b) < min(loss(a + p, b + q) for p in (-0.02, 0, 0.02) for q in (-0.02, 0, 0.02) if p or q)
    for r in toxicity.score(df, model).collect():
        text = dict(docs)[r.doc_id] or ""
        evidence = model.evidence(plain[r.doc_id], len(text.split()))
        assert abs(r.evidence - evidence) < 1e-6 * max(1, evidence) and abs(r.score - 1 / (1 + np.exp(-(a + b * min(evidence, 40))))) < 1e-9
    some = 2 / model.rate + (model.log_k + np.log(1000)) / model.rate
    assert model.evidence([some] * 40, 1000) > model.evidence([some] * 32, 1000)  # all segments count
    assert toxicity.score(df.limit(0), model).count() == 0


@data
def test_quality_is_that_of_brute_force(spark):
    """The query's scores from vote counts of single documents and a dense scorer."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DIR.replace('0.01', '0.001')}/documents.parquet").collect()]
    votes = np.array([quality.votes(quality.measures(t)) for _, t in docs])
    posterior = np.where((votes == 0).sum(1) == 0, 0.97, np.where((votes == 0).sum(1) == 1, 0.5, 0.03))
    for _ in range(200):  # by document, not by pattern
        share = np.array([(1 - posterior).sum() + 1, posterior.sum() + 1]) / (len(docs) + 2)
        logs = np.tile(np.log(share), (len(docs), 1))
        for j in range(votes.shape[1]):
            seen = [[0.5 + ((votes[:, j] == v) * p).sum() for p in (1 - posterior, posterior)] for v in (-1, 0, 1)]
            others = [(votes[:, j] == v).sum() + 1 for v in (-1, 1)]
            for i, n in ((0, others[0] / sum(others) * (1 - quality.FALSE_ALARMS)), (1, quality.FALSE_ALARMS), (2, others[1] / sum(others) * (1 - quality.FALSE_ALARMS))):
                seen[i][1] += len(docs) / 2 * n
            rates = np.array(seen) / np.sum(seen, axis=0)
            logs += np.log(rates[votes[:, j] + 1])
        posterior = 1 / (1 + np.exp(logs[:, 0] - logs[:, 1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.learn(df)
    order = [r.doc_id for r in quality.picked(df).select("doc_id").collect()]
    soft = dict(zip((d for d, _ in docs), posterior, strict=True))
    dense = {}
    for d, t in docs:
        dense[d] = np.zeros(quality.FEATURES)
        at, values = quality.features(t)
        dense[d][at] = values
    w, b = quality.train(np.array([dense[d] for d in order]), np.array([soft[d] for d in order]))
    got = {r.doc_id: r for r in quality.op8_quality_classifier(spark, DIR.replace("0.01", "0.001")).collect()}
    assert set(got) == {d for d, _ in docs}
    for d, _ in docs:
        p = 1 / (1 + np.exp(-(dense[d] @ w + b)))
        assert abs(got[d].score - p) < 0.01 and (got[d].kept == (p >= 0.5) or abs(p - 0.5) < 0.01)
    assert quality.judge(df.where(F.lit(False)), model).count() == 0


@data
def test_quality_without_labels(spark, odd, empty):
    got = {r.doc_id: r.kept for r in quality.op8_quality_classifier(spark, DIR).collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet").collect()
    assert np.mean([got[r.doc_id] for r in labels if r.quality == 1]) > 0.97
    assert np.mean([not got[r.doc_id] for r in labels if r.quality == 0]) > 0.8
    assert quality.judge(odd, quality.learn(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))).count() == odd.count()
    assert [r.kept for r in quality.judge(odd, quality.learn(empty)).limit(3).collect()] == [True] * 3


def test_samples_hold_their_bound(spark):
    """With all ids null, repeated, or repeated with their text."""
    df = spark.range(6000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as doc_id", "case when id % 5 = 0 then 'same text' else concat('text ', id) end as text", "'en' as lang")
    got = [(r.doc_id, r.text) for r in quality.picked(df, 300).collect()]
    assert len(got) == len(set(got)) == 300
    assert 50 < sum(i is None for i, _ in got) < 150 and 50 < sum(i == 7 for i, _ in got) < 150
    model = language.learn(df, 300)
    assert model.langs == ["en"] and quality.picked(df.limit(0)).count() == 0


def test_expectation_maximisation_finds_the_labellers():
    rng = np.random.default_rng(6)
    truth = rng.random(20_000) < 0.85
    wrong = [0.001, 0.002, 0.004, 0.003]
    caught = [0.9, 0.6, 0.5, 0.3]
    votes = np.stack([np.where(rng.random(len(truth)) < np.where(truth, f, c), 0, -1) for f, c in zip(wrong, caught, strict=True)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, rates = quality.expectation_maximisation(patterns, counts.astype(float))
    assert all(abs(rates[j, 1, 0] - caught[j]) < 0.06 for j in range(4))
    none, most = (patterns == -1).all(1), (patterns == 0).sum(1) >= 2
    assert posterior[none][0] > 0.9 and (posterior[most] < 0.1).all()


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(privacy.PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark, rows):
    rng = random.Random(8)
    alphabet = ["a", "B7", "@", ".", "..", "-", "_", " ", "+", "(", ")", "1", "22", "255", "4111 1111 1111 1111", "5500-0000-0000-0004", "x@y.z", "é", "😀", "\n", "10.0.0.1", "+49 30 1234567", "%"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(700)] + [t or "" for _, t in rows] + ["a" * 200_000, "1" * 50_000, "1." * 20_000, "+1" * 20_000, "@" * 1000 + "a.b@c.d_e@f.g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in privacy.personal_data(df).select("doc_id", "base").collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), t[:200]


def test_terms_that_disclose(spark, odd):
    rng = random.Random(9)
    fill = lambda: " ".join(rng.choice(["common", "words", "are", "everywhere", "here"]) for _ in range(30))
    docs = [(i, fill()) for i in range(200)]
    docs += [(1000 + i, f"{fill()} write to Zebulon at zeb@corp.org now {fill()}") for i in range(5)]
    docs += [(2000, f"{fill()} ask zebulon, he knows"), (2001, f"{fill()} once@corp.org xylophone {fill()}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = privacy.personal_data(df)
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(docs)
    assert all(any(s.value.lower() == "zebulon" for s in got[i].added) for i in (*range(1000, 1005), 2000))
    assert all(s.value.lower() in ("zebulon", "write", "now") for r in got.values() for s in r.added)
    clean = dict(df.join(found, "doc_id").select("doc_id", privacy.sanitised(F.col("text"), F.concat("base", "added"))).collect())
    assert "zeb" not in clean[1000].lower() and "<EMAIL>" in clean[1000] and clean[2000].endswith("ask <TERM>, he knows")
    assert privacy.personal_data(odd).count() == odd.count() and privacy.personal_data(odd.limit(0)).count() == 0


def test_terms_of_a_much_copied_document(spark):
    """Exact and near copies of a document don't hide that its term is seen with its value only."""
    rng = random.Random(11)
    fill = lambda: " ".join(rng.choice(["common", "words", "are", "everywhere", "here"]) for _ in range(30))
    docs = [(i, fill()) for i in range(400)]
    docs += [(1000 + i, f"{fill()} write to Zebulon at zeb@corp.org now {fill()}") for i in range(3)]
    docs += [(2000 + i, docs[400][1]) for i in range(300)]  # exact copies
    docs += [(3000 + i, f"{docs[401][1]} {fill()}") for i in range(60)]  # other ends, the same surroundings
    found = privacy.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(any(s.value == "Zebulon" for s in r.added) for r in found if r.doc_id >= 1000)
    assert not any(r.added for r in found if r.doc_id < 1000)


def plain_terms(docs):
    """(doc, start, end) of terms, from counts over distinct texts."""
    texts = sorted({t or "" for _, t in docs})
    spans = {t: plain_spans(t) for t in texts}
    words = {t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)} for t in texts}
    seen, holds = {}, {}
    for t in texts:
        for start, k, end in spans[t]:
            value = t[start:end]
            number = re.sub("[^0-9]", "", value)
            part = [value.lower().split("@")[-1], ".".join(value.split(".")[:3]), number[:6], number[:6]][k]
            left, right = t[max(0, start - 60) : start], t[end : end + 60]
            left = re.sub(r"^[^\W\d_]+", "", left) if start > 60 else left
            right = re.sub(r"[^\W\d_]+$", "", right)
            name = value.split("@")[0] if k == 0 else ""
            for whole, c in ((True, (k, value.lower())), (False, (k, "/", part))):
                holds.setdefault(c, set()).add(t)
                for w in set(re.findall(r"[^\W\d_]{3,}", f"{left} {right} {name}".lower())):
                    seen.setdefault((c, whole, w), [set(), set()])
                    seen[c, whole, w][0].add(t)
                    seen[c, whole, w][1].add((left, right))
    found = set()
    for (c, whole, w), (where, around) in seen.items():
        n, n_c, n_t = len(texts), len(holds[c]), sum(w in x for x in words.values())
        if n_c < n and n_t:
            d = min(1.0, np.log(len(where) * n / (n_c * n_t)) / np.log(n / n_c))
            if len(around) >= 3 and d >= 0.7:
                found.add((None, w))
            elif whole and (n_t - 2 * n_t**0.5) * 1000 <= n and (n_c / n) ** len(where) <= 0.001 and d >= 0.9:
                found |= {(t, w) for t in where}
    out = set()
    for doc, t in docs:
        for m in re.finditer(r"[^\W\d_]+", t or ""):
            if {(None, m[0].lower()), (t, m[0].lower())} & found and not any(a < m.end() and m.start() < b for a, _, b in spans[t or ""]):
                out.add((doc, m.start(), m.end()))
    return out


def test_terms_are_those_of_brute_force(spark):
    rng = random.Random(14)
    common = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    rare = lambda: "".join(rng.choice("ijklmnop") for _ in range(8))
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs = [(i, fill(12)) for i in range(1100)]
    docs += [(2000 + i, f"{fill(9)} {rare()} jonas.{rare()}@host{i % 3}.org {rare()} {fill(9)} {rare()}") for i in range(12)]
    docs += [(3000 + i, f"{fill(9)} Zebulon Works 10.0.{i // 5}.{i % 5} {fill(12)}") for i in range(10)]
    docs += [(4000, "Jonas and zebulon"), (4001, docs[1101][1]), (4002, ""), (4003, None)]
    got = {(r.doc_id, s.start, s.end) for r in privacy.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in r.added}
    want = plain_terms(docs)
    assert got == want and len(want) > 30 and (4000, 10, 17) in want


def test_terms_in_a_small_corpus_and_beside_a_value_that_many_texts_share(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("ijklmnop") for _ in range(8))
    fill = lambda: " ".join(rng.choice(["common", "words", "are", "everywhere", "here"]) for _ in range(20))
    docs = [(i, f"{fill()} {word()} {fill()}") for i in range(200)] + [(300 + i, f"{fill()} Zebulon zeb@corp.org {fill()}") for i in range(2)]
    added = {r.doc_id: [s.value for s in r.added] for r in privacy.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert added.pop(300) == added.pop(301) == ["Zebulon"] and not any(added.values())
    # a shared value: each text's own word stays its own, and there are no more rows than texts
    docs = [(i, f"{fill()} {word()} desk@corp.org {fill()}") for i in range(600)] + [(1000 + i, fill()) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, s.start, s.end) for r in privacy.personal_data(df).collect() for s in r.added}
    assert got == plain_terms(docs)


def test_the_query_generalises_what_it_finds(spark, tmp_path):
    docs = [(1, "mail a@b.c now"), (2, None), (3, "ip 10.0.0.1 and +49 30 1234567!"), (3, "x")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans, r.n_term, r.clean_sha256) for r in privacy.op6_personal_data(spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 1, 0, 0, 0, "email:5:10", 0, sha("mail <EMAIL> now")), (2, 0, 0, 0, 0, "", 0, sha("")), (3, 0, 1, 0, 1, "ip:3:11,phone:16:30", 0, sha("ip <IP> and <PHONE>!")), (3, 0, 0, 0, 0, "", 0, sha("x"))]
    assert got == sorted(want)


def plain_path(scores, penalty):
    n, k = scores.shape
    best = scores[0].astype(float)
    for i in range(1, n):
        best = np.array([max(best[b] - penalty * (a != b) for b in range(k)) + scores[i, a] for a in range(k)])
    return best.max()


def test_best_path():
    rng = np.random.default_rng(7)
    for _ in range(300):
        scores = -rng.exponential(3, (rng.integers(1, 40), 3)).astype(np.float32)
        penalty = float(rng.choice([0.5, 4.0, 12.0]))
        path = language.best_path(scores, penalty)
        value = scores[np.arange(len(path)), path].sum(dtype=float) - penalty * (np.diff(path) != 0).sum()
        assert abs(value - plain_path(scores, penalty)) < 1e-3


@data
def test_language(spark, odd, empty):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = language.op10_language_id(spark, DIR).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) > 0.98
    teach = spark.createDataFrame([(1, "the cat and the dog are in the house with us", "en"), (2, "привет мир это мой дом и моя семья", "ru"), (3, "le chat et le chien sont dans la maison avec nous", "fr"), (4, "text", None)], "doc_id long, text string, lang string")
    model = language.learn(teach)
    assert model.langs == ["en", "fr", "ru"]
    text = "the dog and the cat are in the house. привет мир это моя семья. 123"
    (_, _, spans), (lang, score, none) = language.Labeller(model)([text, "12 !?"])
    assert (lang, score, none) == ("und", 0.0, [])
    assert [(text[a:b], x) for a, b, x in language.Labeller(model)([text])[0][2]] == [("the dog and the cat are in the house", "en"), ("привет мир это моя семья", "ru")] and spans
    out = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert out[0].lang_pred == out[1].lang_pred == "und" and out[13].lang_pred == "ru"
    assert {r.lang_pred for r in language.identify(odd, language.learn(empty)).collect()} == {"und"}


def test_long_runs_of_letters_are_read_to_their_end(spark):
    teach = spark.createDataFrame([(1, "the cat and the dog are in the house with us", "en"), (2, "привет мир это мой дом и моя семья", "ru")], "doc_id long, text string, lang string")
    model = language.learn(teach)
    text = "thecatandthedogareinthehouse" * 3 + "приветмирэтомойдомимоясемья" * 100
    ((lang, score, spans),) = language.Labeller(model)([text])
    assert lang == "ru" and score > 0.95 and [x for *_, x in spans] == ["en", "ru"]
    assert (spans[0][0], spans[-1][1]) == (0, len(text))
    tail = spark.createDataFrame([(1, "a" * 64 + "привет" * 50, "ru"), (2, "the cat", "en")], "doc_id long, text string, lang string")
    assert language.learn(tail).uses["cyrillic"].tolist() == [False, True]


def test_language_scores_are_those_of_brute_force(spark):
    """n-grams one by one, a word's score from its definition, the label from the best path by brute force."""
    teach = [(1, "the cat and the dog are in the house with us", "en"), (2, "привет мир это мой дом и моя семья", "ru"), (3, "le chat et le chien sont dans la maison avec nous été", "fr")]
    model = language.learn(spark.createDataFrame(teach, "doc_id long, text string, lang string"))

    def plain_grams(word):
        w, out = f"<{word.lower()}>", []
        roll = lambda s: sum(ord(c) * pow(int(language.PRIME), len(s) - 1 - i) for i, c in enumerate(s)) % (1 << 64)
        for n in range(1, 5):
            out += [(roll(w[i : i + n]) ^ n) * int(language.PRIME) % (1 << 64) >> 48 for i in range(len(w) - n + 1)]
        whole = sum(ord(c) * pow(int(language.PRIME), i + 1) for i, c in enumerate(w)) % (1 << 64)
        return [*out, (whole ^ 5) * int(language.PRIME) % (1 << 64) >> 48]

    words = ["the", "chat", "Été", "привет", "mixed", "дом", "x"]
    buckets, owners = language.grams(words)
    assert all(sorted(buckets[owners == i]) == sorted(plain_grams(w)) for i, w in enumerate(words))
    counts = {x: np.bincount([g for _, t, k in teach if k == x for w in language.words_of(t)[1] for g in plain_grams(w)], minlength=language.GRAMS) for x in model.langs}
    uses = {"en": {"latin"}, "fr": {"latin"}, "ru": {"cyrillic"}}

    def plain_scores(word):
        made = {x: np.mean([np.log((c[g] + language.SMOOTHING) / (c.sum() + language.SMOOTHING * language.GRAMS)) for g in plain_grams(word)]) * min(8.0, 2 + 0.5 * len(word)) for x, c in counts.items()}
        name = "cyrillic" if word[0] in "абвгдежзиклмнопрстуфхцчшщъыьэюя" else "latin"
        able = {x: v for x, v in made.items() if name in uses[x]}
        made = {x: v if x in able else min(made.values()) - 40 for x, v in made.items()}
        return [max(-40.0, v - max(made.values())) for v in made.values()]

    assert np.allclose(model.scores(words), [plain_scores(w) for w in words], atol=1e-3)
    rng = random.Random(15)
    texts = [" ".join(rng.choice(" ".join(t for _, t, _ in teach).split()) for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    for text, (lang, score, _) in zip(texts, language.Labeller(model)(texts), strict=True):
        found = language.words_of(text)[1]
        made = np.array([plain_scores(w) for w in found])
        path = language.best_path(made)
        assert abs(made[np.arange(len(path)), path].sum() - language.PENALTY * (np.diff(path) != 0).sum() - plain_path(made, language.PENALTY)) < 1e-3
        letters = Counter()
        for w, k in zip(found, path, strict=True):
            letters[model.langs[k]] += len(w)
        assert lang in letters and letters[lang] == max(letters.values()) and abs(score - letters[lang] / letters.total()) < 1e-9


def test_numerals_are_no_letters(spark):
    teach = spark.createDataFrame([(1, "the cat and the dog are in the house with us", "en")], "doc_id long, text string, lang string")
    model = language.learn(teach)
    got = [(r.lang_pred, r.score, r.spans) for r in language.identify(spark.createDataFrame([(1, "½ ② ³ Ⅻ ٣ 12_"), (2, "½the cat²")], "doc_id long, text string").orderBy("doc_id"), model).collect()]
    assert got[0] == ("und", 0.0, []) and got[1][0] == "en" and [(s.start, s.end) for s in got[1][2]] == [(1, 8)]


def test_base_hash_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
