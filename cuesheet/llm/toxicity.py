"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Learning counts the labelled documents that hold a hashed token, or a word's first letters: of each label the SAMPLE whose hashed id is smallest, or all if there are fewer. A
token's weight is its log-odds between the labels under an informative Dirichlet prior (the mixture's own frequencies),
shrunk by its significance, to nothing under DEVIATIONS; DRIFT is taken off each, so that ordinary text loses. The table of TOKENS weights has one size, whatever the corpus.

A linear scan finds all maximal scoring segments of a text. By Karlin and Altschul a segment of score S in n tokens has
E = K n exp(-lambda S) rivals by chance; segments with E under SIGNIFICANT are the toxic passages, and a text's evidence is the
least p-value of its best r segments together. A logistic curve, fitted on the learning sample, turns evidence into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import only, remainder, table, written

TOKEN = re.compile(r"[^\W\d_]+")
TOKENS, SAMPLE, PRIOR, DEVIATIONS, DRIFT, SIGNIFICANT, THRESHOLD, REMEMBERED = 1 << 18, 10_000, 2000.0, 4.0, 0.25, 0.01, 0.7, 500_000


STEMS = (4, 5, 6)
#: rates at which the moments of clean texts' weights are taken
RATES = np.geomspace(0.02, 4, 64)


def buckets(token: str) -> list[int]:
    """Of the token and of its first letters, which stand for inflected and compound forms."""
    t = token.lower()
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % TOKENS for x in (t, *(f"{t[:n]}*" for n in STEMS if len(t) >= n))]


def weights(counts: np.ndarray) -> np.ndarray:
    """Of each bucket, from its counts in documents of label 0 and 1."""
    clean, toxic = counts.astype(float)
    prior = PRIOR * (clean + toxic + 0.01) / (clean + toxic + 0.01).sum()
    a, b = toxic + prior, clean + prior
    odds = np.log(a / (toxic.sum() + PRIOR - a)) - np.log(b / (clean.sum() + PRIOR - b))
    share = toxic.sum() / max(1.0, clean.sum() + toxic.sum())
    ratio = [np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum((clean + toxic) * q, 1e-12)), 0) for n, q in ((toxic, share), (clean, 1 - share))]
    significance = 2 * (ratio[0] + ratio[1])  # of the likelihood ratio, as a squared deviation
    shrunk = odds * np.maximum(0, 1 - DEVIATIONS**2 / np.maximum(significance, 1e-9))
    return np.clip(shrunk, -4, 6)


def growth_rate(moments: np.ndarray) -> float:
    """Karlin and Altschul's lambda: the rate at which the mean of exp(rate x weight) in clean text is one again."""
    over = np.flatnonzero(moments >= 1)
    if not len(over):
        return float(RATES[-1])
    i = int(over[0])
    if i == 0:
        return float(RATES[0])
    low, high = np.log(moments[i - 1]), np.log(moments[i])
    return float(RATES[i - 1] + (RATES[i] - RATES[i - 1]) * (0 - low) / max(high - low, 1e-12))


def segments(w: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in order, by Ruzzo and Tompa's scan over runs of gains."""
    up = np.flatnonzero(w > 0)
    if not len(up):
        return []
    total = np.concatenate(([0.0], np.cumsum(w)))
    cuts = np.flatnonzero(np.diff(up) > 1)
    firsts, ends = up[np.concatenate(([0], cuts + 1))], up[np.concatenate((cuts, [len(up) - 1]))] + 1
    found: list[tuple[int, int, float, float]] = []  # first, end, total before, total after
    for first, end in zip(firsts.tolist(), ends.tolist(), strict=True):
        left, right = float(total[first]), float(total[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((first, end, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, d - c) for a, b, c, d in found]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope (over 0) of the curve, by Newton steps, halved until they gain; a small penalty keeps separable samples finite."""
    x1, at = np.column_stack((np.ones(len(x)), x)), np.zeros(2)
    loss = lambda v: float(np.logaddexp(0, x1 @ v).sum() - y @ (x1 @ v) + 0.05 * v @ v)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x1 @ at, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), x1.T @ (p - y) + 0.1 * at)
        while loss(at - step) > loss(at) and abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if abs(step).max() < 1e-8:
            break
    return float(at[0]), float(max(at[1], 1e-3))


class Model:
    def __init__(self, counts: np.ndarray) -> None:
        self.weights, self.rate, self.log_k, self.curve = weights(counts), 1.0, 0.0, (-4.0, 1.0)

    def fit_rivals(self, best: np.ndarray, n: np.ndarray, moments: np.ndarray) -> None:
        """Lambda and K from clean texts' best segments, tokens and moments in the learning sample."""
        self.rate = growth_rate(moments)
        # clean texts' best scores follow exp(-K n exp(-lambda S)); the likeliest K by its closed form
        hazard = n * np.exp(-self.rate * best)
        self.log_k = math.log(len(hazard) / hazard.sum()) if hazard.sum() > 0 else 0.0

    def fit_curve(self, x: np.ndarray, y: np.ndarray) -> None:
        """The curve from the evidence and the labels of the learning sample."""
        a, b = self.curve
        if 0 < y.sum() < len(y):
            a, b = logistic(np.minimum(x, 40.0), y)
        self.curve = (a, b)

    def excess(self, score: float, n: int) -> float:
        """lambda S - ln(K n); minus this is the log of the number of rivals expected by chance."""
        return self.rate * score - self.log_k - math.log(max(n, 1))

    def evidence(self, scores: list[float], n: int) -> float:
        """Minus the log of the least p-value among the best 1, 2, ... segments taken together; 0 without any."""
        best, total = 0.0, 0.0
        for r, score in enumerate(scores, 1):
            total += self.excess(score, n)
            if total <= 0 and r > 1:
                break
            if r == 1:
                log_p = math.log(max(-math.expm1(-math.exp(min(-total, 30.0))), 1e-300)) if total < 30 else -total
            else:  # the sum statistic's tail, and a factor for the choice of r
                log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + math.log(r)
            best = max(best, -log_p)
        return best

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * min(evidence, 40.0)))))


def moments_of(w: np.ndarray) -> np.ndarray:
    """Sums of exp(rate x weight) over a text's tokens, for each of RATES."""
    total = np.zeros(len(RATES))
    for i in range(0, len(w), 4096):
        total += np.exp(np.outer(RATES, w[i : i + 4096])).sum(1)
    return total


class Scanner:
    def __init__(self, table: np.ndarray) -> None:
        self.table, self.known = table, {}

    def __call__(self, text: str) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        tokens = TOKEN.findall(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for t in set(tokens).difference(known):
            own = self.table[buckets(t)]
            known[t] = float(own[np.abs(own).argmax()]) - DRIFT
        w = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
        return w, segments(w)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = (Counter(), Counter())
    for b in batches:
        for label, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words[label].update({i for t in set(TOKEN.findall(text)) for i in buckets(t)})  # a document counts once
    total = np.zeros((2, TOKENS), np.int64)
    for label in (0, 1):
        total[label, list(words[label])] = list(words[label].values())
    some = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0, some]), pa.array(total[1, some])], names=["bucket", "clean", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic 0 or 1); of conflicting labels of a document 1 counts."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    # at most 2 x sample rows of two numbers
    rows = written(docs.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "toxic", "text"))
    found = rows.mapInArrow(_counted, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # at most TOKENS rows
    counts = np.zeros((2, TOKENS), np.int64)
    counts[:, found.column(0).to_numpy()] = (found.column(1).to_numpy(), found.column(2).to_numpy())
    model = Model(counts)
    table_ = docs.sparkSession.sparkContext.broadcast(model.weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan_ = Scanner(table_.value)
        for b in batches:
            made = [scan_(x.as_py()) for x in b.column(2)]
            scores = [sorted((s for _, _, s in x[1]), reverse=True) for x in made]
            moments = [moments_of(x[0]).tolist() for x in made]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(scores, pa.list_(pa.float64())), pa.array([len(x[0]) for x in made], pa.int64()), pa.array(moments, pa.list_(pa.float64()))], names=["label", "scores", "n", "moments"])

    scanned = written(rows.mapInArrow(scan, "label int, scores array<double>, n long, moments array<double>"))
    clean = scanned.where("label = 0 and n > 0").select(F.coalesce(F.try_element_at("scores", F.lit(1)), F.lit(0.0)), "n", "moments").toArrow()  # `sample` rows at most
    if not clean.num_rows:
        return model
    n = clean.column(1).to_numpy().astype(float)
    model.fit_rivals(clean.column(0).to_numpy(), n, np.sum(clean.column(2).to_pylist(), axis=0) / n.sum())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.evidence(s, k) for s, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["label", "evidence"])

    weighed = scanned.select("label", "scores", "n").mapInArrow(weigh, "label int, evidence double").toArrow()  # 2 x sample rows at most
    model.fit_curve(weighed.column(1).to_numpy(), weighed.column(0).to_numpy().astype(float))
    return model


FOUND = "doc_id long, score double, evidence double, passages array<struct<start: int, end: int, score: double>>"


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, evidence, passages) of every row: the probability of label 1, and the significant toxic passages.

    Passages are in code points, end exclusive. Null and empty texts, and those without a word, have the score of no evidence
    and no passages. Texts of any length are scanned whole and all their segments count. Repeated rows score alike; other columns are ignored; an
    empty table gives no rows; without labels all weights are equal and no text has a passage.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scan = Scanner(model.weights)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            out = []
            for value in b.column(1):
                text = value.as_py()
                w, found = scan(text)
                evidence = model.evidence(sorted((s for _, _, s in found), reverse=True), len(w))
                some = [x for x in found if model.excess(x[2], len(w)) > -math.log(SIGNIFICANT)]
                places = [m.span() for m in TOKEN.finditer(text)] if some else []
                out.append((model.score(evidence), evidence, [{"start": places[i][0], "end": places[j - 1][1], "score": s} for i, j, s in some]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], k) for i, k in enumerate((pa.float64(), pa.float64(), kind)))], names=["doc_id", "score", "evidence", "passages"])

    return only(docs, doc_id, text).mapInArrow(run, FOUND)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = only(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(remainder("doc_id", 3) != 1))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
