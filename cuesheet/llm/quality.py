"""Quality classifier from weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller votes good (1), bad (0) or abstains (-1) on a text. The counts of all vote patterns over the whole corpus, at most
3 ** 9 rows, are all that the model of the labellers needs: it takes a labeller's votes as independent given the text's true class, and
alternates between each pattern's posterior and each labeller's rates until they settle. Posteriors are then the soft labels
of at most SAMPLE different documents (those whose hash of id and text is smallest; a documented bound) that train a logistic scorer on FEATURES hashed
shape features. The scorer judges every document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import only, table

FEATURES, SAMPLE, THRESHOLD = 1 << 11, 5000, 0.5
GOOD, BAD, ABSTAIN = 1, 0, -1
FALSE_ALARMS = 0.004
#: punctuation of sentences; any other is an odd symbol
PLAIN = ".,;:'-\"()"


def byte_classes() -> bytes:
    """Of each byte: letters (and all bytes beyond ASCII) 0, capitals 1, digits 2, line feed 3, other blanks 4, sentence punctuation 5, other from 6 on."""
    made = bytearray(256)
    for b in range(128):
        c = chr(b)
        made[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == "\n" else 4 if c.isspace() or b < 32 or b == 127 else 5 if c in PLAIN else 6 + b % 26
    return bytes(made)


CLASSES = byte_classes()


def classes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass").translate(CLASSES), np.uint8)


def measures(text: str) -> dict[str, float]:
    """What the labellers look at."""
    data = classes(text)
    counts = np.bincount(data, minlength=32)
    solid = (data != 3) & (data != 4)
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1]))) if len(data) else np.zeros(0, np.int64)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = len(words), max(1, len(starts))
    odd = np.add.reduceat((data > 5).astype(np.int32), starts) if len(starts) else starts
    plain = np.add.reduceat((data < 3).astype(np.int32), starts) if len(starts) else starts
    return {
        "words": n,
        "symbols": counts[6:].sum() / max(1, len(data)),
        "capitals": counts[1] / max(1, counts[0] + counts[1]),
        "twice": sum(map(eq, words, words[1:])) / n if n else 0.0,
        "distinct": len(set(words)) / n if n else 1.0,
        "commonest": max(Counter(words).values()) / n if n else 0.0,
        "same_line": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "word_length": solid.sum() / m,
        "alone": (plain == 0).sum() / m,
        "clean_words": (odd == 0).sum() / m,
    }


def votes(m: dict[str, float]) -> list[int]:
    """Of the nine labellers. Most know one fault and else abstain; those of repetition abstain on texts of under 20 words."""
    n = m["words"]
    return [
        BAD if m["symbols"] >= 0.06 else ABSTAIN,
        BAD if m["capitals"] >= 0.6 and n >= 5 else ABSTAIN,
        BAD if m["twice"] >= 0.3 and n >= 20 else ABSTAIN,
        ABSTAIN if n < 20 else BAD if m["distinct"] <= 0.2 else GOOD if m["distinct"] >= 0.5 else ABSTAIN,
        ABSTAIN if n < 20 else BAD if m["commonest"] >= 0.3 else GOOD if m["commonest"] <= 0.1 else ABSTAIN,
        BAD if m["same_line"] >= 0.5 and n >= 20 else ABSTAIN,
        BAD if m["word_length"] >= 14 and n >= 5 else ABSTAIN,
        BAD if m["alone"] >= 0.2 and n >= 5 else ABSTAIN,
        GOOD if m["clean_words"] >= 0.9 else BAD if m["clean_words"] <= 0.5 and n >= 5 else ABSTAIN,
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shares of hashed triples of character classes, runs taken as one, and bands of the measures."""
    data = classes(text).astype(np.int64)
    if len(data):
        data = data[np.concatenate(([True], np.diff(data) != 0))]
    made = np.zeros(FEATURES)
    if len(data) > 2:
        code = (data[:-2] * 32 + data[1:-1]) * 32 + data[2:]
        made = np.sqrt(np.bincount((code * 0x9E3779B1 >> 16) % FEATURES, minlength=FEATURES) / (len(data) + 100))  # little is said of short texts
    for i, (name, x) in enumerate(sorted(measures(text).items())):
        if name != "words" and (len(text) > 150 or name not in ("distinct", "commonest", "same_line", "twice")):
            band = min(20, int(x * (1 if name == "word_length" else 20)))
            made[(((i + 1) * 64 + band) * 0x85EBCA6B >> 7) % FEATURES] += 1.0
    at = np.flatnonzero(made)
    return at, made[at]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, rates) from distinct vote patterns and their counts.

    rates[labeller, vote + 1, class]. It starts from two bad votes meaning bad. That a bad vote on a good text is rare (FALSE_ALARMS) is a prior
    as strong as half the corpus: otherwise the two classes may become one kind of fault and all other texts.
    """
    bad = (patterns == BAD).sum(1)
    posterior = np.where(bad == 0, 0.97, np.where(bad == 1, 0.5, 0.03))
    masks = [[(patterns[:, j] == v).astype(float) for v in (ABSTAIN, BAD, GOOD)] for j in range(patterns.shape[1])]
    for _ in range(rounds):
        weight = np.stack((1 - posterior, posterior)) * counts
        share = (weight.sum(1) + 1) / (counts.sum() + 2)
        rates = np.array([[weight @ x for x in m] for m in masks]) + 0.5
        for j, m in enumerate(masks):
            other = np.array([m[0] @ counts + 1, m[2] @ counts + 1])
            other *= (1 - FALSE_ALARMS) / other.sum()
            rates[j, :, 1] += counts.sum() / 2 * np.array([other[0], FALSE_ALARMS, other[1]])
        rates /= rates.sum(1, keepdims=True)
        logs = np.log(share)[:, None] + sum(np.log(rates[j][patterns[:, j] + 1]).T for j in range(len(masks)))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        settled, posterior = abs(new - posterior).max() < 1e-9, new
        if settled:
            break
    return posterior, rates


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer on soft labels, by gradient descent with momentum, from zero."""
    w, b, vw, vb = np.zeros(x.shape[1], x.dtype), 0.0, np.zeros(x.shape[1], x.dtype), 0.0
    y = y.astype(x.dtype)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        vw, vb = 0.9 * vw - 1.0 * (x.T @ (p - y) / len(y) + penalty * w), 0.9 * vb - 1.0 * float((p - y).mean())
        w, b = w + vw, b + vb
    return w, b


class Model:
    def __init__(self, weights: np.ndarray, offset: float, rates: np.ndarray | None) -> None:
        self.weights, self.offset, self.rates = weights, offset, rates

    def score(self, text: str) -> float:
        at, values = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ values + self.offset, -30, 30))))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each pattern (its votes as digits) in this task."""
    found: Counter = Counter()
    for b in batches:
        found.update("".join(str(v + 1) for v in votes(measures(x.as_py()))) for x in b.column(1))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        made = [features(x) for x in texts]
        patterns = ["".join(str(v + 1) for v in votes(measures(x))) for x in texts]
        yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.string()), pa.array([x[0] for x in made], pa.list_(pa.int64())), pa.array([x[1] for x in made], pa.list_(pa.float64()))], names=["pattern", "at", "value"])


def picked(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Of the different documents (id and text) the `sample` with the smallest hash, once each."""
    hashed = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"))
    n = hashed.select("hash").distinct().count()
    # only twice as many as needed, on average, are put in order
    low = hashed.where(F.pmod("hash", F.lit(1 << 32)) < min(1.0, 2 * sample / max(n, 1)) * 2.0**32)
    return low.dropDuplicates(["hash"]).orderBy(F.pmod("hash", F.lit(1 << 32)), "hash").limit(sample).select("doc_id", "text")


def learn(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """From documents (doc_id, text); no labels are read."""
    found = rows.mapInArrow(_voted, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()  # 3 ** 9 rows at most
    if not found.num_rows:
        return Model(np.zeros(FEATURES), 0.0, None)
    names = found.column(0).to_pylist()
    counts = found.column(1).to_numpy().astype(float)
    posterior, rates = expectation_maximisation(np.array([[int(c) - 1 for c in x] for x in names]), counts)
    soft = dict(zip(names, posterior.tolist(), strict=True))
    some = picked(rows, sample).mapInArrow(_described, "pattern string, at array<long>, value array<double>").toArrow()
    if not some.num_rows:
        return Model(np.zeros(FEATURES), 0.0, rates)
    x = np.zeros((some.num_rows, FEATURES), np.float32)
    for i, (at, value) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)):
        x[i, at] = value
    return Model(*train(x, np.array([soft[p] for p in some.column(0).to_pylist()])), rates)


def judge(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, kept) of every row; score is the probability that the text is good, kept that it reaches `threshold`.

    Null and empty texts are scored alike, by the scorer; texts of any length are read whole; repeated rows score alike; other columns are
    ignored; an empty table gives no rows. With nothing learned every score is one half, and all are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([shared.value.score(x.as_py()) for x in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(scores >= threshold, pa.bool_())], names=["doc_id", "score", "kept"])

    return only(docs, doc_id, text).mapInArrow(run, "doc_id long, score double, kept boolean")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return judge(docs, learn(docs))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier keeps stay.

    A null text counts as empty, and empty texts are scored like any other; texts of any length are read whole. Repeated rows and rows without
    doc_id are judged by their text. Other columns, whatever their names, go with the row unchanged. An empty table stays empty.
    """
    model = spark.sparkContext.broadcast(learn(only(docs, "doc_id", "text")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.value.score(x.as_py() or "") >= THRESHOLD for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
