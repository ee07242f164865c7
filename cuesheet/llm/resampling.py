"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target than in the corpus.

N-grams of a batch are interned in an open-addressed table: keys are XXH64 of an n-gram's bytes, places are probed one after the other, and an
entry counts as met only if all bytes agree. A slot holds the n-gram's bucket and its count; each occurrence keeps its slot, through which it
finds its bucket's gain. Counts of buckets are summed in tasks first, and 10,000 sums are all that leaves a task.

Drawing is by the Gumbel trick: the highest of weight plus noise are a sample without replacement in proportion to exp(weight). Ranks come
from a sort by ranges and the number of rows in the ranges before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import only, table, written
from cuesheet.llm.tokens import batches_of

BUCKETS, LEAST_WORDS, PERCENT, SEED, PER_MILLE = 10_000, 20, 25, 7, 1000
SEPARATOR = 0x20
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
#: of bytes after lower-casing: digits, a to z, and all of characters beyond ASCII
IN_WORD = np.zeros(256, bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[128:] = True
#: fixed values: the primes of XXH64
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: n-grams of fewer bytes are hashed and compared together, the others one by one
SHORT = 32
BATCH_BYTES = 1 << 20


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


class Grams:
    """The n-grams of one to two words of a batch of texts: where each begins in `data`, its length, and the text's row."""

    def __init__(self, texts: pa.Array) -> None:
        rows = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
        raw = LOWERED[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]]]
        rows = rows - rows[0]
        inside = IN_WORD[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = rows[(rows > 0) & (rows < len(raw))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sizes, of = ends - starts, np.searchsorted(rows, starts, side="right") - 1
        at = np.cumsum(sizes + 1) - sizes - 1
        self.data = np.full(int((sizes + 1).sum()) + SHORT, SEPARATOR, np.uint8)
        self.data[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = raw[inside]
        two = np.flatnonzero(of[1:] == of[:-1])
        self.start = np.concatenate((at, at[two]))
        self.size = np.concatenate((sizes, sizes[two] + 1 + sizes[two + 1]))
        self.row = np.concatenate((of, of[two]))
        self.words = np.bincount(of, minlength=len(texts))
        self.n_features = np.bincount(self.row, minlength=len(texts))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def lanes(self) -> np.ndarray:
        """Of short n-grams: their bytes as four numbers of 64 bits, zeros after the end."""
        words = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        out = np.zeros((4, len(self.start)), np.uint64)
        for k in range(4):
            left = np.minimum(self.size - 8 * k, 8)
            some = np.flatnonzero((left > 0) & (self.size < SHORT))
            out[k, some] = words[self.start[some] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left[some].astype(np.uint64) * np.uint64(8)))
        return out

    def keys(self, lanes: np.ndarray) -> np.ndarray:
        """XXH64 with seed 0, of n-grams under 32 bytes all at once."""
        h = P5 + self.size.astype(np.uint64)
        for k in range(3):
            some = np.flatnonzero((self.size >= 8 * k + 8) & (self.size < SHORT))
            h[some] = _turned(h[some] ^ _turned(lanes[k, some] * P2, 31) * P1, 27) * P1 + P4
        whole = self.size // 8
        tail = lanes[np.minimum(whole, 3), np.arange(len(self.size))]
        rest = self.size % 8
        some = np.flatnonzero(rest >= 4)
        h[some] = _turned(h[some] ^ (tail[some] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        done = np.where(rest >= 4, 4, 0)
        for _ in range(3):
            some = np.flatnonzero(done < rest)
            h[some] = _turned(h[some] ^ (tail[some] >> (done[some] * 8).astype(np.uint64) & np.uint64(0xFF)) * P5, 11) * P1
            done[some] += 1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(self.size >= SHORT).tolist():
            h[i] = xxhash.xxh64_intdigest(self.bytes_of(i))
        return h


class GramTable:
    """An open-addressed table of the distinct n-grams of a batch; `slot` is each occurrence's."""

    def __init__(self, grams: Grams, keys: np.ndarray | None = None) -> None:
        n, lanes = len(grams.start), grams.lanes()
        keys = grams.keys(lanes) if keys is None else keys
        mask = (1 << max(4, int(2 * n).bit_length())) - 1
        owner, self.slot, open_ = np.full(mask + 1, -1, np.int64), (keys & np.uint64(mask)).astype(np.int64), np.arange(n)
        while len(open_):
            place = self.slot[open_]
            free = owner[place] < 0
            owner[place[free]] = open_[free]
            met = owner[place]
            same = (keys[met] == keys[open_]) & (grams.size[met] == grams.size[open_]) & (lanes[:, met] == lanes[:, open_]).all(axis=0)
            for i in np.flatnonzero(same & (grams.size[open_] >= SHORT) & (met != open_)).tolist():
                same[i] = grams.bytes_of(met[i]) == grams.bytes_of(open_[i])
            open_ = open_[~same]
            self.slot[open_] = (self.slot[open_] + 1) & mask
        self.count = np.bincount(self.slot, minlength=mask + 1)
        self.bucket = np.zeros(mask + 1, np.int64)
        used, data = np.flatnonzero(owner >= 0), grams.data.tobytes()
        first = grams.start[owner[used]].tolist()
        last = (grams.start + grams.size)[owner[used]].tolist()
        self.bucket[used] = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(first, last, strict=True)), np.int64, len(used)) % BUCKETS


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket that has any. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for part in batches_of(batches, 0, size=BATCH_BYTES):
            found = GramTable(Grams(part.column(0)))
            sums += np.bincount(found.bucket, found.count, BUCKETS).astype(np.int64)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["bucket", "n"])

    return docs.select(F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all buckets: 1000 times the logarithm of the smoothed rates' quotient, rounded down."""
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    both = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0)
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    of_all = Window.partitionBy()  # of BUCKETS rows
    all_s, all_t = F.sum("s").over(of_all).cast("double"), F.sum("t").over(of_all).cast("double")
    return both.select("bucket", F.floor(PER_MILLE * F.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).alias("gain"))


def document_weights(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; weight is the mean of its n-grams' gains, rounded down, and 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches, 1, size=BATCH_BYTES):
            grams = Grams(part.column(1))
            found = GramTable(grams)
            gain = gains[found.bucket][found.slot]
            order = np.argsort(grams.row, kind="stable")
            ends = np.append(0, np.cumsum(gain[order]))
            cuts = np.append(0, np.cumsum(grams.n_features))
            sums = ends[cuts[1:]] - ends[cuts[:-1]]
            weight = sums // np.maximum(grams.n_features, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in (grams.words, grams.n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return only(docs, doc_id, text).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, score: str, tie: str) -> DataFrame:
    """The rows with `place`, 1 for the highest score and the smallest tie; equal rows as they come.

    Rows are dealt by ranges of score, tie and their number, so that any number of equal ones may be dealt to several tasks; a row's place is its place in its task
    and the rows in the tasks before, of which there is one sum for each task.
    """
    rows = written(rows.withColumn("nr", F.monotonically_increasing_id()))
    order = [F.desc(score), F.asc(tie), F.asc("nr")]
    at = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("nr").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    tasks = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = tasks.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return at.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row: `rank` counts the rows drawn, `percent` of those with `least_words` words, and is null for the others.

    A null or empty text has no features and weight 0. A null doc_id is hashed like an empty one and comes before others at equal scores; repeated
    rows are rows of their own with equal scores. Texts of any length count whole. Of `target` only the column `text` is read; its null texts have no n-grams, and without any n-gram the
    gains still are defined. Other columns are ignored; an empty table gives no rows.
    """
    gains = np.zeros(BUCKETS, np.int64)
    for bucket, gain in bucket_gains(bucket_counts(docs, text), bucket_counts(target)).collect():  # BUCKETS rows
        gains[bucket] = gain
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-PER_MILLE * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weights = document_weights(docs, gains, doc_id, text).withColumn("score", F.col("weight") + noise)
    placed = ranked(weights.withColumn("order", F.struct((F.col("n_words") >= least_words).alias("may"), "score")), "order", "doc_id")
    n = placed.where(F.col("n_words") >= least_words).count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when((F.col("n_words") >= least_words) & (F.col("place") <= n), F.col("place")).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
