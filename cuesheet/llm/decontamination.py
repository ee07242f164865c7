"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-case words (in scripts written without blanks: of characters), kept as 64-bit
hashes. Seeds are runs of MIN_MATCH words; a shorter item is one seed. A bitmap over the benchmark's seeds, of 2^30 bits at most, tells
which runs of a document may be shared; only those runs leave the document.

An item covered to THRESHOLD by tiles shares at least so many seeds with the document that one of them is among its rarest, those
that the fewest items have. Documents and items that share one of these are found by an equality join on the seed, so that turns of
phrase which many items have pair nothing; of these pairs only those are kept whose shared seeds could cover enough. Both are bounds, no pair
that reaches the threshold is lost.

Each pair is tiled: the longest common runs that don't overlap are marked, longest first, until none of MIN_MATCH words is left, finding
them by Karp-Rabin hashes of falling length. The passages may come in any order.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import numbered, table, written

# Unicode ranges of scripts that are written without blanks between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"[{UNSPACED}]|[^\\W_{UNSPACED}]+")
MIN_MATCH, THRESHOLD, REMEMBERED = 4, 0.6, 500_000
#: of the bitmap: bits for each seed, and the least and most bits of all, as powers of two
BITS_A_SEED, LEAST_BITS, MOST_BITS = 16, 20, 30
PRIME, BASE, MODULUS = np.uint64(0x9E3779B97F4A7C15), 1_000_003, (1 << 61) - 1


class Hashed:
    """Texts as arrays of their words' hashes."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text.lower()), self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 7)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray, size: int = MIN_MATCH) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    made = np.full(n, size, np.uint64)
    for i in range(size):
        made = (made ^ words[i : i + n]) * PRIME
        made ^= made >> np.uint64(29)
    return made.view(np.int64)


def tiles(item: list[int], text: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Non-overlapping common runs (place in item, place in text, length), longest first; None in `text` matches nothing."""
    free_item, free_text, found = [True] * len(item), [x is not None for x in text], []
    size = max(least, min(len(item), 32))

    def windows(values: list[int], free: list[bool]) -> Iterator[tuple[int, int]]:
        """(place, rolling hash) of each run of `size` unmarked words."""
        power, h, run = pow(BASE, size, MODULUS), 0, 0
        for i, (x, ok) in enumerate(zip(values, free, strict=True)):
            if not ok:
                h = run = 0
                continue
            h, run = (h * BASE + x) % MODULUS, run + 1
            if run > size:
                h = (h - values[i - size] * power) % MODULUS
            if run >= size:
                yield i - size + 1, h

    while True:
        places: dict[int, list[int]] = {}
        for i, h in windows(item, free_item):
            places.setdefault(h, []).append(i)
        queue, ends = [], {}
        for t, h in windows(text, free_text) if places else ():
            for i in places.get(h, ()):
                if ends.get(i - t, 0) > t:  # inside a match that was extended already
                    continue
                n = 0
                while i + n < len(item) and t + n < len(text) and free_item[i + n] and free_text[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n >= size:
                    ends[i - t] = t + n
                    queue.append((-n, i, t))
        heapq.heapify(queue)
        while queue:
            n, i, t = heapq.heappop(queue)
            free = [a and b for a, b in zip(free_item[i : i - n], free_text[t : t - n], strict=True)]
            if all(free):
                free_item[i : i - n] = free_text[t : t - n] = [False] * -n
                found.append((i, t, -n))
                continue
            for ok, run in groupby(range(-n), free.__getitem__):  # what longer tiles have left of it
                places_left = list(run)
                if ok and len(places_left) >= size:
                    heapq.heappush(queue, (-len(places_left), i + places_left[0], t + places_left[0]))
        if size == least:
            return found
        size = max(least, size // 2)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = Hashed()
    for b in batches:
        words = [hashed(x.as_py()) for x in b.column(1)]
        kind = pa.list_(pa.int64())
        made = [seeds(x, min(MIN_MATCH, max(1, len(x)))) for x in words]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in words], kind), pa.array(made, kind)], names=["item_id", "words", "seeds"])


def joining_seeds(items: DataFrame, threshold: float) -> DataFrame:
    """(item, seed): of each item (item, words, seeds) the rarest seeds, so many that a document which reaches the threshold has one of them.

    A tiled word lies in a shared seed, and a seed has MIN_MATCH words at most: at least threshold x words / MIN_MATCH of the item's
    seed places are shared. All places of the rarest seeds, but one fewer than that, are joined; the commonest are left out.
    """
    places = items.select("item", F.size("words").alias("n"), F.size("seeds").alias("n_seeds"), F.explode("seeds").alias("seed"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * threshold / MIN_MATCH - 1e-9))
    times = places.groupBy("item", "seed", "n", "n_seeds").agg(F.count("*").alias("times"))
    common = times.groupBy("seed").agg(F.count("*").alias("items"))
    w = Window.partitionBy("item").orderBy("items", "seed").rowsBetween(Window.unboundedPreceding, -1)
    ranked = times.join(common, "seed").withColumn("before", F.coalesce(F.sum("times").over(w), F.lit(0)))
    return ranked.where(F.col("before") <= F.col("n_seeds") - needed).select("item", "seed")


HITS = "key long, doc long, runs array<array<long>>, seeds array<long>"


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, doc, runs, seeds) of the documents (key, doc, text) that may share a seed: the runs of words, and the distinct seeds, that may be shared."""
    item_seeds = items.select(F.explode("seeds").alias("seed"))
    total = item_seeds.count()
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (total * BITS_A_SEED).bit_length()))
    sizes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(MIN_MATCH))).distinct().collect())  # MIN_MATCH at most
    at = F.pmod("seed", F.lit(size))
    bits = item_seeds.groupBy(F.floor(at / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")).toArrow()  # 2 ** MOST_BITS / 64 rows at most
    words = np.zeros(size // 64, np.int64)
    words[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, kind = Hashed(), pa.list_(pa.int64())
        for b in batches:
            keys, runs, some = [], [], []
            for i, text in enumerate(b.column(2)):
                words = hashed(text.as_py())
                edges, held = np.zeros(len(words) + 1, np.int32), []
                for n in sizes:
                    found = seeds(words, n)
                    at = found.view(np.uint64) & np.uint64(size - 1)
                    hits = np.flatnonzero(shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                    if len(hits):
                        edges[hits] += 1
                        edges[hits + n] -= 1
                        held.append(found[hits])
                if held:
                    covered = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(edges) > 0, [0])).astype(np.int8)))
                    keys.append(i)
                    runs.append([words[x:y].view(np.int64) for x, y in zip(covered[::2], covered[1::2], strict=True)])
                    some.append(np.unique(np.concatenate(held)))
            at = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(runs, pa.list_(kind)), pa.array(some, kind)], names=["key", "doc", "runs", "seeds"])

    return docs.mapInArrow(run, HITS)


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for runs, words in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            text = [x for r in runs for x in (*r, None)]
            found = tiles(words, text, min(MIN_MATCH, len(words)))
            out.append((sum(n for _, _, n in found) / len(words), len(found), max((n for _, _, n in found), default=0)))
        columns = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.float64(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc", "item_id", "coverage", "n_tiles", "longest"])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, item_id, coverage, n_tiles, longest) of each document and benchmark item (item_id, text) that it holds.

    Coverage is the share of the item's words that tiles of at least MIN_MATCH words cover; a shorter item is found where all of it
    stands. Null texts count as empty; items without words are in nothing. Whole texts of any length are read, in memory that grows with a text, not
    with the tables. Documents without key are reported under null, repeated rows of a document once for each. Items of one item_id
    but different texts are judged apart. Other columns are ignored; if either table is empty there are no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(key).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    raw = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = raw.mapInArrow(_items, "item_id long, words array<long>, seeds array<long>").where(F.size("words") > 0)
    items = written(hashed.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]))
    hits = written(candidates(rows, items))
    pairs = hits.select("key", F.explode("seeds").alias("seed")).join(written(joining_seeds(items, threshold)), "seed").select("key", "item").distinct()
    full = pairs.join(hits, "key").join(items.withColumnRenamed("seeds", "item_seeds"), "item")
    # each shared seed covers MIN_MATCH words at each of its places in the item at most
    places = F.aggregate(F.array_intersect("item_seeds", "seeds"), F.lit(0), lambda a, x: a + F.size(F.filter("item_seeds", lambda y: y == x)))
    repeated = F.size(F.array_distinct("item_seeds")) < F.size("item_seeds")
    most = F.when(repeated, places).otherwise(F.size(F.array_intersect("item_seeds", "seeds"))) * MIN_MATCH
    found = full.where(most >= F.size("words") * threshold - 1e-9).select("doc", "item_id", "runs", "words").mapInArrow(_tiled, "doc long, item_id long, coverage double, n_tiles int, longest int")
    return found.where(F.col("coverage") >= threshold).withColumnRenamed("doc", key)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item stay.

    A document whose text is null or empty holds none and stays, as does one without doc_id that holds none; repeated rows stay or go together.
    Texts of any length are read whole. Rows are told apart by a number of their own, so other columns, whatever their names, go with
    the row unchanged. An empty table stays empty; without benchmark items every row stays.
    """
    rows, row = numbered(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), key=row).select(row).distinct()
    return rows.join(written(found), row, "left_anti").select(docs.columns)
