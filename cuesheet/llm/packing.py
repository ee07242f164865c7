"""Packing documents into fixed-length sequences: shortest pack first over the length histogram.

A document gives whole sequences of its own while it has LENGTH ids left; what remains (under LENGTH ids) is packed. Packing sees
only the histogram of remainders: lengths are placed longest first, each into the packs that hold least, as counts of
equal packing patterns. Packs that would stay emptiest are then taken apart and their documents cut to fill the gaps of the
others, but for gaps under MIN_GAP. Patterns are joined back to documents by the document's rank among those of its length.

Ranks need no total order: documents are spread over BUCKETS by hash, ranked inside a bucket and length, and the counts of
all buckets and lengths (at most BUCKETS x LENGTH numbers, whatever the corpus) say where a bucket's ranks begin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import only, table, written
from cuesheet.llm.tokens import Encoder, batches_of

LENGTH, END, BUCKETS, MIN_GAP = 1024, 0, 256, 16


@dataclass(frozen=True)
class Item:
    """Equally long parts of documents of one length: the ranks from `rank` on, ids from `start` on."""

    length: int
    rank: int
    start: int
    size: int
    part: int = 0


@dataclass(frozen=True)
class Packs:
    """`count` packs of one pattern: items, the pack's number counting on with the rank."""

    count: int
    items: tuple[Item, ...]
    used: int

    def after(self, n: int) -> Packs:
        return Packs(self.count - n, tuple(replace(x, rank=x.rank + n) for x in self.items), self.used)

    def first(self, n: int) -> Packs:
        return replace(self, count=n)

    def holding(self, item: Item) -> Packs:
        return Packs(self.count, (*self.items, item), self.used + item.size)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Packs]:
    """Patterns with counts; the ranks of a length are used up in order."""
    by_used: dict[int, list[Packs]] = {}
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        for used in sorted(u for u in by_used if u + length <= capacity):
            while left and by_used.get(used):
                packs = by_used[used].pop()
                n = min(left, packs.count)
                if n < packs.count:
                    by_used[used].append(packs.after(n))
                by_used.setdefault(used + length, []).append(packs.first(n).holding(Item(length, rank, 0, length)))
                left, rank = left - n, rank + n
        # packs filled just now may take more of the same length before a new one is opened
        while left:
            room = sorted(u for u in by_used if by_used[u] and u + length <= capacity)
            if room:
                packs = by_used[room[0]].pop()
                n = min(left, packs.count)
                if n < packs.count:
                    by_used[room[0]].append(packs.after(n))
                by_used.setdefault(room[0] + length, []).append(packs.first(n).holding(Item(length, rank, 0, length)))
                left, rank = left - n, rank + n
                continue
            each = capacity // length
            for n, times in ((left // each, each), (1, left % each)):
                if n and times:
                    packs = Packs(n, (), 0)
                    for k in range(times):
                        packs = packs.holding(Item(length, rank + k * n, 0, length))
                    by_used.setdefault(packs.used, []).append(packs)
                    rank += n * times
            left = 0
    return [x for group in by_used.values() for x in group]


def fill_gaps(packs: list[Packs], capacity: int, min_gap: int) -> list[Packs]:
    """Takes the emptiest packs apart and cuts their items to fill the gaps of the others."""
    gaps = sorted((x for x in packs if capacity - x.used >= min_gap), key=lambda x: (x.used, x.items[0].length, x.items[0].rank))
    kept = [x for x in packs if capacity - x.used < min_gap]
    spare = sum(x.count * (capacity - x.used) for x in gaps) // capacity  # so many packs' ids fit into the others' gaps
    items: list[tuple[Item, int]] = []
    while spare and gaps:
        n = min(spare, gaps[0].count)
        items += [(x, n) for x in gaps[0].first(n).items]
        if n < gaps[0].count:
            gaps[0] = gaps[0].after(n)
        else:
            gaps.pop(0)
        spare -= n
    gaps.reverse()  # the emptiest is next
    items.sort(key=lambda x: (x[0].size, x[0].length, x[0].rank))  # the longest is next
    while items and gaps:
        (item, n), gap = items.pop(), gaps.pop()
        m, size = min(n, gap.count), min(item.size, capacity - gap.used)
        if n > m:
            items.append((replace(item, rank=item.rank + m), n - m))
        if gap.count > m:
            gaps.append(gap.after(m))
        full = gap.first(m).holding(replace(item, size=size))
        (kept if full.used == capacity else gaps).append(full)
        if item.size > size:
            items.append((replace(item, start=item.start + size, size=item.size - size, part=item.part + 1), m))
    # what found no gap keeps its own packs
    return kept + gaps + [Packs(n, (x,), x.size) for x, n in items]


def plan(histogram: dict[int, int], capacity: int = LENGTH, min_gap: int = MIN_GAP) -> tuple[dict[str, np.ndarray], int]:
    """Where each part goes: rows by (part, length, first rank), and the number of packs."""
    packs = fill_gaps(shortest_pack_first(histogram, capacity), capacity, min_gap)
    rows, base = [], 0
    for x in packs:
        offset = 0
        for item in x.items:
            rows.append((item.part, item.length, item.rank, x.count, item.start, item.size, base, offset))
            offset += item.size
        base += x.count
    rows.sort()
    names = ("part", "length", "rank", "count", "start", "size", "pack", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T, strict=True)), base


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(row, doc_id, n, ids): the ids of each document and the end id, as little-endian unsigned 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = None, np.array([end], "<u2").tobytes()
        for part in batches_of(batches, 2):
            encode = encode or Encoder(tokenizer, blanks_dropped=False)
            ids = [x + closing for x in encode(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "n", "ids"])

    rows = only(docs, doc_id, text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, "row long, doc_id long, n long, ids binary")


PLACE = "row long, starts array<long>, lengths array<long>, sequences array<long>, offsets array<long>"


def places(lengths: DataFrame, capacity: int = LENGTH, min_gap: int = MIN_GAP, buckets: int = BUCKETS) -> DataFrame:
    """For rows (row, n): the pieces of each, as arrays starts, lengths, sequences and offsets."""
    parts = lengths.select("row", F.floor(F.col("n") / capacity).alias("whole"), (F.col("n") % capacity).cast("int").alias("rest"), F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"))
    counts = parts.groupBy("rest", "bucket").agg(F.count("*").alias("docs"), F.sum("whole").alias("whole")).toArrow()  # at most capacity x buckets rows
    docs, whole = np.zeros((capacity, buckets), np.int64), np.zeros((capacity, buckets), np.int64)
    rest, bucket, n, n_whole = (counts.column(i).to_numpy() for i in range(4))
    docs[rest, bucket], whole[rest, bucket] = n, n_whole
    placed, packs = plan({i: int(n) for i, n in enumerate(docs.sum(1)) if i and n}, capacity, min_gap)
    first_rank = np.cumsum(docs, axis=1) - docs
    first_whole = packs + (np.cumsum(whole) - whole.ravel()).reshape(whole.shape)
    shift = int(docs.sum()) + 1  # keys (length, rank) as one number
    levels = []
    for k in range(int(placed["part"].max(initial=-1)) + 1):
        at = placed["part"] == k
        levels.append((placed["length"][at] * shift + placed["rank"][at], {x: placed[x][at] for x in ("count", "start", "size", "pack", "offset")}))
    model = lengths.sparkSession.sparkContext.broadcast((first_rank, first_whole, shift, levels))

    order = Window.partitionBy("rest", "bucket").orderBy("row")
    ranked = parts.select("row", "whole", "rest", "bucket", F.row_number().over(order).alias("nr"), (F.sum("whole").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_rank, first_whole, shift, levels = model.value
        for b in batches:
            row, whole, rest, bucket, nr, before = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            found = [[] for _ in range(5)]  # index into the batch, start, length, sequence, offset

            def add(*columns: np.ndarray) -> None:
                for x, c in zip(found, columns, strict=True):
                    x.append(c)

            which = np.repeat(np.arange(len(row)), whole)
            k = np.arange(len(which)) - np.repeat(np.cumsum(whole) - whole, whole)
            add(which, k * capacity, np.full(len(k), capacity), (first_whole[rest, bucket] + before)[which] + k, np.zeros(len(k), np.int64))
            some = np.flatnonzero(rest)
            rank = first_rank[rest, bucket] + nr - 1
            key = rest * shift + rank
            for keys, x in levels:
                at = np.searchsorted(keys, key[some], side="right") - 1
                inside = (at >= 0) & (keys[at] // shift == rest[some]) & (key[some] < keys[at] + x["count"][at])
                some, at = some[inside], at[inside]
                add(some, whole[some] * capacity + x["start"][at], x["size"][at], x["pack"][at] + key[some] - keys[at], x["offset"][at])
            columns = [np.concatenate(x) for x in found]
            order = np.lexsort((columns[1], columns[0]))
            ends = np.searchsorted(columns[0][order], np.arange(len(row) + 1))
            arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c[order], pa.int64())) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["row", "starts", "lengths", "sequences", "offsets"])

    return ranked.mapInArrow(run, PLACE)


PIECE = "doc_id long, start long, length long, sequence_id long, offset long, doc_tokens long"


def pack(tokens: DataFrame, capacity: int = LENGTH, min_gap: int = MIN_GAP, checksums: bool = False) -> DataFrame:
    """(doc_id, start, length, sequence_id, offset, doc_tokens, ids) of every piece, from rows (row, doc_id, n, ids).

    Every id lies in one piece; a sequence's pieces follow each other from offset 0 and hold `capacity` ids at most. With
    `checksums` there is ids_crc32 (of the ids as unsigned 32-bit integers) instead of ids. `tokens` is read twice and so should
    be a table. No rows give no pieces; equal ids and repeated documents are packed like any other.
    """
    found = tokens.select("row", "doc_id", "n", "ids").join(places(tokens.select("row", "n"), capacity, min_gap), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 2):
            counts = pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False)
            starts, lengths, sequences, offsets = (b.column(i).flatten() for i in range(3, 7))
            owner, last = pa.array(np.repeat(np.arange(b.num_rows), counts)), []
            ids = b.column(2)
            for i, s, k in zip(owner.to_pylist(), starts.to_pylist(), lengths.to_pylist(), strict=True):
                part = ids[i].as_buffer()[2 * s : 2 * (s + k)]
                last.append(zlib.crc32(np.frombuffer(part, "<u2").astype("<u4")) if checksums else part.to_pybytes())
            columns = [b.column(0).take(owner), starts, lengths, sequences, offsets, b.column(1).take(owner), pa.array(last, pa.int64() if checksums else pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "sequence_id", "offset", "doc_tokens", "ids_crc32" if checksums else "ids"])

    columns = found.select("doc_id", "n", "ids", "starts", "lengths", "sequences", "offsets")
    return columns.mapInArrow(run, f"{PIECE}, {'ids_crc32 long' if checksums else 'ids binary'}")


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with a checksum instead of the ids.

    A null text counts as empty and gives one id, the end. Texts of any length are encoded whole and cut into pieces. Rows without doc_id and
    repeated rows are packed like any other; other columns are ignored; an empty table gives no pieces.
    """
    return pack(written(encoded(docs, tokenizer, doc_id, text)), checksums=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents, as `packed` gives them: its cases hold here too."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
