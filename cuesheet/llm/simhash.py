"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a few bits by pigeonhole blocks.

Six blocks of 10 or 11 bits: fingerprints that differ in at most three bits agree on at least three whole blocks, so
they share one of the 20 keys made of three blocks (31 to 33 bits). Links are sought among distinct fingerprints only,
in groups that share a key. A group up to `group_limit` is one row, whose links are verified by Hamming distance and of
which a spanning forest is kept. In a larger group each fingerprint names the words within one and within two bits of
it (in the bits outside the key); two fingerprints are within three bits exactly if one has a word at one bit that the
other has at two. Rows then grow in proportion to the group, and no pair is lost.

The pipeline's stage asks for another similarity: a Jaccard similarity of 0.8 or more between sets of five-word shingles. Its
candidates are the rows that SimHash brings together: the components of fingerprints (of five-word shingles) within three bits. Texts at
0.8 are around 10 of 64 bits apart, which no layout of blocks reaches in few keys, so rows that share a band of least hashes are
candidates too. All of them are verified by their whole sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import numbered, only, settled, table, written
from cuesheet.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DISTANCE = 3
WIDTHS = (11, 11, 11, 11, 10, 10)
GROUP_LIMIT = 1024
# The pipeline's stage: shingles of five words, similarity from 0.8 on. A pair at 0.8 shares a band with probability 0.998.
STAGE_SIZE, SIMILAR, BANDS, BAND_ROWS, BAND_LIMIT, SKETCH = 5, Fraction(4, 5), 20, 6, 256, 1 << 18
FACTORS, SHIFTS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64, endpoint=False) | np.uint64(1)


def shingles(text: str, size: int = 3) -> list[str]:
    """Space-joined runs of `size` words, repeats included; of fewer words the whole sequence; of none nothing."""
    words = WORD.findall(text.translate(LOWER))
    if len(words) < size:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def hashed(parts: list[str]) -> np.ndarray:
    """The shingles' hashes, repeats included."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, 42) for x in parts), np.uint64, len(parts))


def majority(hashes: np.ndarray) -> int:
    """Bits that are 1 in more than half of the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    # 255 rows at a time, eight one-byte counters in each word
    sums = np.add.reduceat(bits, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64)
    return int(np.packbits(sums.sum(0, dtype=np.int64) * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, size: int = 3) -> int:
    """Bits that are 1 in more than half of the shingles' hashes; zero for a text without words."""
    return majority(hashed(shingles(text, size)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), size) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "fp"])

    return only(docs, doc_id, text).mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within `distance`, as many as a spanning forest needs."""
    label, out = np.arange(len(fps)), []
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance)
        for root in np.unique(label[near]):
            if root != label[i]:
                j = near[label[near] == root][0]
                out.append((int(fps[i].view(np.int64)), int(fps[j].view(np.int64))))
                label[label == root] = label[i]
    return out


def _masks() -> list[int]:
    ends = np.cumsum((0, *WIDTHS))
    blocks = [((1 << w) - 1) << int(ends[i]) for i, w in enumerate(WIDTHS)]
    return [sum(blocks[i] for i in kept) for kept in combinations(range(len(WIDTHS)), len(WIDTHS) - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keyed(fps: DataFrame) -> DataFrame:
    """A row for each fingerprint and mask: the masked bits are the key."""
    masks = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(_masks())))
    return fps.select("fp", F.explode(masks).alias("k")).select("fp", "k.mask", "k.part")


def _pairs_in_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [x for fps in b.column(0) for x in _forest(np.array(fps.as_py(), np.int64).view(np.uint64), DISTANCE)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint of a large group the words within one and two bits of it, outside the key."""
    masks = _masks()
    for b in batches:
        for i, fp in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
            free = np.array([1 << k for k in range(64) if not masks[i] >> k & 1], np.uint64)
            two = np.array([x | y for x, y in combinations(free, 2)], np.uint64)
            words = (np.concatenate((np.zeros(1, np.uint64), free, two)) ^ np.array([fp], np.int64).view(np.uint64)).view(np.int64)
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, fp)), pa.array(np.arange(n) <= len(free))], names=["word", "mask", "fp", "near"])


def links(fps: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp), enough to connect all that differ in at most three bits."""
    keyed = _keyed(fps)
    sizes = settled(keyed.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"))
    small = keyed.join(sizes.where(F.col("n") <= group_limit), ["mask", "part"]).groupBy("mask", "part").agg(F.collect_list("fp").alias("fps"))
    found = small.select("fps").mapInArrow(_pairs_in_rows, "u long, v long")
    large = keyed.join(sizes.where(F.col("n") > group_limit), ["mask", "part"]).select("fp", "mask")
    words = large.mapInArrow(_neighbours, "word long, mask int, fp long, near boolean")
    # at most 1 + 33 + 528 distinct fingerprints are that near to a word; with one at a single bit all of them are linked
    hubs = words.groupBy("word", "mask").agg(F.collect_set("fp").alias("fps"), F.max("near").alias("near"), F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"))
    star = hubs.where("near and size(fps) > 1").select(F.col("hub").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return found.union(star).distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reached over links of at most three bits.

    Repeated rows and equal texts share a fingerprint and so a component; texts without words have fingerprint zero and
    are linked like any other. A null text counts as empty. A row without doc_id gets a component too, and component_id is
    null only if no row of the component has an id. Other columns are ignored; an empty table gives no rows.
    """
    made = written(fingerprints(docs, doc_id, text, size))
    nodes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(nodes.select("fp"), group_limit)).withColumnsRenamed({"node": "fp"})
    rooted = written(nodes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    # both sides of these joins are tables, so that Spark can split the part of a root or fingerprint that very many rows share
    by_fp = written(rooted.join(named, "root").select("fp", "component_id"))
    return made.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str, size: int = STAGE_SIZE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text without words has one, so that all of these are alike."""
    return np.unique(hashed(shingles(text, size) or [""]))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: its BAND_ROWS least hashes, each under a multiplication of its own, in one word."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        least = np.minimum(least, (FACTORS[:, None] * hashes[None, i : i + 512] + SHIFTS[:, None]).min(axis=1))
    mixed = (least ^ least >> np.uint64(29)) * FACTORS[::-1]
    return mixed.reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar_forest(sets: list[np.ndarray], least: Fraction = SIMILAR) -> list[tuple[int, int]]:
    """Links (i, j) between sets whose Jaccard similarity reaches `least`, as many as a spanning forest of all such links needs."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left, out = np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue and left.any():
            i = queue.pop()
            some = left[owners]
            found = values[some]
            at = np.minimum(np.searchsorted(sets[i], found), sizes[i] - 1)
            both = np.bincount(owners[some][sets[i][at] == found], minlength=len(sets))
            near = np.flatnonzero(left & (both * least.denominator >= (sizes + sizes[i] - both) * least.numerator))
            left[near] = False
            queue += near.tolist()
            out += [(i, int(j)) for j in near]
    return out


def links_between(sets: list[np.ndarray], roots: np.ndarray, asks: np.ndarray, least: Fraction = SIMILAR) -> list[tuple[int, int]]:
    """Links (i, j) of the asking sets i with sets of other roots whose similarity reaches `least`: one for each such root."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, owners, out = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), []
    for i in np.flatnonzero(asks):
        at = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
        both = np.bincount(owners[sets[i][at] == values], minlength=len(sets))
        near = np.flatnonzero((roots != roots[i]) & (both * least.denominator >= (sizes + sizes[i] - both) * least.numerator))
        out += [(int(i), int(near[k])) for k in np.unique(roots[near], return_index=True)[1]]
    return out


def _compared(plain: DataFrame, members: DataFrame, lists: list[str]) -> DataFrame:
    """(u, v): links within each list of rows. `members` has the lists' columns, row, root and asks; a list without any that asks is compared as a whole."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(x.as_py()).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], names=["row", "hashes"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int]] = []
            for group in b.column(0):
                ids = group.values.field("row").to_pylist()
                hashes = [x.values.to_numpy().view(np.uint64) for x in group.values.field("hashes")]
                asks = group.values.field("asks").to_numpy(zero_copy_only=False)
                found = links_between(hashes, group.values.field("root").to_numpy(), asks) if asks.any() else similar_forest(hashes)
                out += [(ids[i], ids[j]) for i, j in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    whole = plain.join(members.select("row").distinct(), "row", "left_semi").mapInArrow(sets, "row long, hashes array<long>")
    groups = members.join(whole, "row").groupBy(*lists).agg(F.collect_list(F.struct("row", "hashes", "root", "asks")).alias("members"))
    return groups.select("members").mapInArrow(linked, "u long, v long").distinct()


def similar_links(rows: DataFrame, row: str, text: str = "text", band_limit: int = BAND_LIMIT) -> DataFrame:
    """(u, v): rows, by the number in column `row`, whose shingle sets have a similarity of SIMILAR or more: enough to connect all that share a band or a component of fingerprints.

    Candidates are in one component of fingerprints within three bits (SimHash; its lists are those of band BANDS), or share a band of least hashes; equal lists of candidates are compared once, by their whole sets. A list longer than `band_limit` is
    dealt into parts, and one of its rows joins every part, so that its component is one after this first step in all but rare cases.
    Where it isn't, its rows are listed anew by their prefixes (see `_prefixes`), which all similar rows share and rows that have only some passage in
    common don't. In such a list the rows outside its largest component are compared with every row, block by block.
    """
    plain = rows.select(F.col(row).alias("row"), F.coalesce(text, F.lit("")).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [hashed(shingles(x.as_py(), STAGE_SIZE) or [""]) for x in b.column(1)]
            fps = np.array([majority(x) for x in every], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), pa.array([band_keys(np.unique(x)) for x in every], pa.list_(pa.int64()))], names=["row", "fp", "keys"])

    made = written(plain.mapInArrow(keys, "row long, fp long, keys array<long>"))
    nodes = made.select("fp").distinct()
    near = nodes.join(components(links(nodes)).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("key"))
    grouped = written(made.select("row", "fp").join(near, "fp").select("row", F.lit(BANDS).alias("band"), "key"))
    keyed = made.select("row", F.posexplode("keys").alias("band", "key")).union(grouped)
    dealt = F.xxhash64("row", "band")
    # the number of rows and two sums of hashes name a list
    name = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("list"), F.sum(F.hash("row").cast("long")).alias("list2")]
    shared = written(keyed.groupBy("band", "key").agg(*name, F.min_by("row", dealt).alias("hub")).where("n > 1"))
    parts = keyed.join(shared.drop("list", "list2"), ["band", "key"]).withColumn("part", F.pmod(dealt, F.ceil(F.col("n") / band_limit)))
    lists = parts.groupBy("band", "key", "part").agg(F.collect_set("row").alias("ids"), F.first("hub").alias("hub"))
    lists = lists.select(F.array_sort(F.array_union("ids", F.array("hub"))).alias("ids")).where("size(ids) > 1")
    named = lists.select(F.xxhash64("ids").alias("list"), F.hash("ids").alias("list2"), "ids").dropDuplicates(["list", "list2"])
    members = written(named.select("list", "list2", F.explode("ids").alias("row"), F.lit(0).cast("long").alias("root"), F.lit(False).alias("asks")))
    found = written(_compared(plain, members, ["list", "list2"]))
    large = written(shared.where(F.col("n") > band_limit).dropDuplicates(["n", "list", "list2"]).select("band", "key"))
    if large.isEmpty():
        return found
    roots = components(found).withColumnRenamed("node", "row")
    inside = written(keyed.join(large, ["band", "key"]).join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")))
    mixed = inside.groupBy("band", "key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band", "key")
    rooted = written(inside.join(mixed, ["band", "key"]).select("row", "root").distinct())
    if rooted.isEmpty():
        return found
    tokens = written(_prefixes(plain.join(rooted.select("row"), "row", "left_semi")).join(rooted, "row"))
    several = [F.min("root").alias("a"), F.max("root").alias("b")]
    lists = tokens.groupBy("band", "key").agg(*name, *several).where("a <> b").dropDuplicates(["n", "list", "list2"]).select("band", "key", "n")
    blocks = written(_blocks(tokens.drop("root"), written(lists), rooted.withColumnRenamed("row", "node"), band_limit))
    return found if blocks.isEmpty() else found.union(_compared(plain, blocks, ["band", "key", "part", "chunk"])).distinct()


def _prefixes(plain: DataFrame, least: Fraction = SIMILAR) -> DataFrame:
    """(row, band, key): of each row its rarest shingles, so many that two rows of a similarity of `least` have one of them in common.

    Sets of n and m shingles at that similarity share k = ceil(least n) or more, so in any one order of all shingles the first n - k + 1 of one set meet
    those of the other. The order is by how often a shingle occurs in these rows, counted in SKETCH buckets whatever their number; passages
    that many rows share come last, and so lie outside the prefix of rows with a text of their own. `band` is 0.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SKETCH, np.int64)
        for b in batches:
            for x in b.column(1):
                np.add.at(sums, (shingle_set(x.as_py()) % np.uint64(SKETCH)).astype(np.int64), 1)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["at", "n"])

    seen = plain.mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # SKETCH rows at most
    often = np.zeros(SKETCH, np.int64)
    often[seen.column("at").to_numpy()] = seen.column("n").to_numpy()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = [], []
            for row, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = shingle_set(x.as_py())
                n = len(found) + least.numerator * -len(found) // least.denominator + 1
                order = np.argsort(often[(found % np.uint64(SKETCH)).astype(np.int64)], kind="stable")[:n]
                rows.append(np.full(len(order), row))
                keys.append(found[order].view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(keys))], names=["row", "key"])

    return plain.mapInArrow(first, "row long, key long").select("row", F.lit(0).alias("band"), "key")


def _blocks(keyed: DataFrame, large: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """The rows of the large lists that hold several components: every row outside the list's largest component (asks) meets every row of the list in one block.

    A block has about `limit` rows of the list and at most about as many that ask; of a list with n rows, m of them asking, there are n m / limit^2.
    """
    inside = keyed.join(large, ["band", "key"]).join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    inside = written(inside)
    sizes = inside.groupBy("band", "key", "root").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("band", "key").agg(F.count("*").alias("roots"), F.max("m").alias("m"), F.max_by("root", F.struct("m", "root")).alias("base")).where("roots > 1")
    rows = inside.join(mixed, ["band", "key"]).withColumns({"asks": F.col("root") != F.col("base"), "parts": F.ceil(F.col("n") / limit), "chunks": F.ceil((F.col("n") - F.col("m")) / limit)})
    own = lambda n: F.array(F.pmod(F.xxhash64("row", "band"), F.col(n)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    met = rows.select("band", "key", "row", "root", F.lit(False).alias("asks"), F.explode(own("parts")).alias("part"), every("chunks").alias("to")).select("*", F.explode("to").alias("chunk"))
    asking = rows.where("asks").select("band", "key", "row", "root", "asks", F.explode(every("parts")).alias("part"), own("chunks").alias("to")).select("*", F.explode("to").alias("chunk"))
    # one that asks and meets itself is one row
    return met.union(asking).groupBy("band", "key", "part", "chunk", "row", "root").agg(F.max("asks").alias("asks"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of similar texts one row stays, that with the smallest doc_id (nulls last) and of these the first.

    A null text counts as empty. Texts without words, null ones among them, are alike, so that one of them stays; a text of fewer words than a shingle has is
    one shingle. Texts of any length are compared whole, by the set of their shingles. Repeated rows are alike, whatever their ids. All columns are kept as they
    are, whatever their names; an empty table gives no rows.
    """
    rows, row = numbered(docs)
    root = components(written(similar_links(rows, row))).withColumnRenamed("node", row)
    member = written(rows.select(row, "doc_id").join(root, row))
    first = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first"))
    dropped = member.select(row).join(first.select(F.col("first")[row].alias(row)), row, "left_anti")
    return rows.join(written(dropped), row, "left_anti").select(docs.columns)
