"""Hard-negative mining: exact integer scores by Strassen's multiplication on tiles, kept in heaps that merge.

Anchors are dealt into stripes and all rows into slices; a group of a stripe and a slice is one task's work, so that work grows with anchors times
rows and no group with either. In a group the vectors form tiles of 64-bit integers, padded with zeros to whole halves, and products of tiles are
multiplied recursively with seven products for eight. Sums of 64-bit integers wrap, so scores are exact as long as they fit, which the bound on a
vector's norm ensures.

The first pass multiplies an anchor with rows of its label and keeps a heap of its positives. The second multiplies it with all rows and keeps, for each
positive, a heap of the negatives inside the window of that positive's score. Heaps of tiles merge in a group; heaps of groups merge by rank, of which
Spark keeps the first rows for each task before it shuffles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import numbered, table, written

POSITIVES, NEGATIVES = 5, 10
#: of a positive's score, in hundredths: the window of a negative's
LOW, HIGH = 30, 90
SCALE, EVERY = 256, 100
#: rows of a group, of a tile, and where recursion stops
STRIPE, SLICE, TILE_ROWS, TILE_COLUMNS, LEAF = 4096, 8192, 512, 2048, 8
#: squared norms beyond this could make 100 times a score overflow
LONGEST = float(1 << 55)
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices of 64-bit integers, whose sides halve evenly down to LEAF."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    h, i, j = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1, p2, p3, p4 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    p5, p6, p7 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    c = np.empty((m, n), np.int64)
    c[:h, :j], c[:h, j:], c[h:, :j], c[h:, j:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return c


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both, by `strassen` after padding with zeros."""
    (m, k), (n, _) = a.shape, b.shape
    halvings = 0
    while -(-min(m, k, n) >> halvings) > LEAF:
        halvings += 1
    unit = 1 << halvings
    whole = [-(-x // unit) * unit for x in (m, k, n)]
    left, right = np.zeros((whole[0], whole[1]), np.int64), np.zeros((whole[1], whole[2]), np.int64)
    left[:m, :k], right[:k, :n] = a, b.T
    return strassen(left, right)[:m, :n]


class Heaps:
    """For each row of `shape` the first `k` of what was pushed: by falling score, then by rising place."""

    def __init__(self, shape: tuple[int, ...], k: int) -> None:
        self.k = k
        self.scores, self.places = np.full((*shape, k), NONE), np.full((*shape, k), -1)

    def merge(self, scores: np.ndarray, places: np.ndarray) -> None:
        scores, places = np.concatenate((self.scores, scores), axis=-1), np.concatenate((self.places, places), axis=-1)
        # places rise in the order in which slices are read, so a stable sort keeps ties by place
        order = np.argsort(-np.maximum(scores, NONE + 1), axis=-1, kind="stable")[..., : self.k]
        self.scores, self.places = np.take_along_axis(scores, order, -1), np.take_along_axis(places, order, -1)

    def rows(self) -> tuple[np.ndarray, ...]:
        at = np.nonzero(self.scores != NONE)
        return *at[:-1], self.scores[at], self.places[at]


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Packed vectors as rows of integers; shorter ones have zeros at their end."""
    data = [np.frombuffer(x, "<i8") for x in column.to_pylist()]
    out = np.zeros((len(data), width), np.int64)
    for row, x in zip(out, data, strict=True):
        row[: len(x)] = x
    return out


class Group:
    """A stripe of anchors and a slice of rows, in order of vec_id and number."""

    def __init__(self, anchors: pa.Table, rows: pa.Table) -> None:
        self.anchors, self.rows = anchors, rows.sort_by([("vec_id", "ascending"), ("nr", "ascending")])
        width = max((len(x) // 8 for c in (anchors.column("vector"), rows.column("vector")) for x in c.to_pylist()), default=0)
        self.a, self.b = _vectors(anchors.column("vector"), width), _vectors(self.rows.column("vector"), width)
        self.anchor_nr, self.nr = anchors.column("nr").to_numpy(), self.rows.column("nr").to_numpy()
        self.anchor_label, self.label = anchors.column("label").to_numpy(), self.rows.column("label").to_numpy()
        self.vec_id = self.rows.column("vec_id").to_numpy()

    def tiles(self, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of anchors and of rows, and their scores: of one label, or of all rows with NONE for those of the anchor's label."""
        labels = np.unique(self.anchor_label) if same else [None]
        for label in labels:
            mine = np.flatnonzero(self.anchor_label == label) if same else np.arange(len(self.a))
            theirs = np.flatnonzero(self.label == label) if same else np.arange(len(self.b))
            for i in range(0, len(mine), TILE_ROWS):
                at = mine[i : i + TILE_ROWS]
                for j in range(0, len(theirs), TILE_COLUMNS):
                    to = theirs[j : j + TILE_COLUMNS]
                    scores = product(self.a[at], self.b[to])
                    scores[self.anchor_nr[at][:, None] == self.nr[to][None] if same else self.anchor_label[at][:, None] == self.label[to][None]] = NONE
                    yield at, to, scores


def _first(scores: np.ndarray, to: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-np.maximum(scores, NONE + 1), axis=1, kind="stable")
    return np.take_along_axis(scores, order, 1), to[order]


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    g = Group(anchors, rows)
    heaps = Heaps((len(g.a),), POSITIVES)
    for at, to, scores in g.tiles(same=True):
        best, places = _first(scores, to, POSITIVES)
        part = Heaps((len(at),), POSITIVES)
        part.scores, part.places = heaps.scores[at], heaps.places[at]
        part.merge(best[:, :POSITIVES], places[:, :POSITIVES])
        heaps.scores[at], heaps.places[at] = part.scores, part.places
    a, scores, places = heaps.rows()
    return pa.table({"anchor_nr": g.anchor_nr[a], "positive_nr": g.nr[places], "positive_id": g.vec_id[places], "positive_score": scores})


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    g = Group(anchors, rows)
    wanted = np.full((len(g.a), POSITIVES), NONE)
    for row, x in zip(wanted, anchors.column("positive_scores").to_pylist(), strict=True):
        row[: len(x)] = x
    known = wanted != NONE
    low, high = np.where(known, -(-LOW * np.where(known, wanted, 0) // 100), 1), np.where(known, HIGH * np.where(known, wanted, 0) // 100, 0)
    heaps = Heaps((len(g.a), POSITIVES), NEGATIVES)
    for at, to, scores in g.tiles(same=False):
        best, places = _first(scores, to, len(to))
        part = Heaps((len(at), POSITIVES), NEGATIVES)
        part.scores, part.places = heaps.scores[at], heaps.places[at]
        above = np.stack([(best > high[at, j, None]).sum(axis=1) for j in range(POSITIVES)], axis=1)
        pick = above[:, :, None] + np.arange(NEGATIVES)
        inside = np.minimum(pick, best.shape[1] - 1)
        found = np.take_along_axis(best[:, None, :], inside, 2)
        found = np.where((pick < best.shape[1]) & (found >= low[at][:, :, None]), found, NONE)
        part.merge(found, np.take_along_axis(places[:, None, :], inside, 2))
        heaps.scores[at], heaps.places[at] = part.scores, part.places
    a, p, scores, places = heaps.rows()
    return pa.table({"anchor_nr": g.anchor_nr[a], "positive_rank": (p + 1).astype(np.int32), "negative_nr": g.nr[places], "negative_id": g.vec_id[places], "negative_score": scores})


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(nr, vec_id, label, vector) of the rows that take part: a label, an id, finite components only, and a norm for which scores fit into 64 bits.

    Components are rounded down in steps of 1/SCALE and packed as little-endian 64-bit integers.
    """
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(F.col(embedding), lambda x: x.cast("double")).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    scaled = usable.withColumn("vector", F.transform("vector", lambda x: F.floor(SCALE * x)))
    short = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) <= LONGEST
    return numbered(scaled.where(short))[0].withColumnRenamed("row_nr", "nr")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("vector")
        vectors = b.column(at)
        data, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes(), (vectors.offsets.to_numpy() - vectors.offsets[0].as_py()) * 8
        packed = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([packed if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)


def _groups(anchors: DataFrame, rows: DataFrame, stripes: int, slices: int, extra: str = "") -> tuple:
    """Both sides by (stripe, slice): anchors beside every slice, rows beside every stripe."""

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int, more: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        schema = f"nr long, vec_id long, label long, vector binary{more}"
        return df.select("nr", "vec_id", "label", "vector", *(["positive_scores"] if more else [])).mapInArrow(_packed, schema).withColumn(own, F.pmod(F.xxhash64("nr"), n).cast("int")).withColumn(other, each)

    keys = ("stripe", "slice")
    return dealt(anchors, "stripe", stripes, "slice", slices, extra).groupBy(*keys), dealt(rows, "slice", slices, "stripe", stripes, "").groupBy(*keys)


def hard_negatives(vectors: DataFrame, anchor: Column, stripe: int = STRIPE, slice_: int = SLICE) -> DataFrame:
    """For each row for which `anchor` (over vec_id, label) holds and each of its positives, the first negatives inside the positive's window.

    `vectors` are rows of `prepared`, written. Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Vectors of other lengths count as
    filled up with zeros. Rows that repeat an id are rows of their own: an anchor's positives leave out the anchor's row only, ties go by id and then as rows come. Positives
    whose window holds no negative have no row, as have anchors without positives; an empty table gives none.
    """
    anchors = vectors.where(anchor)
    stripes, slices = (max(1, -(-x.count() // size)) for x, size in ((anchors, stripe), (vectors, slice_)))
    left, right = _groups(anchors, vectors, stripes, slices)
    found = left.cogroup(right).applyInArrow(_positives, "anchor_nr long, positive_nr long, positive_id long, positive_score long")
    by = Window.partitionBy("anchor_nr").orderBy(F.desc("positive_score"), "positive_id", "positive_nr")
    positives = written(found.withColumn("positive_rank", F.row_number().over(by)).where(F.col("positive_rank") <= POSITIVES))
    scores = positives.groupBy("anchor_nr").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_score"))).alias("s")).select(F.col("anchor_nr").alias("nr"), F.col("s.positive_score").alias("positive_scores"))
    left, right = _groups(anchors.join(scores, "nr"), vectors, stripes, slices, ", positive_scores array<long>")
    found = left.cogroup(right).applyInArrow(_negatives, "anchor_nr long, positive_rank int, negative_nr long, negative_id long, negative_score long")
    by = Window.partitionBy("anchor_nr", "positive_rank").orderBy(F.desc("negative_score"), "negative_id", "negative_nr")
    negatives = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= NEGATIVES)
    ids = anchors.select(F.col("nr").alias("anchor_nr"), F.col("vec_id").alias("anchor_id"))
    return negatives.join(positives.join(ids, "anchor_nr"), ["anchor_nr", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = prepared(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", own.alias("label")))
    return hard_negatives(vectors, F.col("vec_id") % EVERY == 0)


OP12_SQL = """
WITH given AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row_number() OVER () AS nr, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector FROM given),
scores AS (SELECT a.nr AS anchor_nr, a.vec_id AS anchor_id, b.nr, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.vector, b.vector) AS BIGINT) AS score
           FROM v a JOIN v b ON a.nr <> b.nr WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_nr, anchor_id, nr AS positive_nr, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_nr ORDER BY score DESC, vec_id, nr) <= 5),
ranked AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_nr, p.positive_nr ORDER BY s.score DESC, s.vec_id, s.nr) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
           FROM positives p JOIN scores s ON s.anchor_nr = p.anchor_nr AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
