"""Sharding by extendible hashing, with DataFrame functions only.

A row's hash is 60 bits of the md5 of its key. The directory is indexed by hash prefixes: a bucket that holds more bytes
than a shard may is split on one more bit, the others stay as they are. Sizes are summed per prefix, so only sums are
shuffled. All levels of a round come from one grouping; a further round looks only at what is still too large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import settled, table, written

BITS = 60
SHARD_BYTES = 16 << 20
#: bits that a round looks at beyond those that evenly sized buckets would need
AHEAD = 4


def key_hash(key: Column) -> Column:
    """60 bits of the md5 of the key's text; a null key counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shifted(value: str, bits: Column | int) -> Column:
    return F.call_function("shiftright", F.col(value), bits.cast("int") if isinstance(bits, Column) else F.lit(bits))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Leaves (depth, prefix, shard_bytes, fits) over rows (h, bytes): the shortest prefixes that fit.

    Rows of one hash can't be parted by splitting: where they are too large together, their leaf has 60 bits and fits is
    false.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    done, reach = -1, min(BITS, math.ceil(math.log2(max(1, total / limit))) + AHEAD)
    rows, leaves = sizes, []
    while True:
        counted = rows.groupBy(shifted("h", BITS - reach).alias("p")).agg(F.sum("bytes").alias("bytes"))
        levels = counted.select("p", "bytes", F.explode(F.sequence(F.lit(done + 1), F.lit(reach))).alias("depth"))
        buckets = levels.groupBy("depth", shifted("p", reach - F.col("depth")).alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        parents = buckets.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("bytes").alias("above"))
        held = settled(buckets.withColumn("up", shifted("prefix", 1)).join(parents, ["depth", "up"], "left"))
        split = (F.col("depth") == done + 1) | (F.col("above") > limit)  # the bucket above was split, or there is none
        leaves.append(held.where(split & (F.col("bytes") <= limit)).select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.lit(True).alias("fits")))
        over = held.where((F.col("depth") == reach) & (F.col("bytes") > limit)).select(F.col("prefix").alias("p"), "bytes")
        if reach == BITS or over.isEmpty():
            break
        rows = rows.join(over.select("p"), shifted("h", BITS - reach) == F.col("p"), "left_semi")
        done, reach = reach, min(BITS, reach + 2 * AHEAD)
    leaves.append(over.select(F.lit(BITS).alias("depth"), F.col("p").alias("prefix"), F.col("bytes").alias("shard_bytes"), F.lit(False).alias("fits")))
    out = leaves[0]
    for x in leaves[1:]:
        out = out.union(x)
    return out


def shard(docs: DataFrame, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, fits) of every row.

    `shard` is the bucket's hash prefix in bits ("" when one shard holds all), `bytes` the text's UTF-8 length (null: 0),
    `shard_bytes` at most `limit` unless fits is false: a single row larger than the limit, or repeated ids that are, make
    such a shard. Rows with one id share a shard; rows without id count as one id. Other columns are ignored; an empty
    table gives no rows.
    """
    return placed(settled(sized(docs, doc_id, text)), limit).drop("h")


def sized(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """(doc_id, bytes, h) of every row, and more columns."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), key_hash(F.col(doc_id)).alias("h"), *more)


def placed(rows: DataFrame, limit: int) -> DataFrame:
    """Adds shard, depth, shard_bytes and fits to rows (h, bytes), a table that is read twice."""
    leaves = settled(directory(rows.select("h", "bytes"), limit))
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # at most 61
    named = rows.withColumn("depth", F.explode(F.lit(depths).cast("array<int>"))) if depths else rows.withColumn("depth", F.lit(0))
    named = named.withColumn("prefix", shifted("h", BITS - F.col("depth")))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr(f"right(lpad(bin(prefix), {BITS}, '0'), depth)"))
    return named.join(leaves, ["depth", "prefix"]).select(*rows.columns, bits.alias("shard"), "depth", "shard_bytes", "fits")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes every row's doc_id and text as Parquet, with a folder for each shard.

    A folder's name is `shard=b` and the bits, so that a reader takes no prefix for a number and the one shard of a small table has a name too. Repeated
    rows are written as often as they come; null ids and texts stay null; other columns are left out; an empty table gives no folders.
    """
    rows = written(sized(docs, doc_id, text, F.col(text).alias("text")))
    found = placed(rows, limit).select("doc_id", "text", F.concat(F.lit("b"), "shard").alias("shard"))
    found.repartition("shard").write.partitionBy("shard").parquet(path)


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
                  ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h FROM documents),
     b AS (SELECT d::INTEGER AS depth, h >> ({BITS} - d)::BIGINT AS prefix, sum(bytes)::BIGINT AS shard_bytes
           FROM r, range(0, {BITS + 1}) t(d) GROUP BY ALL),
     f AS (SELECT r.doc_id, r.bytes, r.h, min(b.depth) FILTER (shard_bytes <= {SHARD_BYTES} OR b.depth = {BITS}) AS depth
           FROM r JOIN b ON b.prefix = r.h >> ({BITS} - b.depth)::BIGINT GROUP BY ALL)
SELECT f.doc_id, f.bytes, CASE WHEN f.depth = 0 THEN '' ELSE right(lpad(bin(b.prefix), {BITS}, '0'), f.depth) END AS shard, f.depth,
       b.shard_bytes, b.shard_bytes <= {SHARD_BYTES} AS fits
FROM f JOIN b ON b.depth = f.depth AND b.prefix = f.h >> ({BITS} - f.depth)::BIGINT
"""
