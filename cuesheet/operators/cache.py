"""Caches and libraries as tables: latest-wins upserts, lookups, misses, time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.intervals import Keys


def latest(rows: DataFrame, keys: Keys, at: str, tie: str) -> DataFrame:
    """The last row of each key; of equally late ones that with the largest tie."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(at, tie)).alias("_x")).select(*keys, "_x.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Keys, at: str, tie: str) -> DataFrame:
    """Both tables' rows, the last of each key; incoming rows without a key are rejected."""
    valid = incoming
    for k in keys:
        valid = valid.where(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    return latest(existing.unionByName(valid), keys, at, tie)


def delete(rows: DataFrame, ids: DataFrame, keys: Keys) -> DataFrame:
    return rows.join(ids.select(*keys).distinct(), list(keys), "left_anti")


def newest(rows: DataFrame, n: int, at: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(at), tie).limit(n)


def get(library: DataFrame, wanted: DataFrame, keys: Keys) -> DataFrame:
    """The library's rows of the wanted keys; keys that it doesn't have give none."""
    return library.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def counted(library: DataFrame) -> DataFrame:
    """The number of rows, as a table of one row."""
    return library.agg(F.count("*").alias("n"))


def migrated(cache: DataFrame, archive: DataFrame, keys: Keys) -> DataFrame:
    """The cache with the archive's usable rows of keys for which it has no usable one; those replace what it had. Caches have one row for each key."""
    good = cache.where("usable")
    moved = archive.where("usable").join(good.select(*keys), list(keys), "left_anti")
    return cache.join(moved.select(*keys), list(keys), "left_anti").unionByName(moved)


def lookup(wanted: DataFrame, cache: DataFrame, keys: Keys) -> DataFrame:
    """Wanted rows with the payload of the cache, null on a miss."""
    return wanted.join(cache, list(keys), "left")


def hits_and_misses(wanted: DataFrame, cache: DataFrame, archive: DataFrame, keys: Keys) -> DataFrame:
    """Adds origin (cache, archive or process) and the payload: a usable cache entry first, then the archive's. Caches have one row for each key."""
    own = cache.where("usable").select(*keys, F.col("payload").alias("_c"))
    old = archive.where("usable").select(*keys, F.col("payload").alias("_a"))
    both = wanted.join(own, list(keys), "left").join(old, list(keys), "left")
    origin = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_a").isNotNull(), "archive").otherwise("process")
    return both.select(*wanted.columns, origin.alias("origin"), F.coalesce("_c", "_a").alias("payload"))


def cache_stats(entries: DataFrame, size: str, *group: str) -> DataFrame:
    return entries.groupBy(*group).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"), (F.sum(size) / (1024 * 1024)).alias("mb"))


def still_valid(reads: DataFrame, entries: DataFrame, keys: Keys, ttl: float) -> DataFrame:
    """Each read (column read_at) with the last entry saved at or before it, null if that is older than the time to live."""
    both = reads.select(*keys, "read_id", F.col("read_at").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_saved"))
    both = both.unionByName(entries.select(*keys, F.lit(None).cast("long").alias("read_id"), F.col("saved_at").alias("_t"), F.lit(0).alias("_side"), F.col("saved_at").alias("_saved")))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_saved", ignorenulls=True).over(w)).where("_side = 1")
    return found.select(*keys, "read_id", F.col("_t").alias("read_at"), F.when(F.col("_t") - F.col("_last") <= ttl, F.col("_last")).alias("saved_at"))


def subtitle_cache_key(file_hash: Column, song: Column, language: Column, kind: Column) -> Column:
    return F.md5(F.concat_ws("_", file_hash, song.cast("string"), language, kind).cast("binary"))


def file_key(size: Column, head: Column, tail: Column) -> Column:
    """The key of a file by its size, first and last bytes, so that it need not be read whole."""
    return F.sha1(F.concat(size.cast("string").cast("binary"), head.cast("binary"), tail.cast("binary")))


def new_id(prefix: str, *key: Column) -> Column:
    """A stable id of a key: a repeated run gives the same."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary"), 256), 1, 16))
