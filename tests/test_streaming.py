"""Streams over files give what the batch twins give on the same rows."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from cuesheet.operators.cache import still_valid
from cuesheet.operators.folds import min_spacing_filter
from cuesheet.streaming import live


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, 10 + i * 37 % 900, "abc"[i % 3], float(i)) for i in range(120)] + [(999, 100_000, "z", 0.0)]
    df = spark.createDataFrame(rows, "id long, s long, kind string, value double").select("id", F.timestamp_seconds("s").alias("ts"), F.col("s").cast("double").alias("at"), "kind", "value")
    path = str(tmp_path / "events")
    df.coalesce(1).write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(df.schema).parquet(path)


def drained(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    ("name", "f"),
    [
        ("tumbling", lambda x: live.tumbling_profile(x, "ts", "kind")),
        ("sliding", lambda x: live.sliding_profile(x, "ts", "value")),
        ("sessions", lambda x: live.session_regions(x, "ts", "kind", "20 seconds")),
    ],
)
def test_windows(events, tmp_path, name, f):
    batch, stream = events
    early = F.col("start") < F.timestamp_seconds(F.lit(50_000))
    assert rows(drained(f(stream), name, tmp_path).where(early)) == rows(f(batch).where(early))


@pytest.mark.parametrize("seed", range(3))
def test_retries(spark, tmp_path, seed):
    """Random streams in several micro-batches, out of order within the watermark: what is kept is what the batch twin keeps."""
    rng, late = random.Random(seed), 900
    times = sorted(rng.choice((rng.randrange(40_000), 50 * rng.randrange(800))) for _ in range(400))
    arriving = sorted(((t + rng.randrange(late // 2), t, rng.choice("abbc")) for t in times))
    path, schema = str(tmp_path / "in"), "s long, kind string"
    for i in range(0, len(arriving), 80):
        spark.createDataFrame([(t, k) for _, t, k in arriving[i : i + 80]], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(200_000, "z")], schema).coalesce(1).write.mode("append").parquet(path)
    for i, p in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)):
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds("s"))
    stream = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drained(live.suppress_retries(stream, "ts", "kind", 600.0, f"{late} seconds"), f"retries{seed}", tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = min_spacing_filter(spark.read.parquet(path).select("kind", F.col("s").cast("double").alias("t")), ["kind"], "t", 600.0, -1e12).where("kind <> 'z'")
    assert sorted((r.kind, r.s) for r in got.select("kind", F.unix_seconds("ts").cast("double").alias("s")).collect()) == sorted((r.kind, r.t) for r in want.collect())


def test_ttl(events, tmp_path):
    batch, stream = events
    marked = lambda x: x.where("kind <> 'z'").withColumn("is_read", F.col("id") % 4 == 0)
    got = drained(live.ttl_lookups(marked(stream), "kind", 60.0), "ttl", tmp_path).select("kind", "at", "saved_at")
    both = marked(batch)
    reads = both.where("is_read").select("kind", F.col("id").alias("read_id"), F.col("at").alias("read_at"))
    want = still_valid(reads, both.where("not is_read").select("kind", F.col("at").alias("saved_at")), ["kind"], 60.0).select("kind", F.col("read_at").alias("at"), "saved_at")
    plain = lambda df: sorted((r[0], r[1], -1.0 if r[2] is None or r[2] != r[2] else r[2]) for r in df.collect())
    assert plain(got) == plain(want)
