"""What the corpus operators share: reading tables, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: tables that this process has written to the shared folder
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session in one process (as in tests) may have none and gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint: later plans start there and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: as `settled`, with pruned columns and known sizes."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's text, modulo n: the split into learning and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def clear(spark: SparkSession) -> None:
    """Deletes the tables and records that this process has left in the shared folder. For the caller, once the results are stored: they read them."""
    while WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and text under these names, whatever other columns there are; a null text is empty. doc_id is an integer or null: other ids are to be numbered first."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a column that tells them apart, and its name, which no other column has.

    They are written first, so that every plan that reads them, and every repeated task, sees the same numbers.
    """
    name = "row_nr"
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return written(df.select("*", F.monotonically_increasing_id().alias(name))), name
