"""Archives of recognised songs as folders of JSON: payloads, an index, and file metadata as table input.

An archive is a folder under a root with `index.json` (a document for each recording, listing its songs) and the payloads that the index names. Written here, both are
folders of JSON lines, as many files as tasks wrote, whatever the number of recordings; documents written by other tools, a file each, are read with `documents=True`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.sources.documents import asr_usable

SENTENCES = "array<struct<text: string, start_s: double, end_s: double>>"
WORDS = "array<struct<word: string, start_s: double, end_s: double>>"
SONG = "song_index int, song_name string, song_title string, song_start double, song_end double, sentence_count long, word_count long, file string"
INDEX = f"created_at string, video_path string, cache_dir string, songs array<struct<{SONG.replace(' ', ': ').replace(',:', ',')}>>"
PAYLOAD = f"file string, song_index int, song_artist string, asr_result struct<error: string, text: string, sentences: {SENTENCES}, words: {WORDS}>"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name in the cluster's shared folder (spark.checkpoint.dir); only a local session may have none and gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{root}/{uuid.uuid4().hex}"


def shared_table(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: what later steps read, and what a lost executor's tasks begin from."""
    path = scratch_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_asr_archive(songs: DataFrame, root: str, archive: str, created_at: str) -> None:
    """Songs (media_id, video_path, song_index, song_name, song_title, song_artist, song_start, song_end, error, text, sentences, words) as one archive.

    A payload has the counts of sentences and words; null arrays count as empty.
    """
    name = F.format_string("%s/song_%03d.json", F.col("media_id").cast("string"), F.col("song_index") + 1)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(f"{c[:-1]}_count")
    rows = songs.withColumns({"sentences": F.coalesce("sentences", F.array().cast(SENTENCES)), "words": F.coalesce("words", F.array().cast(WORDS)), "file": name})
    rows = rows.select("*", size("sentences"), size("words"))
    result = F.struct("error", "text", "sentences", "words").alias("asr_result")
    payload = rows.select("media_id", "file", "song_index", "song_name", "song_title", "song_artist", "song_start", "song_end", "sentence_count", "word_count", result)
    payload.write.mode("overwrite").json(f"{root}/{archive}/payload")
    listed = F.array_sort(F.collect_list(F.struct("song_index", "song_name", "song_title", "song_start", "song_end", "sentence_count", "word_count", "file"))).alias("songs")
    index = rows.groupBy("video_path").agg(listed).select(F.lit(created_at).alias("created_at"), "video_path", F.lit(f"{root}/{archive}").alias("cache_dir"), "songs")
    index.write.mode("overwrite").json(f"{root}/{archive}/index.json")


def read_archive_index(spark: SparkSession, root: str, documents: bool = False) -> DataFrame:
    """The songs that all indexes under a root list: archive, modified (the index file's time), created_at, video_path, song_index, ..., file."""
    found = spark.read.schema(INDEX).option("multiLine", documents).json(f"{root}/*/index.json").select("*", "_metadata.file_path", F.col("_metadata.file_modification_time").alias("modified"))
    archive = F.regexp_extract("file_path", r"([^/]+)/index\.json(?:/[^/]*)?$", 1)
    return found.select(archive.alias("archive"), "modified", "created_at", "video_path", F.explode("songs").alias("s")).select("archive", "modified", "created_at", "video_path", "s.*")


def read_asr_archive(spark: SparkSession, root: str, media: str | None = None, documents: bool = False) -> DataFrame:
    """For each song (video_path, song_index) the newest usable result: archive, file, sentence_count, word_count, asr_result.

    Indexes are taken by the time of their files, newest first, and of equal ones by name; a song that an index lists without a usable payload comes from an older one. Payloads are joined by
    archive and file name. With `media` only songs of that recording.
    """
    index = read_archive_index(spark, root, documents)
    if media is not None:
        index = index.where(F.col("video_path") == media)
    files = f"{root}/*/song_*.json" if documents else f"{root}/*/payload"
    found = spark.read.schema(PAYLOAD).option("multiLine", documents).option("recursiveFileLookup", True).json(files).select("file", "asr_result", "_metadata.file_path")
    archive, own = F.regexp_extract("file_path", r"([^/]+)/(?:payload/.*|[^/]+)$", 1), F.regexp_extract("file_path", r"([^/]+)$", 1)
    payloads = found.select(archive.alias("archive"), F.coalesce("file", own).alias("file"), "asr_result")
    r = F.col("asr_result")
    usable = asr_usable(r["error"], F.size(r["sentences"]), F.size(r["words"]), r["text"])
    both = index.join(payloads.where(usable), ["archive", "file"])
    nr = F.row_number().over(Window.partitionBy("video_path", "song_index").orderBy(F.desc("modified"), F.desc("archive"), "file"))
    return both.withColumn("_nr", nr).where("_nr = 1").select("video_path", "song_index", "archive", "file", F.size(r["sentences"]).cast("long").alias("sentence_count"), F.size(r["words"]).cast("long").alias("word_count"), "asr_result")
