"""Result documents, recogniser payloads, archives, subtitles: JSON and text in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators.intervals import Keys

PAYLOAD = "struct<code: int, message: string, utterances: array<struct<text: string, start_time: bigint, end_time: bigint, words: array<struct<text: string, start_time: bigint, end_time: bigint>>>>>"
ANALYSIS = "struct<singer: string, total_duration: double, songs: array<struct<song_index: int, name: string, start_s: double, end_s: double, segments: array<struct<start_s: double, end_s: double, label: string, confidence: double>>>>>"
ENTRY = "struct<path: string, song_index: int, language: string, caption_type: string, save_time: double, result_count: int, bytes: bigint>"
SAMPLE = "struct<sample_id: bigint, original_label: string, current_label: string, is_modified: boolean, tags: array<string>, notes: string>"


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document to a file or line as column `doc`, by an explicit schema; what doesn't parse is null."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("doc"))


def normalize_provider_payload(rows: DataFrame, keys: Keys, payload: str) -> DataFrame:
    """Recogniser payloads as (keys, pos, text, start_s, end_s, n_words, error): milliseconds to seconds; a code other than 0 is one error row."""
    parsed = rows.select(*keys, F.from_json(payload, PAYLOAD).alias("p"))
    failed = parsed.where("p is null or p.code <> 0").select(*keys, F.lit(0).alias("pos"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), F.lit(0).alias("n_words"), F.coalesce("p.message", F.lit("unreadable")).alias("error"))
    good = parsed.where("p.code = 0").select(*keys, F.posexplode("p.utterances").alias("pos", "u"))
    return good.select(*keys, "pos", "u.text", (F.col("u.start_time") / 1000.0).alias("start_s"), (F.col("u.end_time") / 1000.0).alias("end_s"), F.coalesce(F.size("u.words"), F.lit(0)).alias("n_words"), F.lit(None).cast("string").alias("error")).unionByName(failed)


def analysis_to_json(songs: DataFrame, keys: Keys) -> DataFrame:
    """Segments (song_index, start_s, end_s, label, confidence) as one nested document for each media, in column json."""
    inner = songs.groupBy(*keys, "song_index").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", "label", "confidence"))).alias("segments"), F.min("start_s").alias("first"), F.max("end_s").alias("last"))
    outer = inner.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("song_index", F.format_string("song_%02d", F.col("song_index")).alias("name"), F.col("first").alias("start_s"), F.col("last").alias("end_s"), "segments"))).alias("songs"), F.max("last").alias("total_duration"))
    return outer.select(*keys, F.to_json(F.struct(F.lit("unknown").alias("singer"), "total_duration", "songs")).alias("json"))


def analysis_from_json(rows: DataFrame, keys: Keys, json: str) -> DataFrame:
    """Nested result documents as segments; songs without segments have one row of nulls."""
    songs = rows.select(*keys, F.from_json(json, ANALYSIS).alias("d")).select(*keys, F.explode_outer("d.songs").alias("s"))
    return songs.select(*keys, "s.song_index", "s.name", F.explode_outer("s.segments").alias("x")).select(*keys, "song_index", "name", "x.*")


def asr_usable(error: Column, sentences: Column, words: Column, text: Column) -> Column:
    return error.isNull() & ((F.coalesce(sentences, F.lit(0)) > 0) | (F.coalesce(words, F.lit(0)) > 0) | (F.trim(F.coalesce(text, F.lit(""))) != ""))


def first_usable(rows: DataFrame, keys: Keys, newest: str, tie: str, usable: Column) -> DataFrame:
    """Of several archives the newest usable row of each key."""
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(newest), tie))
    return rows.where(usable).withColumn("_nr", nr).where("_nr = 1").drop("_nr")


def explode_cache_index(rows: DataFrame, json: str) -> DataFrame:
    """A map of key to entry as rows cache_key, path, song_index, ..."""
    return rows.select(F.explode(F.from_json(json, f"map<string, {ENTRY}>")).alias("cache_key", "e")).select("cache_key", "e.*")


def load_hints(rows: DataFrame, key: str, json: str, priority: str) -> DataFrame:
    """The title that the first hint file (by priority) has for a key; an entry is a string or an object with a title."""
    entries = rows.select(priority, F.explode(F.from_json(json, "map<string, string>")).alias(key, "_e"))
    title = F.coalesce(F.get_json_object("_e", "$.title"), F.col("_e"))
    return entries.groupBy(key).agg(F.min_by(title, priority).alias("title"))


def sample_from_json(rows: DataFrame, json: str) -> DataFrame:
    """Samples with defaults for what is missing: not modified, no tags, empty notes."""
    parsed = rows.select(F.from_json(json, SAMPLE).alias("s")).select("s.*")
    return parsed.withColumns({"is_modified": F.coalesce("is_modified", F.lit(False)), "tags": F.coalesce("tags", F.array().cast("array<string>")), "notes": F.coalesce("notes", F.lit(""))})


def hundredths(seconds: Column) -> Column:
    return F.round(seconds + 1e-9, 2)


def ass_documents(sentences: DataFrame, keys: Keys) -> DataFrame:
    """Sentences as one subtitle text for each key, in time order."""
    line = F.concat(F.lit("Dialogue: 0,"), tx.format_ass_time(hundredths(F.col("start_s"))), F.lit(","), tx.format_ass_time(hundredths(F.col("end_s"))), F.lit(",Default,,0,0,0,,"), tx.escape_ass(F.col("text")))
    rows = sentences.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_s", "end_s", line.alias("line")))).alias("x"))
    return rows.select(*keys, F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("document"))


def srt_documents(chunks: DataFrame, keys: Keys) -> DataFrame:
    """Chunks as one document of numbered blocks for each key, in time order."""
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", "end_s"))
    block = F.concat(F.col("_nr").cast("string"), F.lit("\n"), tx.format_srt_time(F.col("start_s")), F.lit(" --> "), tx.format_srt_time(F.col("end_s")), F.lit("\n"), tx.escape_srt(F.col("text")), F.lit("\n"))
    rows = chunks.withColumn("_nr", nr).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_nr", block.alias("b")))).alias("x"))
    return rows.select(*keys, F.array_join(F.transform("x", lambda r: r["b"]), "\n").alias("document"))


def write_documents(documents: DataFrame, keys: Keys, path: str) -> None:
    """A folder for each key with its document as text."""
    documents.write.mode("overwrite").partitionBy(*keys).text(path)


def export_manifest(segments: DataFrame, keys: Keys, order: list[str], prefix: str) -> DataFrame:
    """Segments (title, type, is_highlight, start_s, end_s) with the clip's sequence number in its media, its folder (the song's title) and its file name."""
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    title = tx.sanitize_filename(F.col("title"), "未知歌曲")
    file = F.concat_ws("_", F.lit(prefix), F.col("folder"), F.format_string("%03d", F.col("sequence")), F.concat(F.col("type"), F.lit(".mp4")))
    return segments.withColumns({"sequence": nr, "folder": title}).withColumn("file", file)


def json_safe(value: Column, schema: str) -> Column:
    """JSON text by a schema, null where it doesn't parse."""
    return F.from_json(value, schema)


def json_text(value: Column) -> Column:
    """A struct or map as JSON; null as an empty object."""
    return F.coalesce(F.to_json(value), F.lit("{}"))


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder: path, modified, bytes; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def inventory_report(files: DataFrame, category: Column, now: Column, oldest: dict[str, float]) -> DataFrame:
    """Files and bytes by category, and how many are older than the category's age in hours."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("modified")) / 3600
    limit = F.create_map(*(F.lit(x) for k, h in oldest.items() for x in (k, float(h))))
    rows = files.withColumns({"category": category, "_age": age})
    return rows.groupBy("category").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("_age") > limit[F.col("category")]).alias("expired"))


REPORT = (
    "struct<version: string, identification: struct<total_segments: bigint, identified_count: bigint, unknown_count: bigint, identification_rate: double, identification_source_breakdown: map<string, bigint>,"
    " segment_details: array<struct<song_index: int, source: string, label_distribution: map<string, bigint>>>>, structural_labels: map<string, bigint>>"
)


def run_report(songs: DataFrame, segments: DataFrame, keys: Keys, version: str = "1") -> DataFrame:
    """One report document for each run (keys) of its songs (song_index, source) and their segments (song_index, label), in column json.

    It counts songs by source, with the share that is identified, and labels for each song and over all. A song without segments has no labels; segments of no song aren't counted.
    """
    each = [*keys, "song_index"]
    named = segments.join(songs.select(*each), each, "left_semi").groupBy(*each, "label").agg(F.count("*").alias("n"))
    entries = lambda: F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))
    by_song, by_run = named.groupBy(*each).agg(entries().alias("labels")), named.groupBy(*keys, "label").agg(F.sum("n").alias("n")).groupBy(*keys).agg(entries().alias("structural_labels"))
    none = F.create_map().cast("map<string, bigint>")
    details = songs.select(*each, "source").join(by_song, each, "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("song_index", "source", F.map_entries(F.coalesce("labels", none)).alias("l")))).alias("d"))
    details = details.select(*keys, F.transform("d", lambda x: F.struct(x["song_index"].alias("song_index"), x["source"].alias("source"), F.map_from_entries(x["l"]).alias("label_distribution"))).alias("segment_details"))
    sources = songs.groupBy(*keys, "source").agg(F.count("*").alias("n"))
    unknown = F.coalesce(F.sum(F.when(F.col("source") == "unknown", F.col("n"))), F.lit(0))
    totals = sources.groupBy(*keys).agg(F.sum("n").alias("total_segments"), unknown.alias("unknown_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("identification_source_breakdown"))
    rows = totals.join(details, list(keys)).join(by_run, list(keys), "left")
    found = F.col("total_segments") - F.col("unknown_count")
    identification = F.struct("total_segments", found.alias("identified_count"), "unknown_count", (found / F.greatest(F.col("total_segments"), F.lit(1))).alias("identification_rate"), "identification_source_breakdown", "segment_details")
    return rows.select(*keys, F.to_json(F.struct(F.lit(version).alias("version"), identification.alias("identification"), F.coalesce("structural_labels", none).alias("structural_labels"))).alias("json"))


def first_visible_time(sentences: Column, words: Column) -> Column:
    """The middle of the first sentence with text, else of the first word, else 0; both are arrays of structs text, start_s, end_s."""
    first = lambda a: F.try_element_at(F.filter(a, lambda x: F.trim(x["text"]) != ""), F.lit(1))
    middle = lambda x: (x["start_s"] + x["end_s"]) / 2
    return F.coalesce(middle(first(sentences)), middle(first(words)), F.lit(0.0))
