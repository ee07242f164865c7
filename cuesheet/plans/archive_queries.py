"""Archives and file inventories on folders that the queries write first, in the shared folder, from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import cache as ca
from cuesheet.plans.registry import query
from cuesheet.plans.text_queries import LATEST
from cuesheet.sources import archives as ar
from cuesheet.sources import documents as dc


def recognised(v):
    """Songs of twelve minutes with their sentences and words."""
    song = F.floor(F.col("start_s") / 720).cast("int").alias("song_index")
    said = v.sent.select("media_id", song, F.col("pos").alias("p"), F.struct("text", "start_s", "end_s").alias("x"))
    words = v.word.select("media_id", song, F.struct("start_s", "end_s", "word").alias("y")).groupBy("media_id", "song_index").agg(F.transform(F.array_sort(F.collect_list("y")), lambda y: F.struct(y["word"].alias("word"), y["start_s"].alias("start_s"), y["end_s"].alias("end_s"))).alias("words"))
    rows = said.groupBy("media_id", "song_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]).alias("sentences")).join(words, ["media_id", "song_index"], "left")
    none = F.lit(None).cast("string")
    names = {"video_path": F.concat(F.lit("/media/"), F.col("media_id"), F.lit(".mp4")), "song_name": F.concat(F.lit("song "), F.col("song_index")), "song_title": none, "song_artist": none, "song_start": F.col("song_index") * 720.0, "song_end": (F.col("song_index") + 1) * 720.0, "error": none, "text": none}
    return rows.withColumns(names)


def archived(v):
    """Two archives: of all songs, and later of every third recording, with half of the sentences and a quarter of its songs failed or empty."""
    root, songs = ar.scratch_folder(v.spark), ar.shared_table(recognised(v))
    ar.write_asr_archive(songs, root, "20240101_000000_all", "2024-01-01T00:00:00")
    later = songs.where("media_id % 3 = 0").withColumn("sentences", F.filter("sentences", lambda x, i: i % 2 == 0))
    failed = (F.col("media_id") + F.col("song_index")) % 8
    empty = failed == 4
    later = later.withColumns({"error": F.when(failed == 0, "no quota"), "sentences": F.when(empty, F.lit(None)).otherwise(F.col("sentences")), "words": F.when(empty, F.lit(None)).otherwise(F.col("words"))})
    ar.write_asr_archive(later, root, "20240102_000000_some", "2024-01-02T00:00:00")
    return root


COUNTS = """s AS (SELECT media_id, floor(start_s / 720)::INT AS song_index, count(*) AS sentence_count, count(*) FILTER (i % 2 = 1) AS half FROM (SELECT *, row_number() OVER (PARTITION BY media_id, floor(start_s / 720) ORDER BY pos) AS i FROM sent) GROUP BY ALL),
    w AS (SELECT media_id, floor(start_s / 720)::INT AS song_index, count(*) AS word_count FROM word GROUP BY ALL), b AS (SELECT media_id, song_index, sentence_count, half, coalesce(word_count, 0) AS word_count FROM s LEFT JOIN w USING (media_id, song_index))"""


@query("S02_read_asr_archive", f"""WITH {COUNTS}, n AS (SELECT *, media_id % 3 = 0 AND (media_id + song_index) % 4 <> 0 AS later FROM b)
    SELECT '/media/' || media_id || '.mp4' AS video_path, song_index, CASE WHEN later THEN '20240102_000000_some' ELSE '20240101_000000_all' END AS archive, media_id || '/song_' || lpad((song_index + 1)::VARCHAR, 3, '0') || '.json' AS file, CASE WHEN later THEN half ELSE sentence_count END AS sentence_count, word_count FROM n""")
def s02(v):
    return ar.read_asr_archive(v.spark, archived(v)).drop("asr_result")


@query("S02_first_usable_archive", "SELECT cache_key, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY saved_at DESC, entry_id) AS nr FROM ttl WHERE usable AND bytes > 500) WHERE nr = 1")
def s02_first(v):
    usable = dc.asr_usable(F.when(~F.col("usable"), "failed"), F.when(F.col("bytes") > 500, 1).otherwise(0), F.lit(None), F.lit(""))
    return dc.first_usable(v.ttl, ["cache_key"], "saved_at", "entry_id", usable).select("cache_key", "entry_id")


@query("S03_archive_index", f"""WITH {COUNTS}, e AS (SELECT *, (media_id + song_index) % 8 = 4 AS empty FROM b WHERE media_id % 3 = 0), u AS (SELECT '20240101_000000_all' AS archive, media_id, song_index, sentence_count, word_count FROM b
    UNION ALL SELECT '20240102_000000_some', media_id, song_index, CASE WHEN empty THEN 0 ELSE half END, CASE WHEN empty THEN 0 ELSE word_count END FROM e) SELECT archive, '/media/' || media_id || '.mp4' AS video_path, song_index, 'song ' || song_index AS song_name, song_index * 720.0::DOUBLE AS song_start, sentence_count, word_count FROM u""", "song_start")
def s03(v):
    return ar.read_archive_index(v.spark, archived(v)).select("archive", "video_path", "song_index", "song_name", "song_start", "sentence_count", "word_count")


@query("S14_file_inventory", "SELECT category, count(DISTINCT entry_id % 3) AS files, sum(length(entry_id::VARCHAR) + 2)::BIGINT AS bytes, CASE category WHEN 'previews' THEN count(DISTINCT entry_id % 3) ELSE 0 END AS expired FROM (SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN 'previews' ELSE 'uploads' END AS category FROM ttl) GROUP BY category")
def s14_files(v):
    """A file for each category and third of the entries, seen from 30 hours later."""
    root = ar.scratch_folder(v.spark)
    category = F.when(F.col("entry_id") % 2 == 0, "previews").otherwise("uploads").alias("category")
    rows = v.ttl.select(category, (F.col("entry_id") % 3).alias("part"), F.concat(F.lit("e"), F.col("entry_id")).alias("value"))
    rows.repartition("category", "part").sortWithinPartitions("category", "part").write.partitionBy("category", "part").text(root)
    files = dc.file_inventory(v.spark, root)
    later = F.current_timestamp() + F.expr("interval 30 hours")
    return dc.inventory_report(files, F.regexp_extract("path", "category=([^/]+)/", 1), later, {"previews": 24, "uploads": 48})


@query("S05_sample_library_newest", f"WITH l AS ({LATEST.format(where='WHERE cache_key % 7 <> 0')}) SELECT cache_key, entry_id, saved_at, bytes, (SELECT count(*) FROM l) AS library FROM l ORDER BY saved_at DESC, entry_id LIMIT 100", "saved_at")
def s05_newest(v):
    """The newest hundred samples, with the size of the library."""
    rows = v.ttl.select("cache_key", "entry_id", "saved_at", "bytes")
    library = ca.delete(ca.latest(rows, ["cache_key"], "saved_at", "entry_id"), rows.where("cache_key % 7 = 0"), ["cache_key"])
    sized = ca.newest(library, 100, "saved_at", "entry_id").crossJoin(F.broadcast(ca.counted(library).withColumnRenamed("n", "library")))  # one row
    return sized.select("cache_key", "entry_id", "saved_at", "bytes", "library")


@query("S05_sample_library_get", f"WITH l AS ({LATEST.format(where='WHERE cache_key % 7 <> 0')}) SELECT k AS cache_key, entry_id, bytes FROM (SELECT DISTINCT (media_id % 90)::INT AS k FROM tl) JOIN l ON l.cache_key = k")
def s05_get(v):
    rows = v.ttl.select("cache_key", "entry_id", "saved_at", "bytes")
    library = ca.delete(ca.latest(rows, ["cache_key"], "saved_at", "entry_id"), rows.where("cache_key % 7 = 0"), ["cache_key"])
    wanted = v.tl.select((F.col("media_id") % 90).cast("int").alias("cache_key")).distinct()
    return ca.get(library, wanted, ["cache_key"]).select("cache_key", "entry_id", "bytes")


#: entries of some keys are in the cache, of others in the archive, and of others in neither
PLACE = "CASE WHEN cache_key % 3 = 0 AND entry_id % 2 = 0 THEN 'cache' WHEN cache_key % 4 <> 0 THEN 'archive' ELSE 'nowhere' END"
HELD = f"""p AS (SELECT *, {PLACE} AS place FROM ttl), l AS (SELECT place, cache_key, arg_max({{'bytes': bytes, 'usable': usable, 'saved_at': saved_at}}, {{'a': saved_at, 'b': entry_id}}) AS x FROM p GROUP BY ALL),
    c AS (SELECT cache_key, x FROM l WHERE place = 'cache'), a AS (SELECT cache_key, x FROM l WHERE place = 'archive' AND x.usable)"""


def held(v, place):
    rows = v.ttl.where(F.expr(PLACE) == place).select("cache_key", "entry_id", "saved_at", F.col("bytes").alias("payload"), "usable")
    return ca.latest(rows, ["cache_key"], "saved_at", "entry_id")


@query("J21_cache_hits_misses", f"WITH {HELD} SELECT w.cache_key, CASE WHEN c.x.usable THEN 'cache' WHEN a.x IS NOT NULL THEN 'archive' ELSE 'process' END AS origin, CASE WHEN c.x.usable THEN c.x.bytes ELSE a.x.bytes END AS payload FROM (SELECT DISTINCT cache_key FROM ttl) w LEFT JOIN c USING (cache_key) LEFT JOIN a USING (cache_key)")
def j21(v):
    return ca.hits_and_misses(v.ttl.select("cache_key").distinct(), held(v, "cache"), held(v, "archive"), ["cache_key"])


@query("J21_migrated_cache", f"WITH {HELD} SELECT cache_key, CASE WHEN c.x IS NULL OR NOT c.x.usable AND a.x IS NOT NULL THEN a.x ELSE c.x END.bytes AS payload, CASE WHEN c.x IS NULL OR NOT c.x.usable AND a.x IS NOT NULL THEN a.x ELSE c.x END.usable AS usable FROM c FULL JOIN a USING (cache_key)")
def j21_migrated(v):
    """The cache once the archive's hits are saved in it."""
    return ca.migrated(held(v, "cache"), held(v, "archive"), ["cache_key"]).select("cache_key", "payload", "usable")


ORIGIN = "CASE (media_id + song_index) % 4 WHEN 0 THEN 'track' WHEN 1 THEN 'ocr' WHEN 2 THEN 'merged' ELSE 'unknown' END"


@query("S15_run_report", f"""WITH so AS (SELECT DISTINCT media_id, song_index, {ORIGIN} AS source FROM seg), t AS (SELECT media_id, count(*) AS total_segments, count(*) FILTER (source <> 'unknown') AS identified_count, avg((source <> 'unknown')::INT) AS identification_rate, count(*) FILTER (source = 'ocr') AS ocr FROM so GROUP BY media_id),
    l AS (SELECT media_id, song_index, label, count(*) AS n FROM seg GROUP BY ALL), a AS (SELECT media_id, label, sum(n)::BIGINT AS over_all FROM l GROUP BY ALL) SELECT media_id, total_segments, identified_count, identification_rate, ocr, song_index, source, label, n, over_all FROM t JOIN so USING (media_id) JOIN l USING (media_id, song_index) JOIN a USING (media_id, label)""", "identification_rate")
def s15(v):
    """Reports written as a text document for each recording, read back and taken apart."""
    songs = v.seg.select("media_id", "song_index", F.expr(ORIGIN).alias("source")).distinct()
    root = ar.scratch_folder(v.spark)
    dc.write_documents(dc.run_report(songs, v.seg, ["media_id"]), ["media_id"], root)
    docs = v.spark.read.text(root).select(F.col("media_id").cast("long").alias("media_id"), F.from_json("value", dc.REPORT).alias("r"))
    i = F.col("r.identification")
    rows = docs.select("media_id", i["total_segments"].alias("total_segments"), i["identified_count"].alias("identified_count"), i["identification_rate"].alias("identification_rate"), F.coalesce(i["identification_source_breakdown"]["ocr"], F.lit(0)).alias("ocr"), "r.structural_labels", F.explode(i["segment_details"]).alias("d"))
    each = rows.select("*", "d.song_index", "d.source", F.explode("d.label_distribution").alias("label", "n"))
    return each.withColumn("over_all", F.col("structural_labels")[F.col("label")]).drop("structural_labels", "d")
