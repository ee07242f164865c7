"""Timelines made from the driver's tables: the same views as DataFrames and as SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: microseconds of the first moment of 2024 and of a thousandth of a tick, which is ten minutes
EPOCH_US, TICK_US, SONG = 1_704_067_200_000_000, 600_000, 720.0


def since_2024(ts: str) -> Column:
    """Microseconds of a time without zone."""
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return micros(F.col(ts)) - micros(F.expr("timestamp_ntz'2024-01-01 00:00:00'"))


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def tl(self) -> DataFrame:
        """Frames: media_id, frame, t, rms, kind."""
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        t = F.floor(since_2024("ts") / TICK_US) / F.lit(1000.0)
        return self.table("events").select(F.col("user_id").alias("media_id"), F.row_number().over(order).cast("long").alias("frame"), t.alias("t"), F.col("value").alias("rms"), F.col("event_type").alias("kind"))

    @cached_property
    def seg(self) -> DataFrame:
        """Segments: media_id, song_index, seg_index, start_s, end_s, label, confidence."""
        return self.tl.select("media_id", F.floor(F.col("t") / SONG).cast("int").alias("song_index"), F.col("frame").alias("seg_index"), F.col("t").alias("start_s"), (F.col("t") + F.col("rms")).alias("end_s"), F.col("kind").alias("label"), F.round(F.col("rms") - F.floor("rms"), 2).alias("confidence"))

    @cached_property
    def act(self) -> DataFrame:
        """Activity of the kinds click and view: media_id, act_id, event, start_s, end_s."""
        return self.seg.where("label in ('click', 'view')").select("media_id", F.col("seg_index").alias("act_id"), F.col("label").alias("event"), "start_s", "end_s")

    @cached_property
    def part(self) -> DataFrame:
        """The segments that are not activity."""
        return self.seg.where("label not in ('click', 'view')")

    @cached_property
    def bnd(self) -> DataFrame:
        """Boundaries: media_id, point_id, t, source."""
        names = F.create_map(*map(F.lit, ("error", "title", "purchase", "audio", "signup", "structure")))
        return self.tl.where("kind in ('error', 'purchase', 'signup')").select("media_id", F.col("frame").alias("point_id"), "t", names[F.col("kind")].alias("source"))

    @cached_property
    def sent(self) -> DataFrame:
        """Sentences: media_id, pos, text, start_s, end_s; a clock of 0.08 s a character and 2 s between sentences."""
        users = self.table("events").agg(F.countDistinct("user_id").alias("n"))
        rows = self.table("conversations").crossJoin(F.broadcast(users)).select((F.col("conv_id") % F.col("n")).alias("media_id"), "conv_id", "turn", "text", F.length("text").alias("size"))
        order = Window.partitionBy("media_id").orderBy("conv_id", "turn")
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pos = F.row_number().over(order).cast("long")
        timed = rows.select("media_id", pos.alias("pos"), "text", (before * 0.08 + (pos - 1) * 2.0).alias("start_s"), "size")
        return timed.select("media_id", "pos", "text", "start_s", (F.col("start_s") + F.col("size") * 0.08).alias("end_s"))

    @cached_property
    def word(self) -> DataFrame:
        """Words: media_id, pos, word_pos, word, start_s, end_s; 0.08 s a character of the sentence, words separated by one space."""
        words = self.sent.select("media_id", "pos", "start_s", F.posexplode(F.split(F.regexp_replace("text", r"\s", " "), " ")).alias("word_pos", "word"))
        order = Window.partitionBy("media_id", "pos").orderBy("word_pos").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.length("word") + 1).over(order), F.lit(0))
        timed = words.select("media_id", "pos", "word_pos", "word", (F.col("start_s") + before * 0.08).alias("start_s"))
        return timed.where("word <> ''").select("*", (F.col("start_s") + F.length("word") * 0.08).alias("end_s"))

    @cached_property
    def line(self) -> DataFrame:
        """Text lines: media_id, line, text, t (3 s apart, every fifth without a time)."""
        lines = self.table("documents").select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
        return lines.select("media_id", "line", "text", F.when(F.col("line") % 5 != 4, F.col("line") * 3.0).alias("t"))

    @cached_property
    def vec(self) -> DataFrame:
        """Vectors: song, frame, v."""
        return self.table("embeddings").select(F.col("label").alias("song"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("v"))

    @cached_property
    def lab(self) -> DataFrame:
        """Reviewed segments: sample_id, lang, source, old, new, is_modified, n_chars."""
        rows = self.table("labels").join(self.table("documents"), "doc_id")
        old = F.when(F.col("quality") == 1, "verse").otherwise("chorus")
        new = F.when(F.col("n_chars") > 3000, "chorus").when(F.col("n_chars") < 300, "solo").otherwise(old)
        return rows.select(F.col("doc_id").alias("sample_id"), "lang", "source", old.alias("old"), new.alias("new"), (old != new).alias("is_modified"), "n_chars")

    @cached_property
    def probe(self) -> DataFrame:
        """Title probes: song, probe (from 1), track_id, title, confidence, pos_weight."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        rows = self.table("lineitem").select("*", F.row_number().over(order).cast("long").alias("probe"))
        rows = rows.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        weight = F.when(F.col("probe") == 2, 1.2).otherwise(1.0)
        return rows.select(F.col("l_orderkey").alias("song"), "probe", (F.col("l_suppkey") % 5).alias("track_id"), F.col("p_name").alias("title"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), weight.alias("pos_weight"))

    @cached_property
    def ttl(self) -> DataFrame:
        """Cache entries: entry_id, cache_key, saved_at (seconds), bytes, usable."""
        key = F.get_json_object("props", "$.k").cast("int")
        saved = since_2024("ts") / F.lit(1e6)
        return self.table("events").select(F.col("event_id").alias("entry_id"), key.alias("cache_key"), saved.alias("saved_at"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), (F.col("event_type") != "error").alias("usable"))

    @cached_property
    def path(self) -> DataFrame:
        """Paths: page_id, path."""
        return self.table("pages").select("page_id", F.col("url").alias("path"))

    @cached_property
    def title(self) -> DataFrame:
        """Title candidates: page_id, title."""
        return self.table("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


SQL = {
    "tl": ("", f"SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, ((epoch_us(ts) - {EPOCH_US}) // {TICK_US}) / 1000.0::DOUBLE AS t, value AS rms, event_type AS kind FROM events"),
    "seg": ("tl", f"SELECT media_id, floor(t / {SONG})::INT AS song_index, frame AS seg_index, t AS start_s, t + rms AS end_s, kind AS label, round(rms - floor(rms), 2) AS confidence FROM tl"),
    "act": ("seg", "SELECT media_id, seg_index AS act_id, label AS event, start_s, end_s FROM seg WHERE label IN ('click', 'view')"),
    "part_": ("seg", "SELECT * FROM seg WHERE label NOT IN ('click', 'view')"),
    "bnd": ("tl", "SELECT media_id, frame AS point_id, t, CASE kind WHEN 'error' THEN 'title' WHEN 'purchase' THEN 'audio' ELSE 'structure' END AS source FROM tl WHERE kind IN ('error', 'purchase', 'signup')"),
    "sent": ("", "SELECT media_id, pos, text, start_s, start_s + size * 0.08::DOUBLE AS end_s FROM (SELECT media_id, row_number() OVER w AS pos, text, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 0.08::DOUBLE + (row_number() OVER w - 1) * 2.0::DOUBLE AS start_s, size FROM (SELECT conv_id % (SELECT count(DISTINCT user_id) FROM events) AS media_id, conv_id, turn, text, length(text) AS size FROM conversations) WINDOW w AS (PARTITION BY media_id ORDER BY conv_id, turn))"),
    "word": ("sent", "SELECT media_id, pos, word_pos, word, start_s + before * 0.08::DOUBLE AS start_s, start_s + before * 0.08::DOUBLE + length(word) * 0.08::DOUBLE AS end_s FROM (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY media_id, pos ORDER BY word_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT media_id, pos, start_s, generate_subscripts(w, 1) - 1 AS word_pos, unnest(w) AS word FROM (SELECT media_id, pos, start_s, string_split(regexp_replace(text, '\\s', ' ', 'g'), ' ') AS w FROM sent))) WHERE word <> ''"),
    "line": ("", "SELECT media_id, line, text, CASE WHEN line % 5 <> 4 THEN line * 3.0::DOUBLE END AS t FROM (SELECT doc_id AS media_id, (generate_subscripts(w, 1) - 1)::INT AS line, unnest(w) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))"),
    "vec": ("", "SELECT label AS song, vec_id AS frame, embedding::DOUBLE[] AS v FROM embeddings"),
    "lab": ("", "SELECT *, old <> new AS is_modified FROM (SELECT doc_id AS sample_id, lang, source, CASE WHEN quality = 1 THEN 'verse' ELSE 'chorus' END AS old, CASE WHEN n_chars > 3000 THEN 'chorus' WHEN n_chars < 300 THEN 'solo' WHEN quality = 1 THEN 'verse' ELSE 'chorus' END AS new, n_chars FROM labels JOIN documents USING (doc_id))"),
    "probe": ("", "SELECT l_orderkey AS song, probe, l_suppkey % 5 AS track_id, p_name AS title, round(l_discount * 10, 2) AS confidence, CASE WHEN probe = 2 THEN 1.2 ELSE 1.0 END::DOUBLE AS pos_weight FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS probe FROM lineitem) JOIN part ON l_partkey = p_partkey"),
    "ttl": ("", f"SELECT event_id AS entry_id, json_extract_string(props, '$.k')::INT AS cache_key, (epoch_us(ts) - {EPOCH_US}) / 1e6::DOUBLE AS saved_at, floor(value * 100)::BIGINT AS bytes, event_type <> 'error' AS usable FROM events"),
    "path": ("", "SELECT page_id, url AS path FROM pages"),
    "title": ("", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages"),
}


def with_views(sql: str) -> str:
    """The SQL with a WITH clause of the views that it names."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for x in SQL[name][0].split():
            want(x)
        if name not in wanted:
            wanted.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            want(name)
    views = ", ".join(f"{x} AS ({SQL[x][1]})" for x in wanted)
    body = sql.strip()
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"
