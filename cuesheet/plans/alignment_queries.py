"""Alignment of lyric lines on the driver's tables: sentences as lines, their words as what was recognised. difflib's similarity has no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import alignment as al
from cuesheet.operators import lyrics as ly
from cuesheet.plans.registry import query


def parts(v):
    """Sentences as songs of their own, with the lines of their text, and windows over their words."""
    lines = v.sent.select("media_id", "pos", "start_s", F.posexplode(F.split("text", r"(?<=[.\n])\s*")).alias("line", "text")).where("trim(text) <> ''")
    windows = ly.time_windows(v.word, ["media_id", "pos"], ["word_pos"])
    return lines.select("media_id", "pos", "line", "text", (F.col("start_s") + F.col("line") * 4.0).alias("t")), windows


@query("J13_line_window_candidates")
def j13(v):
    return al.line_word_candidates(parts(v)[0], v.word, ["media_id", "pos"], "word_pos", drift=12.0)


@query("Q34_monotone_alignment")
def q34(v):
    lines, _ = parts(v)
    found = al.line_word_candidates(lines, v.word, ["media_id", "pos"], "word_pos", drift=12.0)
    return al.placed_lines(lines, found, ["media_id", "pos"], drift=12.0).drop("text")


@query("J25_sequential_line_match")
def j25(v):
    lines, _ = parts(v)
    return al.sequential_line_match(lines, v.word.withColumnRenamed("word_pos", "nr"), ["media_id", "pos"])


@query("A12_transcript_quality")
def a12(v):
    lyrics = v.sent.select("media_id", "pos", F.col("text").alias("lyrics"))
    return ly.transcript_quality(v.word, lyrics, ["media_id", "pos"], ["word_pos"])
