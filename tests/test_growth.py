"""What steps cost as their tables grow: files, repeated expressions, joins."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_an_archive_are_not_one_for_each_recording(spark, tmp_path):
    from cuesheet.sources import archives as ar

    none = F.lit(None).cast("string")
    said = F.array(F.struct(F.lit("la").alias("text"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s")))
    words = F.array(F.struct(F.lit("la").alias("word"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s")))
    songs = spark.range(0, 50, 1, 2).select(
        F.col("id").alias("media_id"), F.concat(F.lit("/media/"), "id").alias("video_path"), F.lit(0).alias("song_index"), F.lit("song").alias("song_name"), none.alias("song_title"), none.alias("song_artist"),
        F.lit(0.0).alias("song_start"), F.lit(720.0).alias("song_end"), none.alias("error"), none.alias("text"), said.alias("sentences"), words.alias("words"),
    )
    ar.write_asr_archive(songs, str(tmp_path), "a", "2024-01-01T00:00:00")
    assert len(list((Path(tmp_path) / "a" / "payload").rglob("*.json"))) <= 2
    found = ar.read_asr_archive(spark, str(tmp_path))
    assert sorted((r.video_path, r.file, r.sentence_count, r.word_count) for r in found.collect()) == sorted((f"/media/{i}", f"{i}/song_001.json", 1, 1) for i in range(50))
    assert ar.read_asr_archive(spark, str(tmp_path), media="/media/7").count() == 1


def test_songs_of_the_archives_are_made_once(spark):
    from cuesheet import plans

    found = plans.queries()["S02_read_asr_archive"](spark, "/root/testdata/sf0.001")
    assert "conversations" not in plan(found) and "Window" in plan(found)


def test_a_title_is_scored_only_where_none_with_more_votes_is_likely(spark):
    from cuesheet.operators.titles import title_pool_vote

    frames = spark.createDataFrame([(1, "@@@@ !!", 9.0), (1, "Blue Moon|Red Sun", 1.0), (1, "Blue Moon", 1.0), (2, "!!!!", 1.0), (3, "Bb|Aa Aa", 1.0), (3, "Aa Ab", 1.0)], "song int, text string, score double")
    rows = frames.withColumns({"ocr_score": F.lit(0.0), "closeness": F.lit(0.0)})
    found = title_pool_vote(rows, ["song"])
    assert sorted(found.select("song", "title", "votes").collect()) == [(1, "Blue Moon", 2.6), (3, "Aa Aa", 1.3)]
    assert "Window" not in plan(found)


def test_shares_of_a_subtitle_are_worked_out_once(spark):
    from cuesheet.operators.snapping import split_subtitles

    found = split_subtitles(spark.createDataFrame([(1, "one, two three four. " * 20, 3.0, 20.0), (2, "short", 0.0, 0.1), (3, None, 0.0, 1.0)], "id int, text string, start_s double, end_s double"))
    # the sum of lengths and the running sum, neither of them for each part
    assert plan(found).count("aggregate(") == 2
    rows = sorted(found.where("id = 1").select("part", "text", "start_s", "end_s").collect())
    total, at = sum(len(r.text) for r in rows), 0.0
    for r in rows:
        assert r.start_s == min(20.0, 3.0 + at)
        at += 17.0 * len(r.text) / total
    assert rows[-1].end_s == 20.0 and len(rows) > 30


def test_time_transform_gathers_a_song_once(spark):
    from cuesheet.operators.songs import fit_time_transform

    pairs = [(1, x, 2.0 + 1.1 * x, 0.5) for x in (0.0, 10.0, 20.0, 30.0)] + [(1, 40.0, 3.0, None), (2, 1.0, 5.0, 1.0), (3, None, 4.0, 1.0), (3, 1.0, 2.0, 1.0), (4, 0.0, 0.0, 1.0), (4, 1.0, 9.0, 1.0)]
    found = fit_time_transform(spark.createDataFrame(pairs, "song int, x double, y double, w double"), ["song"])
    assert sorted(found.select("song", F.round("scale", 6), F.round("offset", 6), "inliers").collect()) == [(1, 1.1, 2.0, 4), (2, 1.0, 4.0, 0), (3, 1.0, 1.0, 0), (4, 1.0, 4.0, 0)]
    assert "Join" not in plan(found)


def overlapping_chain(spark, clips: int):
    """Two timelines of clips that overlap the next by 5 s, each cut at a sentence's edge beside what the cut before leaves."""
    segments = [(m, 1, i, 8.0 * i + m, 8.0 * i + m + 13.0, "x", False) for m in (1, 2) for i in range(clips)]
    sentences = [(m, 1, 3.7 * i, 3.7 * i + 2.9) for m in (1, 2) for i in range(3 * clips)]
    rows = spark.createDataFrame(segments, "media_id long, song_index int, seg_index long, start_s double, end_s double, type string, is_highlight boolean")
    return segments, sentences, rows, spark.createDataFrame(sentences, "media_id long, song_index int, start_s double, end_s double")


def test_a_chain_of_cuts_takes_no_round_for_each_pair(spark, monkeypatch):
    from cuesheet.operators import cutsafety as cs

    made, table = [], cs._table
    monkeypatch.setattr(cs, "_table", lambda rows: made.append(1) or table(rows))
    tables = []
    for clips in (3, 24):
        *_, rows, sentences = overlapping_chain(spark, clips)
        cs.normalize_overlaps(rows, sentences, None, ["media_id"], 8.0, 18.0, ("part",))
        tables.append(len(made))
        made.clear()
    assert tables[0] == tables[1]


def test_chunks_of_a_chain_give_its_cuts(spark, monkeypatch):
    from functools import partial

    from cuesheet.operators import cutsafety as cs
    from tests.test_cutsafety import plain

    segments, sung, rows, sentences = overlapping_chain(spark, 14)
    want = plain(segments, sung, [], (8, 18), ("part", "protect"))
    chained = cs.chained_cuts
    for size in (3, 256):
        monkeypatch.setattr(cs, "chained_cuts", partial(chained, size=size))
        found = cs.normalize_overlaps(rows, sentences, None, ["media_id"], 8.0, 18.0, ("part", "protect")).collect()
        assert sorted((r.media_id, round(r.start_s, 2), round(r.end_s, 2), r.type, r.is_highlight, r.filled) for r in found) == want
