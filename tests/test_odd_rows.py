"""Rows that the small tables lack: segments without length, equal times, silent songs."""

from __future__ import annotations

import math

from cuesheet.operators import intervals as iv

SEG = "media_id long, seg_index long, start_s double, end_s double, label string, confidence double"
ACT = "media_id long, act_id long, event string, start_s double, end_s double"


def test_share_of_a_segment_without_length(spark):
    segments = spark.createDataFrame([(1, 1, 5.0, 5.0, "error", 0.0), (1, 2, 0.0, 10.0, "error", 0.5), (1, 3, 90.0, 90.0, "signup", 0.0)], SEG)
    activity = spark.createDataFrame([(1, 1, "click", 0.0, 8.0)], ACT)
    found = {r.seg_index: (r.click, r.view) for r in iv.overlap_ratio(segments, activity, ["media_id"], ["seg_index"], ["click", "view"]).collect()}
    assert found[2] == (0.8, 0.0)
    assert all(math.isnan(x) for i in (1, 3) for x in found[i])


def test_label_of_a_segment_without_length(spark):
    from pyspark.sql import functions as F

    from cuesheet.functions import labels as lb

    segments = spark.createDataFrame([(1, 1, 5.0, 5.0, "signup", 0.0)], SEG)
    activity = spark.createDataFrame([(1, 1, "click", 0.0, 8.0)], ACT)
    shares = iv.overlap_ratio(segments, activity, ["media_id"], ["seg_index", "label", "confidence"], ["click", "view"])
    found = lb.refined_by_activity(F.col("label"), F.col("confidence"), F.col("click"), F.col("view"), intro="purchase", spoken=("error", "signup"))
    assert shares.select(found.alias("x")).select("x.label", "x.confidence").collect() == [("verse", 0.3)]


def test_segment_without_length_in_a_region(spark):
    segments = spark.createDataFrame([(1, 1, 5.0, 5.0, "error", 0.0), (1, 2, 50.0, 50.0, "error", 0.0)], SEG)
    regions = spark.createDataFrame([(1, 1, "click", 0.0, 8.0)], ACT)
    totals = spark.createDataFrame([(1, 100.0)], "media_id long, total_s double")
    found = iv.upgrade_by_region_overlap(segments, regions, totals, ["media_id"], ["seg_index"], ["error"]).select("seg_index", "label").collect()
    assert sorted(found) == [(1, "chorus"), (2, "error")]


def test_vocal_share_without_voices_and_in_silence(spark):
    from pyspark.sql import functions as F

    from cuesheet.operators.frames import vocal_share

    rows = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 2.0), (3, 0.0, 0.0), (4, None, 0.0), (5, 3.0, 2.0)], "k long, vocal double, full double")
    assert sorted(rows.select("k", vocal_share(F.col("vocal"), F.col("full"))).collect()) == [(1, 0.0), (2, 0.5), (3, 1.0), (4, 1.0), (5, 1.0)]


def test_equally_near_scores_give_the_earlier(spark):
    from cuesheet.operators.asof import lookup_with_tolerance

    points = spark.createDataFrame([(1, 1, 10.3)], "media_id long, point_id long, t double")
    scores = spark.createDataFrame([(1, 10.1, 1.0), (1, 10.5, 2.0)], "media_id long, t double, score double")
    assert 10.3 - 10.1 > 10.5 - 10.3
    assert lookup_with_tolerance(points, scores, ["media_id"], 5.0).select("score").collect() == [(1.0,)]


def test_valley_just_beyond_the_distance(spark):
    from cuesheet.operators.structure import song_boundaries

    chosen, valley = next((a / 1000, (a + 60_000) / 1000) for a in range(100_001, 200_000) if (a + 60_000) / 1000 - a / 1000 > 60.0)
    points = spark.createDataFrame([(1, chosen, 1.0)], "media_id long, t double, rms double")
    frames = spark.createDataFrame([(1, t, r) for t, r in ((valley - 2, 5.0), (valley - 1, 5.0), (valley, 1.0), (valley + 1, 5.0), (valley + 2, 5.0))], "media_id long, t double, rms double")
    totals = spark.createDataFrame([(1, 900.0)], "media_id long, total_s double")
    found = song_boundaries(points, frames, totals, ["media_id"], "t", "rms", "rms", distance=60.0, song=250.0, reach=2)
    assert sorted(found.select("t", "origin").collect()) == [(chosen, "score"), (valley, "valley")]


def test_valleys_among_frames_at_one_time(spark):
    from types import SimpleNamespace

    from cuesheet.plans.structure_queries import q08

    # the last of the three frames at 310 s is out of the reach of the valley at 305 s
    rows = [(1, i + 1, t, x, "view") for i, (t, x) in enumerate([(301.0, 9.0), (303.0, 9.0), (305.0, 2.0), (310.0, 9.0), (310.0, 9.0), (310.0, 1.0), (312.0, 9.0), (314.0, 9.0)])]
    seg = spark.createDataFrame([(1, 900.0)], "media_id long, end_s double")
    for some in (rows, rows[::-1]):
        tl = spark.createDataFrame(some, "media_id long, frame long, t double, rms double, kind string").coalesce(1)
        found = q08(SimpleNamespace(tl=tl, seg=seg)).collect()
        assert found == [(1, 305.0, "valley")]


def test_quantile_between_values_an_ulp_apart(spark):
    from cuesheet.operators.folds import structure_split

    low, high = 0.5484816546999538, 0.5484816546999539
    change = [(1, 10.0, 0.1)] * 40 + [(1, 10.0, low), (1, 200.0, high)] + [(1, 10.0, 0.9)] * 17
    frames = spark.createDataFrame(change, "media_id long, t double, change double")
    totals = spark.createDataFrame([(1, 500.0)], "media_id long, total_s double")
    beats = spark.createDataFrame([], "media_id long, t double")
    found = structure_split(frames, beats, totals, ["media_id"], 300.0, 150.0, 450.0)
    assert sorted(found.select("start_s", "end_s").collect()) == [(0.0, 300.0), (300.0, 500.0)]


def test_quantile_rounds_as_the_sql_does(spark):
    import random

    import duckdb

    from cuesheet.operators.frames import quantile

    rng = random.Random(5)
    # 90 x 0.7 and 340 x 0.7 come out just below a whole number
    rows = [(k, rng.random()) for k in range(300) for _ in range(91 if k % 2 else 341)]
    frames = spark.createDataFrame(rows, "k long, v double")
    table = frames.toArrow()  # noqa: F841
    want = dict(duckdb.sql("SELECT k, quantile_cont(v, 0.7) FROM \"table\" GROUP BY k").fetchall())
    got = dict(map(tuple, frames.groupBy("k").agg(quantile("v", 0.7)).collect()))
    assert got == want


def test_first_of_frames_at_one_time(spark):
    from cuesheet.operators.frames import segment_features

    frames = spark.createDataFrame([(1, 2, 0.0, 1.0, 30.0, 0.5), (1, 1, 0.0, 1.0, 10.0, 0.5), (1, 4, 5.0, 1.0, 90.0, 0.5), (1, 3, 5.0, 1.0, 40.0, 0.5)], "media_id long, frame long, t double, rms double, centroid double, likelihood double")
    segments = spark.createDataFrame([(1, 1, 0.0, 9.0, "error", 0.0)], SEG)
    for some in (frames, frames.orderBy("frame"), frames.orderBy("frame", ascending=False)):
        found = segment_features(some, segments, ["media_id"], "seg_index", "t", "frame", "rms", "centroid", "likelihood", 10.0)
        assert found.select("centroid_gradient").collect() == [(30.0,)]
