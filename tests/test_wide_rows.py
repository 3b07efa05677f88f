"""Boxes and segments keep their columns on the way: no join brings them back."""

from pyspark.sql import functions as F

from tidemark.operators import boxes as bx
from tidemark.session import cut_to_files

SCENE, ORDER = ["clip_id", "scene_id"], ["det"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def detections(spark):
    rows = [(c, s, f, d, 0.1 * f + 0.3 * (d or 0), 0.5, 100.0, 0.9 - 0.01 * (d or 0), f"{c}{s}{f}{d}") for c in (None, 1) for s in (0, 1) for f in (0, 1, 2) for d in (0, 1, None)]
    rows += [(1, 0, 1, 1, 0.9, 0.9, 100.0, 0.7, "twice"), (2, 0, 0, None, 0.2, 0.2, 50.0, 0.8, "alone")]
    return spark.createDataFrame(rows, "clip_id int, scene_id int, frame_index int, det int, cx double, cy double, area double, confidence double, tag string")


def test_linked_boxes_keep_their_columns(spark):
    d = detections(spark)
    carried = bx.link_tracks(d, SCENE, ORDER, carry=("tag", "confidence"))
    joined = bx.join_same(bx.link_tracks(d, SCENE, ORDER).select(*SCENE, "frame_index", *ORDER, "track"), d, [*SCENE, "frame_index", *ORDER])
    columns = [*SCENE, "frame_index", *ORDER, "track", "cx", "cy", "area", "tag", "confidence"]
    both = [sorted((tuple(r) for r in x.select(*columns).collect()), key=str) for x in (carried, joined)]
    assert both[0] == both[1] and len(both[0]) == 40  # two boxes of one name: a row for each of their tracks
    assert "Join" not in plan(carried) and plan(carried).count("Exchange") == 1


def test_best_track_and_margin_in_one_pass(spark):
    rows = [(1, 0, 0, 0.5, "a"), (1, 0, 1, 0.9, "b"), (1, 0, 2, 0.9, "c"), (1, 1, 0, 0.3, "d"), (None, 0, 4, 0.1, "e"), (None, 0, 5, 0.4, "f")]
    best = bx.best_tracks(spark.createDataFrame(rows, "clip_id int, scene_id int, track long, track_score double, tag string"), SCENE)
    assert {(r.clip_id, r.scene_id): (r.track, r.tag, round(r.dominant_margin, 9)) for r in best.collect()} == {(1, 0): (1, "b", 0.0), (1, 1): (0, "d", 1.0), (None, 0): (5, "f", 0.3)}
    assert "Join" not in plan(best)


def test_merged_segments_keep_their_columns(spark):
    rect = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"
    rows = [(1, i, i * 10.0, i * 10.0 + 10, layout, 0.5 + 0.1 * i, ["r"], f"t{i}") for i, layout in enumerate(["no_face", "no_face", "small_facecam", "small_facecam", "no_face"])]
    segs = spark.createDataFrame(rows, "clip_id int, scene_id long, start double, end double, layout string, confidence double, reasons array<string>, tag string")
    for name in ("facecam_region", "output_crop", "content_crop"):
        segs = segs.withColumn(name, F.lit(None).cast(rect))
    segs = segs.withColumns({"facecam_position": F.lit("left"), "duplicate_facecam_excluded": F.lit(False), "detection_source": F.lit("automatic")})
    out = bx.stabilize_segments(segs, ["clip_id"])
    assert out.columns[:8] == segs.columns[:8]
    found = sorted((r.scene_id, r.start, r.end, r.confidence, r.tag) for r in out.collect())
    assert found == [(0, 0.0, 20.0, 0.55, "t0"), (2, 20.0, 40.0, 0.75, "t2"), (4, 40.0, 50.0, 0.9, "t4")]
    twice = bx.stabilize_segments(segs.unionByName(segs.where("scene_id = 4")), ["clip_id"]).where("scene_id = 4")
    assert [r.tag for r in twice.collect()] == ["t4", "t4"]


def test_wide_rows_are_cut_as_compressed_columns(spark):
    df = spark.range(10).select("id", F.struct(F.lit(None).cast("long").alias("x")).alias("box"), F.array(F.lit("r")).alias("reasons"))
    cut = cut_to_files(df)
    assert "FileScan parquet" in plan(cut) and cut.dtypes == df.dtypes
    assert sorted(map(str, cut.collect())) == sorted(map(str, df.collect()))
