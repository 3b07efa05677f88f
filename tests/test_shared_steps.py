"""Steps that several queries share: chunks of a batch are handled together, segments are found once, a track is one small array."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import boxes as bx
from tidemark.operators.chunked import chain_starts
from tidemark.plans import catalog_candidates as cc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chains_of_many_keys_take_no_call_per_key(spark):
    random = np.random.default_rng(5)
    rows, expected = [], set()
    for key in [None, *range(40)]:
        n = int(random.integers(1, 60))
        nxt = [int(p + random.integers(1, 9)) for p in range(n)]
        rows += [(key, p, q) for p, q in enumerate(nxt)]
        at = 0
        while at < n:
            expected.add((key, at))
            at = nxt[at]
    starts = chain_starts(spark.createDataFrame(rows, "k int, pos long, nxt long"), ["k"], rows=4, fan=3)
    assert {(r.k, r.pos) for r in starts.collect()} == expected
    assert "FlatMapGroupsInArrow" not in plan(starts) and "MapInArrow" in plan(starts)


def test_a_timeline_is_segmented_once(spark, monkeypatch, tmp_path):
    calls, kinds = [], F.array(*[F.lit(k) for k in ("click", "click", "view", "view", "purchase")])
    n = F.col("id")
    events = spark.range(60).select(n.alias("event_id"), F.timestamp_seconds(n * 7200 + 1_700_000_000).alias("ts"), (n % 3).alias("user_id"),
        F.get(kinds, F.floor(n / 9).cast("int") % 5).alias("event_type"), n.cast("double").alias("value"), F.format_string('{"k": %d}', n).alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    real = cc.layout_segs
    monkeypatch.setattr(cc, "layout_segs", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr("tidemark.plans.catalog_timeline.layout_segs", cc.layout_segs)
    assert cc.q_metrics(spark, str(tmp_path)).count() == 3
    assert len(calls) == 1


def test_track_medians_come_from_one_array(spark):
    rows = [(1, 0, 0, 1, 0.5, 10, 0.1, 0.2, 0.3), (1, 0, 0, 1, 0.7, 21, 0.2, 0.2, 0.3), (1, 0, 0, 2, None, 40, 0.4, 0.3, 0.5), (None, 0, 1, 1, 0.9, 7, 0.3, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "clip_id int, scene_id int, track int, frame_index int, confidence double, w long, area_ratio double, cx double, cy double")
    df = df.withColumn("region", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("w").alias("width"), F.col("w").alias("height")))
    frames = df.groupBy("clip_id", "scene_id").agg(F.count_distinct("frame_index").alias("frame_count"))
    stats = bx.track_stats(df, ["clip_id", "scene_id"], frames.withColumn("frame_count", F.col("frame_count")))
    got = {r.clip_id: (r.frames_seen, r.boxes, r.confidence, r.face_area, r.region.width) for r in stats.collect()}
    assert got == {1: (2, 3, 0.6, 0.2, 21), None: (1, 1, 0.9, 0.3, 7)}
    assert "percentile" not in plan(stats) and "median" not in plan(stats)


def test_boundaries_are_compared_with_notes(spark, tmp_path):
    import duckdb

    import check

    kinds, n = F.array(*[F.lit(k) for k in ("click", "click", "view", "view", "purchase")]), F.col("id")
    events = spark.range(90).select(n.alias("event_id"), F.timestamp_seconds(n * 7200 + 1_700_000_000).alias("ts"), (n % 3).alias("user_id"),
        F.get(kinds, F.floor(n / 9).cast("int") % 5).alias("event_type"), n.cast("double").alias("value"), F.format_string('{"k": %d}', n).alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = cc.q_compare(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    result = con.execute(cc.ORACLES["ground_truth_compare"])
    columns = [d[0] for d in result.description]
    want = check._rows(columns, result.fetchall())
    assert want and check._rows(df.columns, [tuple(r) for r in df.collect()]) == want
