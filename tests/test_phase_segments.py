"""Segments of phase windows, merged in chunks, against the order statistics and label lists of whole runs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import PHASES
from tidemark.operators import phases as ph
from tidemark.operators import timeline as tl
from tidemark.plans.views import days_of

SCHEMA = ("vod_id int, run long, idx long, start double, end double, phase string, confidence double, reasons array<string>, "
          "smoothing_reasons array<string>, warnings array<string>")


def numbered(spark):
    rng, rows = random.Random(7), []
    for key in (1, 2, None):
        at = 0
        for run, n in enumerate((1, 2, 25, 7, 3, 40, 1)):
            for _ in range(n):
                labels = [rng.choice(("calm", "high_motion", "chat", None, f"only {key}")) for _ in range(rng.randrange(4))]
                rows.append((
                    key, run, at, 30.0 * at, 30.0 * at + 30, f"p{run % 3}", None if run == 4 or rng.random() < 0.1 else rng.randrange(30) / 30,
                    None if rng.random() < 0.1 else labels, ["moved"] if rng.random() < 0.3 else [], ["blind"] if rng.random() < 0.2 else [],
                ))
                at += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows, run):
    """Segments from an order statistic and a list of labels, each over whole runs."""
    both = rows.withColumn("both", F.concat("reasons", "smoothing_reasons"))
    out = {}
    for r in tl.robust_confidence(rows, run).collect():
        out[r.vod_id, r.run] = {"confidence": r.robust_confidence, "reasons": [], "warnings": []}
    for column, name in (("both", "reasons"), ("warnings", "warnings")):
        for r in tl.ordered_labels(both, run, column, "idx", name).collect():
            if (r.vod_id, r.run) in out:
                out[r.vod_id, r.run][name] = r[name]
    return out


@pytest.mark.parametrize("size", [3, 16, 65_536])
def test_segments_equal_whole_runs(spark, size):
    rows = numbered(spark).cache()
    got, want = ph.merge_phase_runs(rows.drop("run"), size=size).collect(), plain(rows, ["vod_id", "run"])
    assert {(r.vod_id, r.run) for r in got} == set(want) and len(got) == len(want)
    source = rows.collect()
    for r in got:
        mine = sorted((s for s in source if (s.vod_id, s.run) == (r.vod_id, r.run)), key=lambda s: s.idx)
        assert (r.start, r.end, r.phase, r.window_count) == (mine[0].start, mine[-1].end, mine[0].phase, len(mine))
        assert r.confidence == pytest.approx(want[r.vod_id, r.run]["confidence"], abs=1e-12)
        assert (r.reasons, r.warnings) == (want[r.vod_id, r.run]["reasons"], want[r.vod_id, r.run]["warnings"])


SCORED = "vod_id int, idx long, start double, end double, phase string, confidence double, reasons array<string>, smoothing_reasons array<string>"


@pytest.mark.parametrize("size", [3, 16])
def test_gaps_and_microsegments_do_not_depend_on_chunks(spark, size):
    rng, rows = random.Random(3), []
    for key in (1, 2, None):
        at = 0.0
        for i in range(120):
            at += rng.choice((0.0, 0.0, 0.0, 5.0))
            scores = [rng.randrange(100) / 100 for _ in PHASES]
            phase = rng.choice(("talking", "talking", "gameplay", "unknown"))
            rows.append((key, i, at, at + 30, phase, rng.randrange(30, 80) / 100, rng.choice(([], ["high_motion"])), [], *scores))
            at += 30
    windows = spark.createDataFrame(rows, f"{SCORED}, {', '.join(f'{p} double' for p in PHASES)}").cache()
    shown = lambda df: sorted((str(r.vod_id), r.idx, r.phase, r.confidence, r.smoothing_reasons) for r in df.collect())
    assert shown(ph.bridge_unknown_gaps(windows, size=size)) == shown(ph.bridge_unknown_gaps(windows))
    assert shown(ph.absorb_microsegments(windows, size=size)) == shown(ph.absorb_microsegments(windows))


def test_merging_shuffles_a_window_to_its_chunk_only(spark):
    """Neither ranges of confidences nor exploded labels are dealt out for runs that lie in one chunk."""
    context = spark.sparkContext
    rows = numbered(spark).drop("run").cache()
    rows.count()
    context.setJobGroup("merge-phase-runs", "")
    try:
        ph.merge_phase_runs(rows).collect()
        jobs = context.statusTracker().getJobIdsForGroup("merge-phase-runs")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 12

def test_chunks_of_samples_are_fewer_than_samples(spark):
    """A user with 60 events in a month lies in a few chunks."""
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 43_000)
    assert spark.range(60).select(ts.alias("ts")).select(days_of("ts").alias("c")).distinct().count() <= 8
