"""Registered queries against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
# Quick ones from every area; `check.py` runs all of them.
NAMES = [
    "hysteresis", "merge_state_runs", "state_durations", "robust_confidence", "classify_phase_window", "viterbi_smooth", "absorb_microsegments", "silence_cut_list",
    "keep_list", "overlap_join", "chapter_asof_join", "merge_short_scenes", "parse_timecode", "deep_link_url", "source_identity", "stage_fingerprint", "upsert_rows",
    "latest_cached_result", "pick_video_format", "validate_rows", "tumbling_windows", "distinctive_terms", "term_grounded", "hash_embedding", "centroid_similarity",
    "clean_transcript", "content_crop", "profile_match_decision", "region_match_join", "title_grounding", "candidate_score", "ground_truth_notes", "stream_windows",
    "stream_hysteresis", "read_timelines_guarded",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check.TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert check._rows(df.columns, [tuple(r) for r in df.collect()]) == check._rows(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
