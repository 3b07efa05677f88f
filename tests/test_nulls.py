"""Null keys, null order values and null states must not lose rows in any scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunked as ch
from tidemark.operators import timeline as tl
from tidemark.operators import transcripts as tr
from tidemark.operators.jobs import upsert_rows
from tidemark.functions import scalar as sc
from tidemark.functions import text as tx
from tidemark.sources import readers as rd

ROWS = [(v, i, s) for v in ("a", None) for i, s in [(0, "x"), (1, "x"), (2, None), (3, "y"), (4, "y"), (None, "z")]]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "vod_id string, idx long, layout_id string")


def test_ordered_scan_keeps_null_keys_and_times(rows):
    got = ch.ordered_scan(rows, ["vod_id"], ["idx"], ch.index_chunk("idx", 2), lag={"before": F.col("layout_id")}, lead={"after": F.col("layout_id")}, cumsum={"n": F.lit(1)}, row_number="rn").collect()
    assert len(got) == len(ROWS)
    for key in ("a", None):
        mine = sorted((r for r in got if r["vod_id"] == key), key=lambda r: r["rn"])
        assert [r["rn"] for r in mine] == [1, 2, 3, 4, 5, 6] and [r["idx"] for r in mine] == [None, 0, 1, 2, 3, 4]
        assert [r["before"] for r in mine] == [None, "z", "x", "x", None, "y"] and [r["after"] for r in mine] == ["x", "x", None, "y", "y", None]
        assert [r["n"] for r in mine] == [0, 1, 2, 3, 4, 5]


def test_runs_and_states_keep_nulls(rows):
    numbered = ch.number_runs(rows, ["vod_id"], ["idx"], ch.index_chunk("idx", 2), "layout_id")
    assert sorted((str(r["vod_id"]), r["run"]) for r in numbered.collect()) == sorted((k, n) for k in ("None", "a") for n in (0, 1, 1, 2, 3, 3))
    whole = rows.where("idx IS NOT NULL")
    assert tl.hysteresis(whole, confirmation=2).count() == whole.count()
    per_run = numbered.groupBy("vod_id", "run").agg(F.count(F.lit(1)).alias("size"))
    assert ch.attach_by_piece(numbered, per_run, ["vod_id"], "run", ch.index_chunk("idx", 2)).count() == len(ROWS)


@pytest.mark.parametrize("sizes", [{"rows": 4, "fan": 3}, {"rows": 4096}])
def test_chains_with_null_keys_follow_the_pointers(spark, sizes):
    rnd = np.random.default_rng(3)
    links = {key: [min(i + int(rnd.integers(1, 6)), 200) for i in range(200)] for key in ("a", None)}
    df = spark.createDataFrame([(k, i, n) for k, ns in links.items() for i, n in enumerate(ns)], "vod_id string, pos long, nxt long")
    got = {(r["vod_id"], r["pos"]) for r in ch.chain_starts(df, ["vod_id"], **sizes).collect()}
    expected = set()
    for key, ns in links.items():
        at = 0
        while at < 200:
            expected.add((key, at))
            at = ns[at]
    assert got == expected


def test_louder_hearing_replaces_one_without_a_probability(spark):
    rows = [(None, 0, 0.0, 5.0, "uno dos tres", None), (None, 1, 4.0, 6.0, "uno dos tres", -0.5), (None, 1, 7.0, 8.0, "fin", -0.1)]
    df = spark.createDataFrame(rows, "vod_id string, chunk_index int, start double, end double, text string, avg_logprob double")
    assert sorted((r["start"], r["avg_logprob"]) for r in tr.merge_chunk_transcripts(df).collect()) == [(4.0, -0.5), (7.0, -0.1)]


def test_two_changes_of_one_row_become_one(spark):
    base = spark.createDataFrame([(1, "a", 5, "old")], "id long, status string, size long, updated_at string")
    changes = spark.createDataFrame([(1, "b", None, 1), (1, None, 7, 2), (2, "n", None, 1)], "id long, status string, size long, at long")
    got = upsert_rows(base, changes, "id", ["status", "size"], "now", newest=[F.col("at")]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "b", 7, "now"), (2, "n", None, "now")]


def test_fingerprints_keep_their_parts_apart(spark):
    one = spark.range(1).select(sc.fingerprint(F.lit("a|b"), F.lit("c")).alias("x"), sc.fingerprint(F.lit("a"), F.lit("b|c")).alias("y")).first()
    assert one["x"] != one["y"]


def test_indented_documents_are_read_and_broken_files_left_out(spark, tmp_path):
    (tmp_path / "good.json").write_text('{\n  "vod_id": 1,\n  "cache_key": "k"\n}')
    (tmp_path / "old.json").write_text('{\n  "vod_id": 2,\n  "cache_key": "other"\n}')
    (tmp_path / "broken.json").write_text('{\n  "vod_id": 3,\n  "cache_')
    assert [r["vod_id"] for r in rd.read_guarded(spark, str(tmp_path), "vod_id long, cache_key string", "k").collect()] == [1]


def test_files_that_are_no_audio_come_back_with_an_error(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"not audio")
    rows = rd.read_pcm_samples(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["error"] and rows[0]["samples"] is None


def test_speaker_names_are_no_patterns(spark):
    got = spark.createDataFrame([("A.* habla sobre Madrid",), ("Axx habla sobre Madrid",)], "t string").select(tx.title_terms(F.col("t"), "A.*").alias("x")).collect()
    assert "habla" not in got[0]["x"] and len(got[1]["x"]) > len(got[0]["x"])


def test_too_many_tags_are_refused(spark):
    got = spark.range(1).select(sc.clean_tags(F.transform(F.sequence(F.lit(1), F.lit(51)), lambda i: i.cast("string"))).alias("x"), sc.clean_tags(F.array(F.lit(" a "), F.lit(" "))).alias("y")).first()
    assert got["x"] is None and got["y"] == ["a"]
