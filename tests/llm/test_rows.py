"""Scores, personal data, outliers, shards, archives, token files and packing."""

import hashlib
import io
import itertools
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import documents, odd_rows, sentence
from tidemark.llm import compression_quality, interleave, length_buckets, pii_boosting, robust_outliers, token_files, warc_zstd
from tidemark.llm.common import shared_path

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_quality_separates_and_scores_every_row(spark):
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, 60) if i % 3 else " ".join(rnd.choice("#$%&*") * 3 + rnd.choice("QXZ") * 2 for _ in range(60)), "en", "s", 1) for i in range(300)]
    docs = documents(spark, rows + odd_rows()).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = compression_quality.train(docs, labels, cfg=replace(compression_quality.Training(), dictionary_bytes=4096))
    got = compression_quality.score(docs, model).collect()
    assert len(got) == 306 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and 200 <= r["doc_id"] < 300]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held]) > 0.95
    assert len({r["score"] for r in got if r["doc_id"] in (900, 901)}) == 1  # null is empty


def test_quality_learns_from_the_whole_of_a_long_text(spark):
    """Texts of 400 KB that differ behind their first 300 KB only."""
    rnd = random.Random(3)
    same = " ".join(rnd.choice(("abc", "def", "ghi", "jkl")) for _ in range(75_000))
    rows = []
    for i in range(24):
        words = ("lovely", "careful", "reasoned", "clear") if i % 2 else ("zzqx", "buy@@", "$$$win", "clickk")
        rows.append((i, same + " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(12_000)), "en", "a", 0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    model = compression_quality.train(documents(spark, rows), labels, cfg=replace(compression_quality.Training(), dictionary_bytes=8192))
    assert b"lovely" in model.good and b"lovely" not in model.bad
    tails = [(100, " ".join(f"careful{i % 50} clear{i % 50}" for i in range(200)), "en", "a", 0), (101, " ".join(f"zzqx{i % 50} buy@@{i % 50}" for i in range(200)), "en", "a", 0)]
    score = {r["doc_id"]: r["score"] for r in compression_quality.score(documents(spark, tails), model).collect()}
    assert score[100] > score[101]


def test_quality_without_labels_or_documents(spark):
    docs = documents(spark, odd_rows())
    model = compression_quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in compression_quality.score(docs, model).collect()} == {0.5}
    assert compression_quality.score(documents(spark, []), model).collect() == []


def plain_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_the_filter_of_texts_loses_no_proposal(monkeypatch):
    rnd, parts = random.Random(5), ["jane", " at ", "\nAT\t", "(at)", "[ at ]", "@", " dot ", "[dot]", ".", " ", "example", "com", "٣", "7", "12", "-", "+", "(", "Zürich"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(20_000)] + ["write to jane at example.com please"]
    with_filter = [pii_boosting.proposals(t) for t in texts]
    monkeypatch.setattr(pii_boosting, "_ANY", re.compile(""))
    monkeypatch.setattr(pii_boosting, "_WRITTEN", re.compile(""))
    assert with_filter == [pii_boosting.proposals(t) for t in texts] and with_filter[-1] and any(p and not re.search("[0-9@]", t) for t, p in zip(texts, with_filter))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(3)
    for i in range(20_000):
        text = "".join(rnd.choice("a1._%+-@@.. ()25Zé\n" if i % 2 else "0123456789. -+()") for _ in range(rnd.randint(0, 50)))
        assert pii_boosting.base_spans(text) == plain_spans(text)
    assert len(pii_boosting.base_spans("1" * 100_000 + "a" * 100_000 + "@" + "1." * 50_000)) > 0  # linear: ends at once


def personal_rows(n=400):
    rnd, rows = random.Random(6), []
    for i in range(n):
        words = sentence(rnd, 40).split()
        if i % 2:
            kind = rnd.randrange(4)
            card = [rnd.randrange(10) for _ in range(15)]
            card += [next(d for d in range(10) if pii_boosting.luhn("".join(map(str, [*card, d]))))]
            words.insert(rnd.randrange(40), [f"ana{i}@mail{i % 9}.example.com", f"{i % 250}.17.{i % 99}.8", "".join(map(str, card)), f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"][kind])
        rows.append((i, " ".join(words), "en", "s", 1))
    return rows


def test_personal_data(spark):
    rows = personal_rows()
    docs = documents(spark, rows + odd_rows()).withColumn("spans", F.lit(0))
    model = pii_boosting.train(docs)
    assert model.trees
    got = {r["doc_id"]: r for r in pii_boosting.detect(docs, model).collect()}
    for d, text, *_ in rows:
        base = plain_spans(text)
        written = ",".join(f"{pii_boosting.KINDS[k]}:{b}:{e}" for k, b, e in base)
        assert got[d]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii_boosting.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(filter(None, written.split(","))) <= set(got[d]["spans"].split(","))
        if not base:
            assert got[d]["spans"] == ""  # clean texts are left alone
    assert got[900]["spans"] == got[901]["spans"] == ""
    found = pii_boosting.selected("please mail to ana77 (at) mail3.example.com or call", model)
    assert [(k, b) for k, b, *_ in found] == [(0, 15)]  # added by the trees: no base rule matches
    assert pii_boosting.redacted("x +1 (234) 555-1234 y", model) == "x [PHONE] y" and pii_boosting.redacted(None, model) is None
    clean = pii_boosting.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(rows) + 6
    assert not [r for r in clean.collect() if plain_spans(r["text"] or "")]


def test_personal_data_without_any(spark):
    docs = documents(spark, odd_rows())
    model = pii_boosting.train(docs)
    assert not model.trees and {r["spans"] for r in pii_boosting.detect(docs, model).collect()} == {""}
    assert pii_boosting.detect(documents(spark, []), pii_boosting.train(documents(spark, []))).collect() == []


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_outliers(spark):
    rnd, rows = random.Random(9), []
    for i in range(260):
        n = rnd.randint(30, 200)
        text = "\n".join(sentence(rnd, 10) for _ in range(n // 10))
        if i % 13 == 0:
            text += ("\n" + sentence(random.Random(1), rnd.choice([7, 8, 9, 30]))) * rnd.randint(2, 4)
        rows.append((i, text, "en", "s" if i % 2 else None, 1))
    strange = [(500 + i, " ".join("#$%&*|<>" * 6 for _ in range(60)), "en", "s", 1) for i in range(4)]
    table = rows + strange + [(600, " ".join(["x"] * 500), "de", "t", 1)] + odd_rows()
    got = {r["doc_id"]: r for r in robust_outliers.judged(documents(spark, table).withColumn("g0", F.lit(1)), ["doc_id"]).collect()}
    for d, text, *_ in table:
        r = got[d]
        counts = plain_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts, d
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
    assert not any(got[500 + i]["kept"] for i in range(4)) and not got[600]["kept"] and not got[900]["kept"]
    assert np.mean([got[d]["kept"] for d, *_ in rows if not got[d]["base_failed"]]) == 1.0
    assert robust_outliers.judged(documents(spark, []), ["doc_id"]).collect() == []


def test_outliers_of_small_groups(spark):
    rnd, rows, planted = random.Random(12), [], set()
    for n in (*range(1, 30), 200):  # a source of n texts, one of them strange; "xx" is a language of one such text
        for i in range(n):
            text = "\n".join(sentence(rnd, 10) for _ in range(rnd.randint(3, 20)))
            if i == 0 and n < 30:
                planted.add(len(rows))
                text = " ".join("#$%&*|<>" * 6 + str(j) for j in range(60))
            rows.append((len(rows), text, "xx" if n == 1 else "en" if n % 2 else None, f"s{n}", 1))
    for few in (rows, rows[:1] + [r for r in rows if r[3] == "s200"]):
        got = {r["doc_id"]: r for r in robust_outliers.judged(documents(spark, few), ["doc_id"]).collect()}
        assert {d for d, r in got.items() if not r["kept"] and not r["base_failed"]} == planted & set(got)
        assert all((r["distance"] is None) == r["base_failed"] for r in got.values())
    alone = robust_outliers.judged(documents(spark, rows[1:2]), ["doc_id"]).collect()
    assert len(alone) == 1 and alone[0]["distance"] is not None


def test_determinant_estimate_ignores_outliers(spark):
    rnd = np.random.default_rng(2)
    good, bad = rnd.normal(0, 1, (400, 4)) @ np.diag([1.0, 2.0, 0.5, 1.0]), rnd.normal(30, 1, (80, 4))
    rows = spark.createDataFrame([("a", *map(float, x)) for x in np.concatenate([good, bad])], "g string, x0 double, x1 double, x2 double, x3 double")
    best = robust_outliers.estimates(rows, ["g"]).first()
    assert np.allclose([best[f"m{i}"] for i in range(4)], good.mean(axis=0), atol=0.5)
    assert best["l11"] < 4


def test_only_dataframe_functions_in_quality_rules(spark):
    plan = robust_outliers.judged(documents(spark, odd_rows()), ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("rows_per_chunk", [20_000, 7])
def test_interleaving(spark, rows_per_chunk):
    rows = [(i, f"t{i}", "en", ["hot", "hot", "hot", "b", None][i % 5], 1) for i in range(311)] + [(7, "t7", "en", "hot", 1)] * 9 + odd_rows()
    docs = documents(spark, rows).withColumn("slot", F.lit("old")).withColumn("stratum", F.lit(1))
    got = interleave.interleaved_shards(docs, 8, rows_per_chunk=rows_per_chunk).collect()
    counts = [sum(r["shard"] == k for r in got) for k in range(8)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k]))
        hot = sum(r["source"] == "hot" for r in got if r["shard"] == k)
        assert abs(hot - counts[k] * sum(r["source"] == "hot" for r in got) / len(rows)) <= 2
    again = interleave.interleaved_shards(docs.repartition(5), 8, rows_per_chunk=13).collect()
    key = lambda rows: sorted(str((r["doc_id"], r["text"], r["shard"], r["slot"])) for r in rows)
    assert key(got) == key(again)
    assert interleave.interleaved_shards(documents(spark, []), 8).collect() == []


def test_shard_files_hold_every_row(spark):
    docs = documents(spark, [(i, "t", "en", "s", 1) for i in range(50)])
    path = shared_path(spark, "test-shards")
    interleave.write_shards(interleave.interleaved_shards(docs, 4), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 4 and spark.read.parquet(path).count() == 50


def test_archives(spark):
    rnd = random.Random(3)
    long_text, short = sentence(rnd, 400), "<p>short é</p>"
    rows = [(i, f"http://a.example/{i}\r\nX: y", rnd.choice([long_text, long_text + "é", short, sentence(rnd, 300), "", None])) for i in range(80)] + [(12, "u", long_text), (None, None, long_text), (None, None, short)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    files = warc_zstd.write_archives(pages, shared_path(spark, "test-warc"))
    got = warc_zstd.read_archives(spark, files, payloads=True).collect()
    assert len(got) == len(rows) == sum(r["records"] for r in files.collect())
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[h or ""] = max(last.get(h or "", -1), p)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    expected = []
    for p, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and p != last[h]
        expected.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert sorted(map(str, expected)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    name = files.first()["file"]
    data = warc_zstd.read_mapped(name).read()
    size = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    reader = zstandard.ZstdDecompressor(dict_data=warc_zstd._dictionary(data[8 : 8 + size])).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True)
    assert reader.read().startswith(b"WARC/1.1\r\n")
    assert warc_zstd.write_archives(pages.limit(0), shared_path(spark, "test-warc")).collect() == []


def test_token_files(spark):
    rnd = random.Random(5)
    alphabet = [" ", " ", "\n", "\t", "a", "be", "é", "1", "'s", ".", "  ", "<|endoftext|>", "漢", "word"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))), "en", "s", 1) for i in rnd.sample(range(-50, 400), 200)] + odd_rows()
    docs = documents(spark, rows).withColumn("id", F.lit("clash"))
    manifest = token_files.write_tokens(docs.repartition(7), shared_path(spark, "test-tokens"), BPE)
    got = token_files.read_tokens(spark, manifest, step=9).collect()
    tokenizer, start, expected = Tokenizer.from_file(BPE), 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in got)
    assert sum(r["tokens"] for r in manifest.collect()) == start
    counts = token_files.token_counts(docs, BPE).collect()
    assert sorted(r["n_tokens"] for r in counts) == sorted(e[2] for e in expected)
    empty = token_files.write_tokens(documents(spark, []), shared_path(spark, "test-tokens"), BPE)
    assert empty.collect() == [] and token_files.read_tokens(spark, empty).collect() == []


def test_boundaries_are_optimal():
    rnd = random.Random(7)
    for _ in range(150):
        n, k = rnd.randint(1, 7), rnd.randint(1, 4)
        lengths, counts = np.array(sorted(rnd.sample(range(40), n))), np.array([rnd.randint(1, 9) for _ in range(n)])
        cost = lambda bounds: sum(int(c) * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts))
        best = min(cost(sorted({*x, int(lengths[-1])})) for x in itertools.combinations(map(int, lengths), min(k, n) - 1))
        bounds = length_buckets.optimal_boundaries(lengths, counts, k)
        assert len(bounds) <= k and cost(bounds) == best


def test_packing(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([0, 1, 5, 100, 513, 700, 5000, rnd.randint(1, 3000)])) for i in range(400)] + [(None, 9), (3, None), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, n long").withColumn("batch", F.lit("old")).withColumn("size", F.lit(-1))
    got = length_buckets.pack(table, "n", buckets=5, budget=4096, rows_per_chunk=50).collect()
    assert len(got) == len(rows) and len({r["bucket"] for r in got}) == 5
    batches = {}
    for r in got:
        batches.setdefault(r["batch"], []).append(r)
        assert r["padding"] == r["bucket_length"] - (r["n"] or 0) >= 0
    assert sorted(batches) == list(range(len(batches)))
    for members in batches.values():
        assert len({m["bucket"] for m in members}) == 1 and sorted(m["place"] for m in members) == list(range(len(members)))
        assert len(members) == 1 or len(members) * members[0]["bucket_length"] <= 4096
    assert length_buckets.pack(table.limit(0), "n").collect() == []


def test_length_classes_are_few_and_close(spark):
    values = [*range(0, 2000), 10**6 + 1, 10**12 + 7, 2**62]
    got = spark.createDataFrame([(v,) for v in values], "n long").select("n", length_buckets.length_class(F.col("n")).alias("c")).collect()
    assert all(r["n"] <= r["c"] <= r["n"] * (1 + 1 / 250) + 0.5 for r in got)
