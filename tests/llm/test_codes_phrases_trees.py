"""Rotation codes, phrase mining and Merkle witnesses against brute force."""

import hashlib
import random
import re
from collections import Counter
from dataclasses import replace
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_rows, sentence
from tidemark.llm import merkle_witness, phrase_trie, rotation_codes

# ---------------------------------------------------------------------------------------------------------
# Vectors.


def planted_vectors(dims=32, groups=25, seed=3):
    """Groups around random centres from 0.93 to 1, chains, copies and scaled copies."""
    draw, rows = np.random.default_rng(seed), []
    for g in range(groups):
        at = draw.normal(size=dims)
        for _ in range(int(draw.integers(1, 12))):
            rows.append((at / np.linalg.norm(at) + draw.normal(size=dims) * draw.choice([0.0, 0.02, 0.035, 0.04]) * (1 + g % 2)) * draw.choice([1.0, 1.0, 7.0]))
        for _ in range(g % 3):  # a chain moves away step by step
            at = at / np.linalg.norm(at) + draw.normal(size=dims) * 0.03
            rows.append(at)
    rows += [rows[5], rows[5], rows[40]]
    return [np.asarray(r, np.float64).tolist() for r in rows]


def brute_links(rows, least=0.95):
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, lead = Counter(), {d: d for d, _ in rows if d is not None}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for n, i in enumerate(ok):
        for j in ok[:n]:
            a, b = (np.array(v) / np.abs(v).max() for v in (rows[i][1], rows[j][1]))
            if len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= least:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                lead[y] = x
    return sorted((str(d), links[i], str(find(d) if d is not None else None)) for i, (d, _) in enumerate(rows))


ODD_VECTORS = [None, [], [0.0] * 32, [1.0, None], [float("nan")] * 32, [float("inf")] + [0.0] * 31, [2.0], [5.0], [-1.0], [1.0, 1.0], [1.0, 1.001], [1e-300, 1e-300], [1e300, 1e300]]


@pytest.mark.parametrize("cfg", [rotation_codes.Codes(), rotation_codes.Codes(block=3, crowd=2)])
def test_similar_vectors_equal_brute_force(spark, cfg):
    vectors = planted_vectors()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(2000 + i, v) for i, v in enumerate(ODD_VECTORS)] + [(3, vectors[50]), (None, vectors[0]), (None, None), (1999, vectors[20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("row", F.lit("x")).withColumn("n_links", F.lit("x"))
    got = rotation_codes.similar_vectors(df, cfg=cfg).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)


def test_a_crowd_of_near_vectors_over_many_blocks(spark):
    draw = np.random.default_rng(4)
    centre, rows = draw.normal(size=16) / 4, []
    for i in range(90):
        rows.append((i, (centre + draw.normal(size=16) * 0.045).tolist()))
    for cfg in (rotation_codes.Codes(block=7), rotation_codes.Codes(block=1)):
        got = rotation_codes.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cfg=cfg).collect()
        single = [(d, np.array(v, np.float32).astype(float).tolist()) for d, v in rows]
        assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute_links(single)


def test_no_vectors(spark):
    assert rotation_codes.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, rotation_codes.similar_vectors(nothing).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("dims", [16, 64, 300])
def test_estimates_are_unbiased_and_their_bounds_hold(dims):
    cfg, draw = rotation_codes.Codes(), np.random.default_rng(dims)
    errors, outside = [], 0
    for seed in range(12):  # the expectation is over the rotations
        space = rotation_codes.Space(dims, 1, 1, replace(cfg, seed=100 * seed))
        x = draw.normal(size=(200, dims))
        x /= np.linalg.norm(x, axis=1)[:, None]
        g = draw.normal(size=x.shape)
        g -= (g * x).sum(axis=1)[:, None] * x
        y = 0.95 * x + cfg.slack * g / np.linalg.norm(g, axis=1)[:, None]
        coded = rotation_codes.Coded(space, *space.codes(np.concatenate([x, y])))
        pair = (np.arange(200), np.arange(200) + 200)
        errors.append(np.diag(coded.estimates(*pair)) - 0.95)
        outside += int((~np.diag(coded.may_link(*pair))).sum())
        spread = np.diag(coded.spread(*pair))
        assert 0.6 < errors[-1].std() / spread.mean() < 1.4
    assert abs(np.mean(errors)) < 4 * np.std(errors) / np.sqrt(2400) + 0.004
    assert outside == 0


def test_cells_are_planned_for_the_recall():
    cfg = rotation_codes.Codes()
    for rows in (100, 10**7):
        depth, tables = rotation_codes.planned(64, rows, cfg)
        space, draw = rotation_codes.Space(64, depth, tables, cfg), np.random.default_rng(9)
        x = draw.normal(size=(20_000, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        g = draw.normal(size=x.shape)
        g -= (g * x).sum(axis=1)[:, None] * x
        y = 0.95 * x + cfg.slack * g / np.linalg.norm(g, axis=1)[:, None]
        assert (~(space.cells(x) == space.cells(y)).any(axis=1)).mean() <= 10 * cfg.miss


# ---------------------------------------------------------------------------------------------------------
# Phrases.


def brute_phrases(rows, cfg):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, cfg.longest + 1):
                counts.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= cfg.least}
    out = {}
    for (lang, p), a in found.items():
        inside = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= cfg.percent * a for b in inside):
            continue
        cuts = [(int(Fraction(2_000_000 * a, counts[lang, p[:k]] + counts[lang, p[k:]])), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[: cfg.top]))


def phrase_rows(seed=2):
    rnd, words, rows = random.Random(seed), ["ka", "lo", "Mi", "tér", "ñandú", "x"], []
    shared = [sentence(random.Random(i), n) for i, n in enumerate((2, 3, 4, 7))]
    for i in range(150):
        text = " ".join(rnd.choice(words) if rnd.random() < 0.6 else rnd.choice(shared) for _ in range(rnd.randint(0, 25)))
        rows.append((re.sub(" ", lambda _: rnd.choice([" ", " ", "  ", "\t", ", ", "\n", "\x0b"]), text), rnd.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" \t\n ", "en"), ("one", "solo"), (" ".join(["la"] * 300), "la")]


TINY = replace(phrase_trie.Mining(), least=3)


@pytest.mark.parametrize("cfg", [TINY, replace(TINY, hold=40, burst=4, common=20, bits=8, slice_bytes=200), replace(TINY, least=2, top=5, percent=60), replace(TINY, longest=2)])
def test_collocations_equal_brute_force(spark, cfg):
    rows = phrase_rows()
    table = [(i, text, lang, "s", 1) for i, (text, lang) in enumerate(rows)] + odd_rows()
    docs = documents(spark, table).repartition(5).withColumn("phrase", F.lit(1)).withColumn("key", F.lit(1)).withColumn("word", F.lit(1))
    got = sorted(map(tuple, phrase_trie.collocations(docs, cfg).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == brute_phrases([(t, lang) for _, t, lang, *_ in table], cfg)


def test_one_hash_for_two_words_takes_another_hash(spark, monkeypatch):
    whole = phrase_trie._tables

    def blunt(seed):
        tables = whole(seed)
        if seed == 7:
            tables[0][ord("b")] = tables[0][ord("a")]  # a and b look alike to the first hash
        return tables

    monkeypatch.setattr(phrase_trie, "_tables", blunt)
    table = [(i, f"{'ab'[i % 2]} c {'ab'[i % 2]} d", "en", "s", 1) for i in range(12)]
    got = sorted(map(tuple, phrase_trie.collocations(documents(spark, table), TINY).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == brute_phrases([(t, lang) for _, t, lang, *_ in table], TINY)


def test_trie_counts_spills_and_keeps_clashes(monkeypatch):
    monkeypatch.setattr(phrase_trie, "path_hash", lambda paths: (paths[:, 0] % np.uint64(50)) | np.uint64(1))  # many clashes
    draw, trie, seen, runs = np.random.default_rng(1), phrase_trie.Trie(3, replace(TINY, burst=8, hold=30)), Counter(), []
    for _ in range(40):
        paths = draw.integers(0, 6, (30, 3)).astype(np.uint64) << np.uint64(58)
        seen.update(map(tuple, paths.tolist()))
        trie.add(paths, np.ones(30, np.int64))
        if len(trie) > 30:
            runs += list(trie.spill(15))
    runs += list(trie.spill(0))
    got = Counter()
    for paths, counts in runs:
        assert paths.tolist() == sorted(paths.tolist())
        for p, c in zip(paths.tolist(), counts.tolist()):
            got[tuple(p)] += c
    assert got == seen and len(trie) == 0


def test_phrases_of_nothing(spark):
    assert phrase_trie.collocations(documents(spark, [])).collect() == []
    assert phrase_trie.collocations(documents(spark, odd_rows())).collect() == []


# ---------------------------------------------------------------------------------------------------------
# Trees.


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, fan):
    """(root, siblings of every leaf as (left, right), level by level)."""
    paths, level, where = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(where):
            run = level[at // fan * fan : at // fan * fan + fan]
            paths[i].append(("".join(run[: at % fan]), "".join(run[at % fan + 1 :])))
        level = [H(*level[i : i + fan]) for i in range(0, len(level), fan)]
        where = [at // fan for at in where]
    return level[0], paths


def brute_manifest(rows, fan):
    """rows: (group, id, leaf)."""
    groups = {}
    for g, d, leaf in rows:
        groups.setdefault(g, []).append((d is not None, d or 0, leaf, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fan) for g in names}
    root, tops = brute_tree([trees[g][0] for g in names], fan)
    out = []
    for i, g in enumerate(names):
        for x, path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            out.append((str(g), str(x[3]), x[2], trees[g][0], root, tuple(path + tops[i])))
    return sorted(out)


@pytest.mark.parametrize("shape", [merkle_witness.Shape(), merkle_witness.Shape(fan=2, levels=2, rows_per_part=20), merkle_witness.Shape(fan=3, levels=1, rows_per_part=50)])
def test_witnesses_equal_a_plain_tree(spark, shape):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "a", "a", "b", None, "", "é"]), rnd.choice([None, 5, *range(-40, 400)]), H(str(i))) for i in range(330)] + [("lone", 1, H("x")), ("two", 1, H("y")), ("two", 1, H("y"))]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string").withColumn("rank", F.lit("x")).withColumn("c0", F.lit(2)).withColumn("extra", F.length("leaf"))
    got = merkle_witness.witnesses(df, "source", "doc_id", carried=["extra"], shape=shape)
    shown = got.withColumns({"folded": merkle_witness.folded(F.col("leaf"), F.col("witness")), "wrong": merkle_witness.folded(F.sha2("leaf", 256), F.col("witness")), "proof": merkle_witness.proof_digest(F.col("witness"))}).collect()
    assert sorted((str(r["source"]), str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], tuple((w["left"], w["right"]) for w in r["witness"])) for r in shown) == brute_manifest(rows, shape.fan)
    for r in shown:
        path = [(w["left"], w["right"]) for w in r["witness"]]
        assert r["folded"] == r["root"] == merkle_witness.fold(r["leaf"], path) and r["wrong"] != r["root"] and r["extra"] == 64
        assert r["proof"] == H(*[x for pair in path for x in pair])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 27, 28, 80])
def test_open_tree_equals_a_plain_tree(n):
    leaves = [H(str(i)) for i in range(n)]
    root, paths = brute_tree(leaves, 3)
    tree = merkle_witness.OpenTree(3, merkle_witness.Shape(fan=3).depth(n))
    nodes = [merkle_witness.Node(x) for x in leaves]
    for node in nodes:
        tree.append(node)
    assert tree.finish().digest == root and [node.witness() for node in nodes] == paths


def test_trees_of_one_leaf_and_of_nothing(spark):
    rows = [("a", 1, H("1")), ("b", 1, H("2"))]
    for part in (rows, rows[:1]):
        got = merkle_witness.witnesses(spark.createDataFrame(part, "source string, doc_id long, leaf string"), "source", "doc_id").collect()
        assert sorted((str(r["source"]), str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], tuple((w["left"], w["right"]) for w in r["witness"])) for r in got) == brute_manifest(part, 16)
    assert merkle_witness.witnesses(spark.createDataFrame([], "source string, doc_id long, leaf string"), "source", "doc_id").collect() == []


def test_row_digest_tells_fields_apart(spark):
    rows = [(1, "ab", None), (1, "é", "c"), (1, "", "abc"), (1, None, "")]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b string, c string").select(merkle_witness.row_digest([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got == [H("1:1", "2:ab", "-"), H("1:1", "2:é", "1:c"), H("1:1", "0:", "3:abc"), H("1:1", "-", "0:")]
