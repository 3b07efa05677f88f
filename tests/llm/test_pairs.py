"""Near-duplicates, repeated passages and benchmark passages against brute force."""

import hashlib
import itertools
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_rows, sentence
from tidemark.llm import lsh_forest, spaced_seeds, suffix_dedup
from tidemark.llm.components import connected_components

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall((text or "").encode())


def shingles(text, k):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {b" ".join(w)} if w else set()


def brute_components(rows, k=4):
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    lead = {d: d for d, _ in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    return {d: find(d) for d in lead}


def near_rows(seed=5):
    rnd, rows = random.Random(seed), []
    for group in range(12):
        base = sentence(rnd, rnd.randint(2, 90)).split()
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 20))):
                copy[rnd.randrange(len(copy))] = rnd.choice("xyz") + str(rnd.randrange(99))
            rows.append((len(rows), ("\n" if rnd.random() < 0.3 else " ").join(copy).upper() if group % 3 else " ".join(copy)))
    return rows


@pytest.mark.parametrize("cfg", [lsh_forest.Forest(), replace(lsh_forest.Forest(), block=3, dense=4, words=5)])
def test_near_duplicates_equal_brute_force(spark, cfg):
    rows = near_rows()
    table = [(d, t, "en", "s", 1) for d, t in rows] + odd_rows()
    docs = documents(spark, table).withColumn("component_id", F.lit(1)).withColumn("id", F.lit("x"))
    got = lsh_forest.near_duplicates(docs, cfg=cfg).collect()
    assert len(got) == len(table)
    expected = brute_components([(d, t) for d, t, *_ in table], cfg.words)
    for row in got:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert row["component_id"] == expected[row["doc_id"]] and row["kept"] == (row["component_id"] == row["doc_id"])
    sizes = {d: len(shingles(t, cfg.words)) for d, t, *_ in table}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)


def test_near_duplicates_of_nothing(spark):
    assert lsh_forest.near_duplicates(documents(spark, [])).collect() == []


def test_dense_region_goes_deeper():
    rnd = np.random.default_rng(1)
    rest = rnd.integers(0, 3, (300, 6)).astype(np.uint8)
    cfg = replace(lsh_forest.Forest(), dense=10, agree=0.5)
    sets = lsh_forest.Union(300)
    lsh_forest.spanning_candidates(rest, cfg, sets, np.arange(300))
    lead = [sets.find(i) for i in range(300)]
    equal = [(i, j) for i in range(300) for j in range(i) if (rest[i] == rest[j]).all()]
    assert equal and all(lead[i] == lead[j] for i, j in equal)  # equal rows always stay together


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(7000, 7000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(51)}, 7000: 7000}


def brute_removed(rows, window=13):
    first = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {i + j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(window)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("cfg", [suffix_dedup.Trees(), replace(suffix_dedup.Trees(), group=2, gather=50, slots=64)])
def test_repeated_passages_equal_brute_force(spark, cfg):
    rnd, rows = random.Random(8), []
    shared = [sentence(rnd, n) for n in (12, 13, 14, 40, 200)]
    for i in range(120):
        parts = [sentence(rnd, rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(shared), sentence(rnd, rnd.randint(0, 9))]
        rows.append((rnd.choice([i, i, i, 5]), rnd.choice([" ", "\n", "  "]).join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, " ".join(["la"] * 60)), (301, " ".join(["la"] * 20)), (302, " ".join(["la"] * 12))]
    table = [(d, t, "en", "s", 1) for d, t in rows] + odd_rows()
    got = suffix_dedup.repeated_passages(documents(spark, table).withColumn("kept", F.lit(0)).withColumn("tid", F.lit(0)), cfg=cfg).collect()

    def digest(r):
        if r["copy"]:
            return hashlib.sha256(b"").hexdigest()
        return hashlib.sha256(r["kept"].encode()).hexdigest() if r["kept"] is not None else bytes(r["digest"]).hex()

    mine = [(r["id"], r["n_words"], r["removed"], digest(r)) for r in got]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(mine, key=key) == sorted(brute_removed([(d, t) for d, t, *_ in table]), key=key)


def test_repeated_passages_of_nothing(spark):
    assert suffix_dedup.repeated_passages(documents(spark, [])).collect() == []


def test_benchmark_passages(spark):
    rnd = random.Random(4)
    items = [(i, sentence(random.Random(50 + i), n)) for i, n in enumerate((15, 20, 40, 59, 3, 7))] + [(6, None), (7, ""), (8, "...")]
    rows, expected = [], set()
    for i in range(60):
        text = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 80))]
        if i % 2:
            n = rnd.randrange(6)
            passage = items[n][1].upper().split()
            if len(passage) > 12 and i % 4 == 1:  # one word in ten is another
                for j in range(5, len(passage), 10):
                    passage[j] = "other"
            at = rnd.randint(0, len(text))
            text[at:at] = passage
            expected.add((i, n))
        rows.append((i, ", ".join(text), "en", "s", 1))
    docs = documents(spark, rows + odd_rows())
    bench = spark.createDataFrame(items, "item_id long, text string")
    for cfg in (spaced_seeds.Seeds(), replace(spaced_seeds.Seeds(), block=30)):
        got = spaced_seeds.overlaps(docs.withColumn("item_id", F.lit(3)), bench, cfg=cfg).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == expected
        assert all(5 * r["equal_tokens"] >= 4 * (r["end_token"] - r["first_token"]) for r in got)
    assert spaced_seeds.overlaps(docs, bench.limit(0)).collect() == []
    assert spaced_seeds.overlaps(documents(spark, []), bench).collect() == []


def brute_passage(item, text, least=13):
    """Whether any alignment has a stretch of `least` tokens, or the whole item, of which four in five agree."""
    for offset in range(-len(item) + 1, len(text)):
        b, e = max(offset, 0), min(offset + len(item), len(text))
        score = np.concatenate([[0], np.cumsum([5 * (item[i - offset] == text[i]) - 4 for i in range(b, e)])])
        if any(score[j] >= score[i] for i in range(e - b + 1) for j in range(i + min(least, len(item)), e - b + 1)):
            return True
    return False


@pytest.mark.parametrize("n", range(2, 26))
def test_substituted_passages_equal_brute_force(n):
    item = [f"k{i}" for i in range(n)]
    block = spaced_seeds.Block([(7, " ".join(item))], spaced_seeds.Seeds())
    for wrong in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in range(4 if n in (15, 16) else 3)):
        passage = ["other" if i in wrong else w for i, w in enumerate(item)]
        for text in (passage, ["x", *passage, "y", "z"], ["x", *passage[2:]], [*passage[:-3], "y"]):
            got = block.overlaps(" ".join(text))
            assert bool(got) == brute_passage(item, text), (wrong, text)
            for _, b, e, equal, size in got:
                assert size == n and e - b >= min(13, n) and 5 * equal >= 4 * (e - b)


def test_masks_leave_no_passage_unseen():
    """In every stretch of 13 to 25 tokens with the most words that may differ, some mask is whole; longer ones hold such a half."""
    for n in range(13, 26):
        wrong = np.array([sum(1 << j for j in c) for c in itertools.combinations(range(n), n // 5)])
        for mask in spaced_seeds.Seeds().masks:
            reads = sum(1 << j for j, c in enumerate(mask) if c == "1")
            for at in range(n - len(mask) + 1):
                wrong = wrong[wrong & (reads << at) != 0]
        assert not len(wrong)


def test_longest_stretch_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(400):
        agree = np.array([rnd.random() < 0.75 for _ in range(rnd.randint(1, 40))])
        fits = [(i, j) for i in range(len(agree)) for j in range(i + 13, len(agree) + 1) if 5 * agree[i:j].sum() >= 4 * (j - i)]
        b, e = spaced_seeds.longest_stretch(agree, 13, 80)
        assert ((b, e) in fits) if fits else (b, e) == (0, 0)
        if fits:
            i, j = max(fits, key=lambda x: (x[1] - x[0], -x[0]))
            assert i <= b and e <= j and agree[b:e].sum() == agree[i:j].sum()
