"""Chunked scans against plain sequential code, with chunks far smaller than the keys."""

import random

from pyspark.sql import functions as F

from tidemark.operators.chunked import attach_by_piece, chain_starts, index_chunk, number_runs, ordered_scan, select_rounds


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def sample(seed, n=300, keys=3):
    rng = random.Random(seed)
    sizes = [n, n // 3, 1][:keys]
    return [(k, i, rng.choice("ab") if rng.random() < 0.7 else "c", rng.choice([None, 1, 2, 3])) for k, size in enumerate(sizes) for i in range(size)]


def test_ordered_scan_equals_a_loop(spark):
    rows = sample(1)
    df = table(spark, rows, "k int, i int, s string, v int").repartition(5)
    out = ordered_scan(
        df, ["k"], ["i"], index_chunk("i", 7), lag={"p": F.col("s")}, lead={"n": F.col("s")}, cumsum={"c": F.coalesce("v", F.lit(0))},
        cummax={"m": F.col("v")}, last={"l": F.col("v")}, last_before={"lb": F.col("v")}, following={"f": F.col("v")}, row_number="rn",
    )
    got = {(r.k, r.i): r for r in out.collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        for i, row in enumerate(own):
            r, before = got[(k, row[1])], [x[3] for x in own[:i] if x[3] is not None]
            after = [x[3] for x in own[i:] if x[3] is not None]
            assert r.p == (own[i - 1][2] if i else None) and r.n == (own[i + 1][2] if i + 1 < len(own) else None)
            assert r.c == sum(before) and r.m == max(before, default=None) and r.rn == i + 1
            upto = [x[3] for x in own[:i + 1] if x[3] is not None]
            assert r.l == (upto[-1] if upto else None) and r.lb == (before[-1] if before else None) and r.f == (after[0] if after else None)


def test_runs_and_pieces(spark):
    rows = sample(2)
    df = table(spark, rows, "k int, i int, s string, v int")
    runs = number_runs(df, ["k"], ["i"], index_chunk("i", 5), "s")
    expected, last = {}, {}
    for k, i, s, _ in rows:
        run = last[k][1] + (last[k][0] != s) if k in last else 0
        last[k] = (s, run)
        expected[(k, i)] = run
    assert {(r.k, r.i): r.run for r in runs.collect()} == expected
    sizes = runs.groupBy("k", "run").agg(F.count(F.lit(1)).alias("n"))
    back = attach_by_piece(runs, sizes, ["k"], "run", index_chunk("i", 5)).collect()
    assert len(back) == len(rows)
    assert all(r.n == sum(1 for key, v in expected.items() if key[0] == r.k and v == r.run) for r in back)


def test_chain_through_three_levels(spark):
    rng = random.Random(3)
    rows = [(k, i, i + rng.randint(1, 9)) for k, n in ((0, 500), (1, 37), (2, 1)) for i in range(n)]
    follow = {(k, i): n for k, i, n in rows}
    expected = set()
    for k in (0, 1, 2):
        at = 0
        while (k, at) in follow:
            expected.add((k, at))
            at = follow[(k, at)]
    df = table(spark, rows, "k int, pos long, nxt long")
    for size, fan in ((8, 4), (16, 1000), (4096, 4096)):
        assert {(r.k, r.pos) for r in chain_starts(df, ["k"], rows=size, fan=fan).collect()} == expected


def test_greedy_rounds_skip_what_does_not_fit(spark):
    rows = [(0, 1, 10.0), (0, 2, 20.0), (0, 3, 5.0), (0, 4, 1.0), (1, 1, 99.0)]
    df = table(spark, rows, "k int, rank int, d double")
    fits = lambda s, r: (s["total"] + r["d"] <= 16) | (s["total"] == 0)
    take = lambda s, r: {"total": s["total"] + r["d"]}
    for at_once in (1, 2, 64):
        out = select_rounds(df, ["k"], 3, ["d"], {"total": ("double", F.lit(0.0))}, fits, take, "rank", at_once)
        assert sorted((r.k, r["rank"], r.picked) for r in out.where("picked IS NOT NULL").collect()) == [(0, 1, 1), (0, 3, 2), (0, 4, 3), (1, 1, 1)]


def test_greedy_rounds_equal_a_loop(spark):
    rng = random.Random(8)
    rows = [(k, i, float(rng.randint(1, 9))) for k, n in ((None, 200), (1, 3), (2, 90)) for i in range(n)]
    df = table(spark, rows, "k int, rank int, d double")
    near = lambda s, r: ~F.exists(s["kept"], lambda k: F.abs(k - r["d"]) < 1.5)
    take = lambda s, r: {"kept": F.array_append(s["kept"], r["d"])}
    expected = []
    for key in (None, 1, 2):
        kept = []
        for k, i, d in rows:
            if k == key and len(kept) < 4 and not any(abs(d - x) < 1.5 for x in kept):
                kept.append(d)
                expected.append((str(k), i, len(kept)))
    for at_once in (1, 3, 64):
        out = select_rounds(df, ["k"], 4, ["d"], {"kept": ("array<double>", F.array())}, near, take, "rank", at_once)
        assert sorted((str(r.k), r["rank"], r.picked) for r in out.where("picked IS NOT NULL").collect()) == sorted(expected)
