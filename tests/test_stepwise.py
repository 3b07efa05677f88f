"""Scans of composable steps against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import stepwise as sw


def test_pieces_span_batches_and_nulls_are_equal():
    rows = [(k, c, i) for k in (None, "a", "b") for c in range(3) for i in range(random.Random(c).randint(1, 40))]
    batches = [pa.RecordBatch.from_pylist([{"k": k, "c": c, "i": i} for k, c, i in rows[b : b + 7]], schema=pa.schema([("k", pa.string()), ("c", pa.int64()), ("i", pa.int64())])) for b in range(0, len(rows), 7)]
    seen = []
    for table, starts in sw.whole_pieces(iter(batches), ["k", "c"]):
        for b, e in zip(starts[:-1], starts[1:]):
            part = table.slice(b, e - b).to_pylist()
            assert len({(r["k"], r["c"]) for r in part}) == 1
            seen.append((part[0]["k"], part[0]["c"], len(part)))
    assert seen == [(k, c, sum(r[:2] == (k, c) for r in rows)) for k in (None, "a", "b") for c in range(3)]


@pytest.mark.parametrize("backward", [False, True])
def test_fold_and_spread_equal_loops(backward):
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 30, 40)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    steps = draw.integers(0, 4, (starts[-1], 4))
    follow = lambda a, b: np.take_along_axis(b, a, axis=1)
    whole = sw.fold_pieces(steps, starts, follow, backward)
    state = draw.integers(0, 4, (40, 1))
    before = sw.spread_pieces(steps, starts, state, follow, backward)
    for i, (b, e) in enumerate(zip(starts[:-1], starts[1:])):
        now, total = int(state[i, 0]), np.arange(4)
        for row in range(e - 1, b - 1, -1) if backward else range(b, e):
            assert before[row, 0] == now
            now, total = int(steps[row][now]), steps[row][total]
        assert (whole[i] == total).all()


def plain_path(costs, penalty):
    best, back = list(costs[0]), []
    for row in costs[1:]:
        options = [[best[a] + penalty[a][b] for a in range(len(best))] for b in range(len(best))]
        back.append([o.index(min(o)) for o in options])
        best = [min(o) + c for o, c in zip(options, row)]
    out = [best.index(min(best))]
    for b in reversed(back):
        out.append(b[out[-1]])
    return out[::-1]


@pytest.mark.parametrize("size,fan", [(512, 1024), (4, 3), (1, 2)])
def test_paths_of_many_recordings(spark, size, fan):
    rnd, penalty = random.Random(size), np.array([[0, 3, 9], [2, 0, 4], [5, 5, 0]])
    costs = {(k, n): [[rnd.randint(0, 9) for _ in range(3)] for _ in range(n)] for k, n in [(None, 17), ("a", 1), ("a", 2), ("b", 75), ("c", 9), (None, 3)]}
    rows = [(k, n, i, *c) for (k, n), own in costs.items() for i, c in enumerate(own)]
    df = spark.createDataFrame(rows, "k string, n int, i long, x long, y long, z long").repartition(5)
    got = sw.cheapest_path(df, ["k", "n"], [F.col("x"), F.col("y"), F.col("z")], penalty, idx="i", size=size, fan=fan).collect()
    assert len(got) == len(rows)
    for (k, n), own in costs.items():
        assert [r["choice"] for r in sorted((r for r in got if (r["k"], r["n"]) == (k, n)), key=lambda r: r["idx"])] == plain_path(own, penalty.tolist())
