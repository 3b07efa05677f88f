"""Padded batches with little padding: optimal length buckets from the global histogram, token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunked_rank, shared_table


def length_class(length: Column) -> Column:
    """Lengths up to 512 as they are, longer ones rounded up to 9 leading bits: at most 512 + 256 x 55 classes for any table."""
    bits = F.length(F.bin(length)) - 9
    step = F.expr("1L").cast("long")
    step = F.when(bits > 0, F.pow(F.lit(2.0), bits).cast("long")).otherwise(step)
    return F.when(length <= 512, length).otherwise(F.ceil(length / step).cast("long") * step)


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least padding in all, for ascending class lengths.

    best[b][j]: least padded size of the first j classes in b buckets = min over i of best[b-1][i] + lengths[j-1] * rows(i..j).
    """
    n = len(lengths)
    if not n:
        return []
    below = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (below[j] - below[:j])
            cut[j] = int(np.argmin(cost))
            now[j] = cost[cut[j]]
        best = now
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(set(out))


def pack(df: DataFrame, length: str, buckets: int = 16, budget: int = 65_536, order: list[str] | None = None, rows_per_chunk: int = 20_000) -> DataFrame:
    """`df` with `bucket`, `bucket_length` (what its rows are padded to), `batch` (number over all buckets), `place` (row in
    the batch, from 0), and `padding`.

    Boundaries come from dynamic programming over the histogram of all lengths. A batch holds as many rows as fit `budget`
    tokens at the bucket's length; a row longer than the budget is a batch of its own, whole. Rows are dealt inside a bucket by
    a hash of the `order` columns (all columns if not given), so batches are mixed and repeatable; a bucket of any size is
    numbered in chunks. Null lengths count as 0; rows of length 0 are packed like others. An empty table gives an empty result.
    Existing columns of the result's names are replaced.
    """
    added = ("bucket", "bucket_length", "batch", "place", "padding")
    carried = [c for c in df.columns if c not in added]
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    of = {c: f"c{i}" for i, c in enumerate(carried)}
    size = F.greatest(F.coalesce(F.col(of[length]).cast("long"), F.lit(0)), F.lit(0))
    inner = shared_table(inner.withColumn("size", size), "pack-rows")
    classes = inner.groupBy(length_class(F.col("size")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("top")).orderBy("top").collect()  # bounded by the number of classes
    tops, counts = np.array([r["top"] for r in classes], np.int64), np.array([r["n"] for r in classes], np.int64)
    bounds = optimal_boundaries(tops, counts, buckets)
    rows = [int(counts[(tops <= b) & (tops > (bounds[i - 1] if i else -1))].sum()) for i, b in enumerate(bounds)]
    capacity = [max(1, budget // max(b, 1)) for b in bounds]
    first = np.concatenate([[0], np.cumsum([-(-r // c) for r, c in zip(rows, capacity, strict=True)])]).tolist()

    def pick(values, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for i in reversed(range(len(bounds))):
            out = F.when(F.col("size") <= bounds[i], F.lit(values[i]).cast(kind)).otherwise(out)
        return out

    tie = [F.col(of[c]) for c in (order or carried)]
    hashed = inner.withColumns({"bucket": pick(list(range(len(bounds))), "int"), "h": F.xxhash64(*tie)})
    chunks = max(1, -(-int(counts.sum()) // rows_per_chunk))
    leading = F.floor((F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))) * chunks).cast("long")
    ranked = chunked_rank(hashed, ["bucket"], leading, [F.shiftrightunsigned("h", 1), F.col("h"), *tie, F.col("size")], "rank")
    ranked = ranked.withColumns({"capacity": pick(capacity, "long"), "bucket_length": pick(bounds, "long"), "first": pick(first, "long")})
    return ranked.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], "bucket", "bucket_length", F.expr("first + rank DIV capacity").cast("long").alias("batch"),
        F.expr("rank % capacity").cast("long").alias("place"), (F.col("bucket_length") - F.col("size")).alias("padding"),
    )
