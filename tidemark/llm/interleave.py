"""Shards that all have the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunked_rank, shared_table


def interleaved_shards(df: DataFrame, shards: int, id_column: str = "doc_id", stratum: str = "source", seed: int = 7, rows_per_chunk: int = 20_000) -> DataFrame:
    """`df` with `shard` (0 to shards-1) and `slot` (place in the shard, gapless from 0).

    Rows are shuffled inside their stratum by a seeded hash and ranked; row r of n has the fraction (r + 0.5) / n. Sorted by
    fraction every stretch has the strata in proportion, so cutting the order into equal stretches gives shards whose sizes
    are at most one row apart and whose mixtures match to a few rows per stratum.

    All columns are carried. A null stratum is a stratum of its own; null ids and rows that repeat keep their places, ordered by
    all columns, so that equal rows are interchangeable. An empty table gives an empty result. Existing columns `shard` and
    `slot` are replaced. A stratum of any size is ranked in chunks of about `rows_per_chunk` rows: a range of the hash at
    first, then a range of the fraction; only sizes of chunks are summed along the order.
    """
    carried = [c for c in df.columns if c not in ("shard", "slot")]
    inner = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    at = {c: f"c{i}" for i, c in enumerate(carried)}
    rest = [F.col(c) for c in inner.columns]
    hashed = inner.withColumns({"stratum": F.col(at[stratum]) if stratum in at else F.lit(None).cast("string"), "h": F.xxhash64(F.lit(seed), F.col(at[id_column]), *rest)})
    sizes = shared_table(hashed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), "interleave-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    chunks = max(1, -(-total // rows_per_chunk))
    # The hash is spread evenly over 64 bits: its leading bits cut a stratum into even, ordered chunks.
    leading = F.floor((F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))) * chunks).cast("long")
    order_of_hash = F.shiftrightunsigned("h", 1)
    ranked = chunked_rank(hashed, ["stratum"], leading, [order_of_hash, F.col("h"), *rest], "rank")
    spread = sizes.select(F.col("stratum").alias("s"), "n")
    fraction = ranked.join(spread, F.col("stratum").eqNullSafe(F.col("s"))).withColumn("fraction", (F.col("rank") + 0.5) / F.col("n")).drop("s", "n")
    placed = chunked_rank(fraction, [], F.floor(F.col("fraction") * chunks).cast("long"), [F.col("fraction"), F.col("stratum"), F.col("rank")], "place")
    # The first place of shard k is ceil(k * total / shards); whole numbers only, so that large tables stay exact.
    cut = placed.withColumn("shard", F.expr(f"CAST((place * {shards}L) DIV {max(total, 1)}L AS INT)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) DIV {shards}L")
    return cut.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], "shard", (F.col("place") - first).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; a shard is written by several tasks, each a range of slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def mixture(sharded: DataFrame, stratum: str = "source") -> DataFrame:
    """Rows and share of every stratum in every shard."""
    counts = sharded.groupBy("shard", stratum).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("shard")))
