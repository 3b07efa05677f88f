"""Exact medians and other order statistics of many groups at once.

No buffer and no window holds a group: equal values are counted first, the counts are dealt to tasks by ranges of (group,
value), and only sums per range are carried on. A group of any length is spread over as many ranges as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunked import join_same, ordered_scan
from tidemark.session import cut_lineage


def ranked_values(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The distinct values of every group with how often they occur: keys, `stat_value`, `stat_count`, `stat_before` (rows with
    smaller values) and `stat_total` (rows of the group). Null values are left out; NaN is the largest number."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("stat_value")).agg(F.count(F.lit(1)).alias("stat_count"))
    ranged = counts.repartitionByRange(*[F.col(k) for k in keys], "stat_value").withColumn("stat_part", F.spark_partition_id().cast("long"))
    ranged = cut_lineage(ranged)
    scanned = ordered_scan(ranged, keys, ["stat_value"], F.col("stat_part"), cumsum={"stat_before": F.col("stat_count")}).drop("stat_part")
    return join_same(scanned, ranged.groupBy(*keys).agg(F.sum("stat_count").alias("stat_total")), keys)


def at_rank(rank: Column) -> Column:
    """Aggregate over `ranked_values`: the value at a rank from 0."""
    return F.max(F.when((F.col("stat_before") <= rank) & (rank < F.col("stat_before") + F.col("stat_count")), F.col("stat_value")))


def medians(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys and the median of each of `values`, null where a group has none."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("stat_name"), F.col(n).cast("double").alias("stat_input")) for n in values])).alias("stat_each")
    ranked = ranked_values(rows.select(*keys, each).select(*keys, "stat_each.*"), [*keys, "stat_name"], "stat_input")
    middle = (at_rank(F.floor((F.col("stat_total") - 1) / 2)) + at_rank(F.floor(F.col("stat_total") / 2))) / 2
    found = ranked.groupBy(*keys, "stat_name").agg(middle.alias("stat_median"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("stat_name") == n, F.col("stat_median"))).alias(n) for n in values])
