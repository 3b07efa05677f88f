"""Validity rules as data: failed rules become violation rows, no row raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold. A rule over a null value counts as held, like an absent optional field."""
    checks = [F.when(~F.coalesce(holds, F.lit(True)), F.lit(name)) for name, holds in rules.items()]
    return F.array_compact(F.array(*checks))


def violations(rows: DataFrame, keep: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    return rows.select(*keep, F.explode(failed_rules(rules)).alias("rule"))


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("failed", failed_rules(rules))
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)
