"""Order statistics of groups against plain sorting."""

import random
import statistics

from pyspark.sql import functions as F

from tidemark.operators import orderstats as od
from tidemark.operators import timeline as tl


def table(spark):
    rnd = random.Random(4)
    rows = [(k, n, rnd.choice([None, *[rnd.randint(0, 9) / 10.0] * 3, rnd.random() * 100 - 50, 1e-300, -1e300]), rnd.randint(0, 3)) for k, n, size in [(None, 1, 40), ("a", 1, 500), ("a", None, 7), ("b", 2, 1), ("c", 2, 2)] for _ in range(size)]
    rows += [("empty", 1, None, 0)] * 3
    return rows, spark.createDataFrame(rows, "k string, n int, x double, y int").repartition(7)


def test_medians_equal_plain_ones(spark):
    rows, df = table(spark)
    got = {(r["k"], r["n"]): (r["x"], r["y"]) for r in od.medians(df, ["k", "n"], ["x", "y"]).collect()}
    for key in {r[:2] for r in rows}:
        x, y = [r[2] for r in rows if r[:2] == key and r[2] is not None], [r[3] for r in rows if r[:2] == key]
        assert got[key] == ((sum(sorted(x)[(len(x) - 1) // 2 : len(x) // 2 + 1]) / (1 if len(x) % 2 else 2)) if x else None, statistics.median(y))


def test_one_group_lies_in_many_ranges(spark):
    df = spark.range(3000).select(F.lit(1).alias("k"), (F.col("id") % 1500).alias("v"))
    ranked = od.ranked_values(df, ["k"], "v").collect()
    assert len(ranked) == 1500 and all(r["stat_before"] == 2 * r["stat_value"] and r["stat_count"] == 2 and r["stat_total"] == 3000 for r in ranked)


def test_robust_confidence_equals_the_definition(spark):
    rnd = random.Random(9)
    rows = [(k, rnd.choice([0.1, 0.5, 0.9, rnd.random()])) for k, n in ((None, 25), (1, 1), (2, 2), (3, 11), (4, 300)) for _ in range(n)]
    got = {r["k"]: r["robust_confidence"] for r in tl.robust_confidence(spark.createDataFrame(rows, "k int, confidence double"), ["k"]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted(v for key, v in rows if key == k)
        kept = own[len(own) // 10 : len(own) - len(own) // 10]
        assert abs(got[k] - min(1, max(0, 0.6 * statistics.median(kept) + 0.4 * statistics.fmean(kept)))) < 1e-12
