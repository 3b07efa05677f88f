"""Connected components of large link tables, and spanning links inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Smallest reachable node for every node of `links`: (node, component). Links are undirected; self links give single nodes.

    Alternating large-star and small-star rounds: every round moves neighbours to the smallest one, pre-aggregated per
    task, and takes about log(n) rounds. A star of any size costs one row per neighbour; links, nodes and labels never
    come to the driver, only two numbers that tell whether a round changed anything.
    """
    nodes = shared_table(links.select(F.explode(F.array(left, right)).alias("node")).distinct(), "component-nodes")
    edges = shared_table(links.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "component-links")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = shared_table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "component-low")  # read anew, so that Spark can split a hub's rows
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_table(large, "component-large")
        small = shared_table(large.groupBy("u").agg(F.min("v").alias("m")), "component-small")
        moved = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = shared_table(moved.where("u != v").distinct(), "component-links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == (now["n"], now["s"]):
            break
        before = (now["n"], now["s"])
    labels = edges.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(labels.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


class Union:
    """Disjoint sets of 0..n-1; the smaller number leads."""

    def __init__(self, n: int) -> None:
        self.lead = np.arange(n)

    def find(self, i: int) -> int:
        while self.lead[i] != i:
            self.lead[i] = self.lead[self.lead[i]]
            i = self.lead[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.lead[max(a, b)] = min(a, b)
        return True
