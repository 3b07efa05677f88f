"""Merkle manifest of a table with a witness for every row, built by aligned appends.

Digests are appended to an open tree from left to right. A node of an open run carries a partial witness: what stands left
of it is known when it is appended, and every later sibling extends what stands right of it. When a run is full, or the
input ends, the run becomes one node, which is itself an append one level higher. The leaves below a node share its witness,
so an append touches at most the open run of each level.

The table is dealt to tasks in aligned blocks of `fan ** levels` consecutive leaves. The root of a block is a further append
to the tree above, built the same way, and so on until one node is left per source; the sources' roots form the last tree.
On the way back down each block takes the witness of its root and puts it behind those of its own nodes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunked_rank, shared_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WITNESS = "array<struct<left:string,right:string>>"
_ARROW_WITNESS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


@dataclass(frozen=True)
class Shape:
    """`fan` nodes make a run; a task builds `levels` levels, so a block has `fan ** levels` nodes."""

    fan: int = 16
    levels: int = 3
    rows_per_part: int = 100_000

    @property
    def block(self) -> int:
        return self.fan**self.levels

    def depth(self, n: int) -> int:
        """How many times `n` nodes are gathered until one is left."""
        depth = 0
        while n > 1:
            n, depth = -(-n // self.fan), depth + 1
        return depth


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Node:
    """A digest with its partial witness (`left`, `right`) in the run it belongs to, and the node that the run became."""

    __slots__ = ("digest", "left", "right", "above")

    def __init__(self, value: str) -> None:
        self.digest, self.left, self.right, self.above = value, "", "", None

    def witness(self) -> list[tuple[str, str]]:
        out, node = [], self
        while node.above is not None:
            out.append((node.left, node.right))
            node = node.above
        return out


class OpenTree:
    """Appends of digests; `levels` runs are open at most."""

    def __init__(self, fan: int, levels: int) -> None:
        self.fan, self.levels, self.root = fan, levels, None
        self.open: list[list[Node]] = [[] for _ in range(levels)]

    def append(self, node: Node, level: int = 0) -> None:
        if level == self.levels:
            self.root = node
            return
        run = self.open[level]
        node.left = "".join(sibling.digest for sibling in run)
        for sibling in run:
            sibling.right += node.digest
        run.append(node)
        if len(run) == self.fan:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        above = Node(digest("".join(node.digest for node in run)))
        for node in run:
            node.above = above
        self.append(above, level + 1)

    def finish(self) -> Node:
        """The last run of a level may be short, even one node."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.root


def fold(leaf: str, witness: list[tuple[str, str]]) -> str:
    """The root that `leaf` has with these siblings."""
    for left, right in witness:
        leaf = digest(left + leaf + right)
    return leaf


def field(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(F.encode(text, "utf-8")).cast("string"), F.lit(":"), text))


def row_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _built(nodes: list[str], n: int, shape: Shape) -> tuple[list[Node], Node]:
    tree = OpenTree(shape.fan, min(shape.levels, shape.depth(n)))
    appended = [Node(d) for d in nodes]
    for node in appended:
        tree.append(node)
    return appended, tree.finish()


def _block_roots(nodes: DataFrame, shape: Shape) -> DataFrame:
    """(tree, rank, digest, n) of the roots of all blocks: the appends of the tree above, which has one in `block` of the rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        n = table.column("n")[0].as_py()
        _, root = _built(table.column("digest").to_pylist(), n, shape)
        return pa.table({"tree": table.column("tree")[:1], "rank": table.column("block")[:1], "digest": pa.array([root.digest]), "n": pa.array([-(-n // shape.block)], pa.int64())})

    blocks = nodes.select("tree", "rank", "digest", "n", F.floor(F.col("rank") / shape.block).cast("long").alias("block"))
    return shared_table(blocks.groupBy("tree", "block").applyInArrow(run, "tree string, rank long, digest string, n long"), "merkle-nodes")


def _extended(nodes: DataFrame, above: DataFrame, carried: list[str], shape: Shape) -> DataFrame:
    """`nodes` with their witnesses: those inside the block, then the witness of the block's root, a row of `above`
    (tree, rank, witness, subroot, root)."""
    kept = ["tree", "rank", *carried]

    def run(table: pa.Table, over: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        appended, _ = _built(table.column("digest").to_pylist(), table.column("n")[0].as_py(), shape)
        rest = [(w["left"], w["right"]) for w in over.column("witness")[0].as_py()]
        witness = [[{"left": a, "right": b} for a, b in [*node.witness(), *rest]] for node in appended]
        out = table.select(kept)
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.repeat(over.column(name)[0], len(table)).cast(pa.string()))
        return out.append_column("witness", pa.array(witness, _ARROW_WITNESS))

    types = dict(nodes.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["subroot string", "root string", f"witness {WITNESS}"])
    blocks = nodes.withColumn("block", F.floor(F.col("rank") / shape.block).cast("long"))
    over = above.select("tree", F.col("rank").alias("block"), "witness", "subroot", "root")
    return blocks.groupBy("tree", "block").cogroup(over.groupBy("tree", "block")).applyInArrow(run, schema)


def _stages(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """The nodes of every stage, the last with one node per tree."""
    stages = [nodes]
    while stages[-1].where("n > 1").limit(1).count():
        stages.append(_block_roots(stages[-1], shape))
    return stages


def _placed(rows: DataFrame, order: list[str], shape: Shape, name: str) -> DataFrame:
    """`rows` with `rank` in their tree along `order`, and `n`, the tree's number of rows. Ranges are cut by Spark from
    samples of (tree, order), so a tree of any size is dealt to many tasks; ranks are exact."""
    parts = max(1, -(-rows.count() // shape.rows_per_part))
    ranged = shared_table(rows.repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    ranked = chunked_rank(ranged, ["tree"], F.col("part"), [F.col(c) for c in order], "rank").drop("part")
    sizes = ranged.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return shared_table(ranked.join(sizes, "tree"), f"{name}-ranked")


def witnesses(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", carried: list[str] | None = None, shape: Shape = Shape()) -> DataFrame:
    """Every row of `leaves` with `subroot` (of its group), `root` and `witness`, a list of (left, right) siblings from the
    leaf up; only `order`, `group`, `leaf` and the `carried` columns are kept.

    Leaves ascend by `order`, nulls first, rows that repeat it by their digest; groups ascend by their UTF-8 bytes, null
    first. A group of one leaf has that leaf as its root, with no siblings. Rows that are equal are leaves of their own. An
    empty table gives no rows.
    """
    carried = carried or []
    inner = leaves.select(
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit("")).alias("tree"), F.col(f"`{order}`").alias("id"), F.col(f"`{leaf}`").alias("digest"),
        F.struct(F.col(f"`{group}`").alias("g"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]).alias("kept"),
    )
    inner = shared_table(inner, "merkle-leaves")
    stages = _stages(_placed(inner, ["id", "digest"], shape, "merkle"), shape)
    subroots = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest")
    tops = _stages(_placed(subroots, ["id"], shape, "merkle-groups"), shape)
    top = tops[-1].select("tree", "rank", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(WITNESS).alias("witness"))
    above = top
    for number, nodes in enumerate(reversed(tops[:-1])):
        last = number == len(tops) - 2
        above = shared_table(_extended(nodes, above, ["id", "digest"] if last else [], shape), "merkle-witnesses")
    if len(tops) == 1:
        above = top.join(tops[0].select("tree", "rank", "id", "digest"), ["tree", "rank"])
    above = above.select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("rank"), F.col("digest").alias("subroot"), "root", "witness")
    for nodes in reversed(stages[1:-1]):
        above = shared_table(_extended(nodes, above, [], shape), "merkle-witnesses")
    columns = [F.col("id").alias(order), F.col("kept.g").alias(group), F.col("digest").alias(leaf), *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carried)]]
    if len(stages) == 1:  # every group is one leaf
        found = stages[0].join(above.drop("rank"), "tree")
    else:
        found = _extended(stages[0], above, ["id", "digest", "kept"], shape)
    return found.select(*columns, "rank", "subroot", "root", "witness")


def folded(leaf: Column, witness: Column) -> Column:
    """The root that `leaf` has with the siblings in `witness`."""
    return F.aggregate(witness, leaf, lambda acc, w: F.sha2(F.concat(w["left"], acc, w["right"]), 256))


def proof_digest(witness: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(witness, lambda w: F.concat(w["left"], w["right"]))), 256)
