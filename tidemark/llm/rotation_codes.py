"""Near-duplicate vectors with randomised-rotation binary codes.

A unit vector x is rotated by a random orthogonal matrix and stored as the signs of its coordinates, one bit each, with one
correction factor: the inner product f of x and the unit vector that the signs stand for. Two independent rotations A and B
give two such codes. For vectors x and y the signs of x under A and those of y under B, each divided by its factor, have an
inner product whose expectation over the rotations is exactly <x, y>, as the part of a sign vector that is not x points in a
uniformly random direction. Its spread follows from the factors alone, so an upper confidence bound decides from the codes
which pairs need their inner product computed in double precision. All others are rejected unseen.

Pairs meet in cells. A cell of a table is the set of the largest coordinates, with their signs, of the vector under that
table's own rotation; the depth (how many coordinates) follows the number of vectors, and the number of tables follows from
the depth so that a pair at the threshold misses all of them with at most the stated probability.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table
from tidemark.llm.components import connected_components


@dataclass(frozen=True)
class Codes:
    """A pair at `cosine` is missed with probability `miss` at most (estimated on `trials` random pairs), half of it by the
    cells; a pair is rejected by its codes where the estimate lies `deviations` of its own standard deviations below `cosine`.
    Cells hold about `crowd` vectors at most if vectors are spread evenly; more than `block` in a cell are compared in blocks."""

    cosine: float = 0.95
    miss: float = 2e-4
    deviations: float = 5.0
    crowd: int = 4096
    block: int = 2048
    trials: int = 20_000
    seed: int = 20

    @property
    def slack(self) -> float:
        return math.sqrt(max(0.0, 1 - self.cosine**2))


def rotation(dims: int, seed: int) -> np.ndarray:
    """A uniformly random orthogonal matrix; the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).normal(size=(dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class Space:
    """Rotations and cells for vectors of `dims` coordinates; made once in each process (`space_of`)."""

    def __init__(self, dims: int, depth: int, tables: int, cfg: Codes) -> None:
        self.dims, self.depth, self.tables, self.cfg = dims, min(depth, dims), tables, cfg
        self.a, self.b = rotation(dims, cfg.seed), rotation(dims, cfg.seed + 1)
        self.bridge = (self.a.T @ self.b).astype(np.float32)  # from coordinates under A to those under B
        self.cells_of = [rotation(dims, cfg.seed + 2 + t) for t in range(tables)]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """One cell number per row and table."""
        unit, out = unit.astype(np.float32), np.empty((len(unit), self.tables), np.int64)
        for t, matrix in enumerate(self.cells_of):
            turned = unit @ matrix
            top = np.argpartition(-np.abs(turned), self.depth - 1, axis=1)[:, : self.depth]
            digit = np.sort(2 * top + (np.take_along_axis(turned, top, 1) < 0), axis=1).astype(np.int64)
            key = np.full(len(unit), t, np.int64)
            for j in range(self.depth):
                key = key * (2 * self.dims) + digit[:, j]
            out[:, t] = key
        return out

    def codes(self, unit: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Signs (packed bits) and correction factors under A and B."""
        bits, factors = [], []
        for matrix in (self.a, self.b):
            turned = unit.astype(np.float32) @ matrix
            bits.append(np.packbits(turned >= 0, axis=1))
            factors.append(np.abs(turned).sum(axis=1) / np.float32(math.sqrt(self.dims)))
        return bits, factors

    def signs(self, bits: np.ndarray) -> np.ndarray:
        return (np.unpackbits(bits, axis=1, count=self.dims).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(self.dims))


@cache
def space_of(dims: int, depth: int, tables: int, cfg: Codes) -> Space:
    return Space(dims, depth, tables, cfg)


class Coded:
    """Codes of some rows, ready to be compared."""

    def __init__(self, space: Space, bits: list[np.ndarray], factors: list[np.ndarray]) -> None:
        self.space = space
        a, b = space.signs(bits[0]), space.signs(bits[1])
        self.a, self.b = (a / factors[0][:, None]) @ space.bridge, b / factors[1][:, None]
        self.ta, self.tb = (1 / f.astype(np.float32) ** 2 - 1 for f in factors)

    def estimates(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Unbiased estimates of the inner products."""
        return (self.a[rows] @ self.b[others].T + self.b[rows] @ self.a[others].T) / 2

    def spread(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Standard deviation of the estimates for pairs that reach the threshold. Each code adds an error with variance
        t/(D-1), t = 1/f^2 - 1, times the squared sine between the vectors, and their product adds another; the two estimates of
        a pair are independent and are averaged."""
        slack, free = self.space.cfg.slack, max(1, self.space.dims - 1)

        def variance(t: np.ndarray, u: np.ndarray) -> np.ndarray:
            return (np.float32(slack**2) * (t[:, None] + u[None, :]) + t[:, None] * u[None, :]) / np.float32(free)

        return np.sqrt(variance(self.ta[rows], self.tb[others]) + variance(self.tb[rows], self.ta[others])) / 2

    def may_link(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which pairs have an upper bound that reaches the threshold."""
        cfg = self.space.cfg
        return self.estimates(rows, others) + np.float32(cfg.deviations) * self.spread(rows, others) + np.float32(1e-4) >= cfg.cosine

    def open_pairs(self, side: np.ndarray, crossing: bool, strip: int = 512):
        """(x, y) of the pairs that the codes leave open, each once: those across the two sides, or all of one side."""
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for b in range(0, len(left), strip):
            rows, others = left[b : b + strip], right if crossing else left[b:]
            i, j = np.nonzero(self.may_link(rows, others))
            x, y = rows[i], others[j]
            yield (x, y) if crossing else (x[x < y], y[x < y])


def planned(dims: int, rows: int, cfg: Codes) -> tuple[int, int]:
    """(depth, tables): the least depth at which evenly spread cells hold `crowd` rows, and the tables that it needs. How often
    a pair at the threshold shares a cell is measured on random pairs."""
    if dims == 1:
        return 1, 1
    depth, cells = 1, 2 * dims
    while rows / cells > cfg.crowd and depth < min(dims, 4):
        depth += 1
        cells = math.comb(dims, depth) * 2**depth
    draw = np.random.default_rng(cfg.seed)
    x, g = draw.normal(size=(2, cfg.trials, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g -= (g * x).sum(axis=1)[:, None] * x
    y = cfg.cosine * x + cfg.slack * g / np.maximum(np.linalg.norm(g, axis=1), 1e-12)[:, None]
    space = Space(dims, depth, 4, cfg)
    shared = 0.97 * float((space.cells(x) == space.cells(y)).mean())
    return depth, max(1, math.ceil(math.log(cfg.miss / 2) / math.log(1 - max(shared, 1e-6))))


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    flat = flat / np.abs(flat).max(axis=1)[:, None]  # large and small numbers don't leave the range of squares
    return flat / np.linalg.norm(flat, axis=1)[:, None]


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _crowding(plan: tuple):
    """(cell, n) of every batch."""

    def run(batches):
        space = space_of(*plan)
        for batch in batches:
            if len(batch):
                cells, counts = np.unique(space.cells(_unit(batch.column(0), space.dims)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts.astype(np.int64))], names=["cell", "n"])

    return run


def _encode(plan: tuple):
    """One row per vector and table: its cell and its codes."""

    def run(batches):
        space = space_of(*plan)
        for batch in batches:
            if not len(batch):
                continue
            unit = _unit(batch.column(1), space.dims)
            bits, factors = space.codes(unit)
            codes = [*map(_packed, bits), *map(pa.array, factors)]
            cells = space.cells(unit)
            for t in range(space.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cells[:, t])), batch.column(0), *codes], names=["cell", "row", "a", "b", "fa", "fb"])

    return run


def _in_blocks(rows: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """`rows` (cell, row, ...) with the block pair (x, y) they take part in and their `side`: a cell of up to `block` rows is
    one pair; in a larger one every two blocks meet once, and rows are repeated once per block of their cell."""
    large = counts.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = rows.join(shared_table(large, "vector-crowds"), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", "blocks")


def _groups(batches):
    """Tables of equal (cell, x, y), of two rows or more, from sorted batches; a group may go on in the next batch."""
    kept: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
        edges = np.flatnonzero(np.any([np.diff(table.column(c).to_numpy()) != 0 for c in ("cell", "x", "y")], axis=0)) + 1
        starts = [0, *edges.tolist()]
        for b, e in itertools.pairwise(starts):
            if e - b > 1:
                yield table.slice(b, e - b).combine_chunks()
        kept = table.slice(starts[-1])
    if kept is not None and len(kept) > 1:
        yield kept.combine_chunks()


def _sides(group: pa.Table) -> tuple[np.ndarray, bool]:
    """The block of each row, and whether two blocks meet here (one of them may have no rows)."""
    return group.column("side").to_numpy(), group.column("x")[0].as_py() != group.column("y")[0].as_py()


def _candidates(plan: tuple):
    """(cell, row) of rows that have a partner in their cell which the codes do not reject."""

    def run(batches):
        space = space_of(*plan)
        for group in _groups(batches):
            coded = Coded(space, [_unpacked(group.column(c)) for c in ("a", "b")], [group.column(c).to_numpy() for c in ("fa", "fb")])
            found = np.zeros(len(group), bool)
            for x, y in coded.open_pairs(*_sides(group)):
                found[x] = found[y] = True
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(group.column(c).to_numpy()[found]) for c in ("cell", "row")], names=["cell", "row"])

    return run


def least_reachable(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 reaches over the links (x, y)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _confirmed(plan: tuple, step: int = 100_000):
    """Exact inner products of the pairs that the codes leave open, each in the first cell that both rows share: per row the
    number of linked vectors, and links that span what is linked here."""

    def run(batches):
        space = space_of(*plan)
        for group in _groups(batches):
            unit = _unit(group.column("vector").combine_chunks(), space.dims)
            cells, here = space.cells(unit), group.column("cell")[0].as_py() // (2 * space.dims) ** space.depth
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for xs, ys in Coded(space, *space.codes(unit)).open_pairs(*_sides(group)):
                for b in range(0, len(xs), step):
                    x, y = xs[b : b + step], ys[b : b + step]
                    linked = (np.argmax(cells[x] == cells[y], axis=1) == here) & (np.einsum("ij,ij->i", unit[x], unit[y]) >= space.cfg.cosine)
                    found.append((x[linked], y[linked]))
            x, y = (np.concatenate(part) for part in zip(*found, strict=True))
            if not len(x):
                continue
            rows, copies, low = (group.column(c).to_numpy() for c in ("row", "copies", "low"))
            links = np.bincount(x, weights=copies[y], minlength=len(rows)) + np.bincount(y, weights=copies[x], minlength=len(rows))
            some, lead = np.flatnonzero(links), least_reachable(len(rows), x, y)
            yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(links[some].astype(np.int64)), pa.array(low[some]), pa.array(low[lead[some]])], names=["row", "links", "a", "b"])

    return run


def similar_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cfg: Codes = Codes()) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `vectors`; other columns are ignored.

    Rows are linked at a cosine of `cfg.cosine` or more, in double precision. Null, empty and zero vectors and those with a null
    or non-finite component link with nothing; vectors of different length do not link (each length is searched by itself).
    Copies of one vector are compared once and counted as often as they occur. Components are reachability over links, named
    by the smallest id. Rows that repeat an id count as rows and share its component; a row without an id links with nothing,
    has a null component and is kept. An empty table gives no rows.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[vector_column]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    source = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").cast(kind).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.col("id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    marked = source.select("id", F.when(sound, F.col("vector")).alias("vector"))
    grouped = marked.where("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = shared_table(grouped.select(F.monotonically_increasing_id().alias("row"), "low", "copies", F.size("vector").alias("dims"), "vector"), "vector-classes")
    links = spark.createDataFrame([], "row long, links long, a long, b long")
    order = ["cell", "x", "y", "row"]
    for dims, rows in sorted((r["dims"], r["n"]) for r in classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row per length of vectors
        plan = (dims, *planned(dims, rows, cfg), cfg)
        own = classes.where(F.col("dims") == dims)
        counts = own.select("vector").mapInArrow(_crowding(plan), "cell long, n long")
        coded = own.select("row", "vector").mapInArrow(_encode(plan), "cell long, row long, a binary, b binary, fa float, fb float")
        met = _in_blocks(coded, counts, cfg.block).repartition("cell", "x", "y").sortWithinPartitions(*order)
        near = shared_table(met.mapInArrow(_candidates(plan), "cell long, row long").distinct(), "vector-candidates")
        placed = _in_blocks(near, near.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), cfg.block)
        exact = placed.join(own.select("row", "low", "copies", "vector"), "row").repartition("cell", "x", "y").sortWithinPartitions(*order)
        links = links.unionByName(shared_table(exact.mapInArrow(_confirmed(plan), "row long, links long, a long, b long"), "vector-links"))
    counted = links.groupBy("row").agg(F.sum("links").alias("links"))
    linked = classes.join(counted, "row", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).where("n_links > 0")
    linked = linked.select(F.col("vector").alias("same"), F.xxhash64("vector").alias("h"), "low", "n_links")
    hashed = marked.withColumn("h", F.xxhash64("vector"))
    members = shared_table(hashed.join(linked, (hashed["h"] == linked["h"]) & (F.col("vector") == F.col("same")), "left").select("id", "low", F.coalesce("n_links", F.lit(0)).alias("n_links")), "vector-members")
    edges = links.select("a", "b").where("a != b").unionByName(members.where("id != low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    components = connected_components(shared_table(edges.distinct(), "vector-edges"))
    result = members.join(components, members["id"] == components["node"], "left")
    component = F.coalesce("component", "id")
    return result.select(F.col("id").alias(id_column), "n_links", component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
