"""Near-duplicate documents with an LSH forest, confirmed on full shingle sets.

A forest is several sorted orders of the same MinHash signature. Rows that share a prefix of an order form a region; a
region that is too large is taken one coordinate deeper, so dense regions are cut deep and sparse ones shallow. Inside a
region rows whose signatures agree often enough are candidates; only spanning candidates leave the task, so the output is
linear in the rows. Candidate components, a few related texts each, are then compared exactly on their full sets, in
blocks if they are large, and the links found there give the final components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, mix, shared_table, word_slices
from tidemark.llm.components import Union, connected_components


@dataclass(frozen=True)
class Forest:
    """`orders` sorted orders start at depth `depth` over orders*depth hash functions: a pair at similarity 0.8 misses all
    of them with probability (1 - 0.8**3)**24 = 3e-8. `agree` is the share of equal signature bytes that makes a candidate,
    five standard deviations below 0.8. `dense` rows make a region go deeper. `block` rows are compared in one task."""

    words: int = 4
    percent: int = 80
    orders: int = 24
    depth: int = 3
    agree: float = 0.55
    dense: int = 4096
    block: int = 1024
    block_shingles: int = 2_000_000

    @property
    def hashes(self) -> int:
        return self.orders * self.depth


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted; fewer than `k` words make one shingle of the whole sequence."""
    at, hashes = words.grams(k)
    rows = words.doc[at]
    counts = words.count()
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            first = words.first[short]
            total = np.zeros(len(short), np.uint64)
            for j in range(n):
                total = total * np.uint64(0x9E3779B97F4A7C15) + words.hashes[first + j]
            rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, mix(total + np.uint64(n))])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _signatures(cfg: Forest):
    seeds = mix(np.arange(1, cfg.hashes + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for at, end, words in word_slices(batch, 1, lower=True):
                n = end - at
                rows, hashes = shingle_sets(words, cfg.words)
                counts = np.bincount(rows, minlength=n)
                some = np.flatnonzero(counts)
                low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                signature = np.zeros((n, cfg.hashes), np.uint32)
                if len(rows):
                    begin = np.searchsorted(rows, some)
                    low[some] = np.add.reduceat(hashes, begin)
                    high[some] = np.bitwise_xor.reduceat(mix(hashes), begin)
                    for j, seed in enumerate(seeds):
                        signature[some, j] = np.minimum.reduceat(((hashes * seed) >> np.uint64(32)).astype(np.uint32), begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(counts, pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * cfg.hashes), n, [None, pa.py_buffer(signature.tobytes())]).cast(pa.binary())],
                    names=["id", "n", "low", "high", "signature"],
                )

    return run


def _orders(cfg: Forest):
    """One row per document and order: the hash of the first `depth` coordinates, and one byte of every coordinate, rotated."""

    def run(batches):
        for batch in batches:
            signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(batch), cfg.hashes)
            small = mix(signature.astype(np.uint64) + np.uint64(1)).astype(np.uint8)
            for t in range(cfg.orders):
                key = np.full(len(batch), t + 1, np.uint64)
                for j in range(cfg.depth):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, t * cfg.depth + j])
                rotated = np.ascontiguousarray(np.roll(small, -(t + 1) * cfg.depth, axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(cfg.hashes), len(batch), [None, pa.py_buffer(rotated.tobytes())]).cast(pa.binary())],
                    names=["region", "id", "rest"],
                )

    return run


def spanning_candidates(rest: np.ndarray, cfg: Forest, sets: Union, rows: np.ndarray, depth: int = 0) -> None:
    """Join rows of one region whose signatures agree in at least `agree` of the bytes; too large a region goes one coordinate deeper."""
    if len(rows) > cfg.dense and depth < rest.shape[1]:
        order = rows[np.argsort(rest[rows, depth], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(rest[order, depth])) + 1):
            if len(part) > 1:
                spanning_candidates(rest, cfg, sets, part, depth + 1)
        return
    if depth == rest.shape[1]:  # equal in every byte
        for j in rows[1:]:
            sets.join(rows[0], j)
        return
    least = cfg.agree * rest.shape[1]
    todo = rows
    while len(todo) > 1:  # from each row to the rows that no earlier one has reached; reached rows go on from there
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            i = queue.pop()
            near = (rest[todo] == rest[i]).sum(axis=1) >= least
            for j in todo[near]:
                sets.join(i, j)
            queue.extend(todo[near])
            todo = todo[~near]


def _regions(cfg: Forest):
    """Rows sorted by region: spanning candidate links of every region. A region that goes on in the next batch is kept;
    beyond 4 x `dense` rows only its last `dense` rows are, so that neighbours in the order still meet."""

    def links(region, ids, rest):
        edges = np.flatnonzero(np.diff(region)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(region)]])
        sets = Union(len(region))
        for b, e in zip(starts, ends):
            if e - b == 2:
                if (rest[b] == rest[b + 1]).sum() >= cfg.agree * rest.shape[1]:
                    sets.join(b, b + 1)
            elif e - b > 2:
                spanning_candidates(rest, cfg, sets, np.arange(b, e))
        joined = np.flatnonzero(sets.lead != np.arange(len(region)))
        return ids[joined], ids[np.array([sets.find(i) for i in joined], np.int64)]

    def run(batches):
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            region = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            rest = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), cfg.hashes)
            if kept is not None:
                region, ids, rest = np.concatenate([kept[0], region]), np.concatenate([kept[1], ids]), np.concatenate([kept[2], rest])
            begin = int(np.searchsorted(region, region[-1]))
            if len(region) - begin > 4 * cfg.dense:
                a, b = links(region, ids, rest)
                kept = (region[-cfg.dense :], ids[-cfg.dense :], rest[-cfg.dense :])
            else:
                a, b = links(region[:begin], ids[:begin], rest[:begin]) if begin else (ids[:0], ids[:0])
                kept = (region[begin:], ids[begin:], rest[begin:])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if kept is not None:
            a, b = links(*kept)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def linked_pairs(rows: np.ndarray, hashes: np.ndarray, side: np.ndarray, percent: int, both: bool) -> list[tuple[int, int]]:
    """Spanning exact links between sets given as sorted (row, hash). With `both`, only pairs across the two sides are
    looked at (each side has a comparison of its own). Every pair is compared or already connected."""
    n = len(side)
    sizes = np.bincount(rows, minlength=n)
    _, code = np.unique(hashes, return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.zeros(code.max() + 1 if len(code) else 1, bool)
    found, open_rows = [], np.flatnonzero(sizes)
    sums = np.zeros(len(code) + 1, np.int64)
    while len(open_rows):
        queue, open_rows = [open_rows[0]], open_rows[1:]
        while queue and len(open_rows):
            i = queue.pop()
            mine = code[start[i] : start[i + 1]]
            flags[mine] = True
            fits = (100 * np.minimum(sizes[open_rows], sizes[i]) >= percent * np.maximum(sizes[open_rows], sizes[i])) & (not both or side[open_rows] != side[i])
            near = np.zeros(len(open_rows), bool)
            some = open_rows[fits]
            if len(some) > 32:
                np.cumsum(flags[code], out=sums[1:])
                shared = sums[start[some + 1]] - sums[start[some]]
            else:
                shared = np.array([int(flags[code[start[j] : start[j + 1]]].sum()) for j in some], np.int64)
            flags[mine] = False
            if len(some):
                near[fits] = 100 * shared >= percent * (sizes[some] + sizes[i] - shared)
            found.extend((i, j) for j in open_rows[near])
            queue.extend(open_rows[near])
            open_rows = open_rows[~near]
    return found


def _confirm(cfg: Forest):
    def run(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        rows, hashes, base = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        for batch in table.select(["text"]).to_batches():
            for at, _, words in word_slices(batch, 0, lower=True):
                r, h = shingle_sets(words, cfg.words)
                rows.append(r + at + base)
                hashes.append(h)
            base += len(batch)
        pairs = linked_pairs(np.concatenate(rows), np.concatenate(hashes), side, cfg.percent, bool(side.any()))
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(ids[j]) for _, j in pairs], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cfg: Forest = Forest()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `docs`; other columns are ignored.

    Rows are linked if `percent` of the union of their shingle sets is shared; components are reachability over links, named
    by the smallest id. Null or empty texts have no shingles and link with nothing. Rows that repeat an id are linked like
    others and share the id; a null id gets a null component and is kept, and links nothing. All rows with the smallest id are kept.
    """
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    signed = shared_table(source.mapInArrow(_signatures(cfg), "id long, n long, low long, high long, signature binary"), "forest-signatures")
    # Equal sets first: one representative goes on, however many copies there are.
    filled = signed.where("n > 0 AND id IS NOT NULL")
    classes = shared_table(filled.groupBy("low", "high", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "forest-classes")
    keys = ["low", "high", "n"]
    copies = filled.select("id", *keys).join(classes.where("copies > 1").select(*keys, "rep"), keys).select("id", "rep")  # only groups of two and more
    reps = filled.join(classes.select(F.col("rep").alias("id"), *keys), ["id", *keys]).dropDuplicates(["id", *keys]).select("id", "signature")
    ordered = reps.mapInArrow(_orders(cfg), "region long, id long, rest binary")
    candidates = ordered.repartition("region").sortWithinPartitions("region", "rest").mapInArrow(_regions(cfg), "a long, b long")
    clusters = shared_table(connected_components(shared_table(candidates.where("a != b").distinct(), "forest-candidates")), "forest-clusters")

    # Exact comparison: texts of a cluster meet in blocks of rows; block pairs cover all pairs.
    members = clusters.join(classes.select(F.col("rep").alias("node"), "n"), "node").select(F.col("node").alias("id"), "component", "n")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    blocks = shared_table(
        sizes.select("component", F.greatest(F.ceil(F.col("rows") / cfg.block), F.ceil(F.col("shingles") / cfg.block_shingles), F.lit(1)).cast("int").alias("blocks")), "forest-blocks"
    )
    placed = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts = source.where("id IS NOT NULL").join(placed.select("id", "component", "block", "blocks").dropDuplicates(["id"]), "id")
    pairs = (
        texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "text")
    )
    links = pairs.groupBy("component", "x", "y").applyInArrow(_confirm(cfg), "a long, b long")
    everything = shared_table(links.unionByName(copies.select(F.col("id").alias("a"), F.col("rep").alias("b"))), "forest-links")
    final = connected_components(everything)
    result = signed.select("id", "n").join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return result.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))
