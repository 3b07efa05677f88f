"""Scans over composable steps, for all pieces of an Arrow batch at once.

A recording is cut into pieces of consecutive rows. Spark sorts rows by piece, and a task advances every piece of a batch by
one position per array step, so ten thousand short recordings cost as few steps as one. Pieces become single steps of the
level above, until a recording is one piece; the state before a piece then comes down the same levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.chunked import index_chunk, join_same
from tidemark.session import cut_lineage


def changes(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Rows (but the first) that differ from the one before in some column; null equals null."""
    out = np.zeros(max(len(table) - 1, 0), bool)
    for name in columns:
        column = table.column(name).combine_chunks()
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            out |= np.array([a != b for a, b in zip(values[1:], values[:-1], strict=True)], bool)
        else:
            out |= np.diff(column.dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0
    return out


def whole_pieces(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole pieces from sorted batches, with the first row of each piece and the end; a piece may span batches."""
    kept: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
        starts = np.concatenate([[0], np.flatnonzero(changes(table, columns)) + 1])
        kept = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
    if kept is not None:
        yield kept, np.array([0, len(kept)])


class Ladder:
    """Positions of pieces, advanced together: `at(p)` gives the rows at position p and which pieces, the longest first, still
    have one. With `backward` the last row of a piece is at position 0."""

    def __init__(self, starts: np.ndarray, backward: bool = False) -> None:
        sizes = np.diff(starts)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes, self.backward = sizes[self.order], backward
        self.base = starts[1:][self.order] - 1 if backward else starts[:-1][self.order]
        self.steps = int(self.sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-self.sizes, -np.arange(self.steps), "left")

    def at(self, p: int) -> np.ndarray:
        rows = self.base[: self.active[p]]
        return rows - p if self.backward else rows + p

    def by_piece(self, values: np.ndarray) -> np.ndarray:
        """Values in the order of the pieces' rows."""
        out = np.empty_like(values)
        out[self.order] = values
        return out


def fold_pieces(steps: np.ndarray, starts: np.ndarray, compose: Callable, backward: bool = False) -> np.ndarray:
    """All steps of each piece as one."""
    ladder = Ladder(starts, backward)
    total = steps[ladder.at(0)].copy()
    for p in range(1, ladder.steps):
        rows = ladder.at(p)
        total[: len(rows)] = compose(total[: len(rows)], steps[rows])
    return ladder.by_piece(total)


def spread_pieces(steps: np.ndarray, starts: np.ndarray, state: np.ndarray, apply: Callable, backward: bool = False) -> np.ndarray:
    """The state before every row; `state` is the one before each piece."""
    ladder = Ladder(starts, backward)
    now, out = state[ladder.order].copy(), np.empty((len(steps), state.shape[1]), state.dtype)
    for p in range(ladder.steps):
        rows = ladder.at(p)
        out[rows] = now[: len(rows)]
        now[: len(rows)] = apply(now[: len(rows)], steps[rows])
    return out


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """An array column of equally long rows of whole numbers."""
    flat = table.column(column).combine_chunks().flatten().to_numpy()
    return flat.reshape(len(table), -1)


def lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values, np.int64).ravel()))


def by_piece(df: DataFrame, piece: Sequence[str], order: Sequence[str], schema: str, work: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """Run `work(rows of whole pieces, starts)` over `df`, whose pieces are rows with equal `piece` columns along `order`."""
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for table, starts in whole_pieces(batches, piece):
            yield from work(table, starts).cast(fields).to_batches()

    return df.repartition(*[F.col(c) for c in piece]).sortWithinPartitions(*piece, *order).mapInArrow(run, schema)


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def scan_steps(
    elements: DataFrame, keys: Sequence[str], last: int, compose: Callable, apply: Callable, start: DataFrame, *, fan: int = 1024, backward: bool = False
) -> DataFrame:
    """(keys, seq, state): the state before every element of an ordered list of composable steps.

    `elements` has `keys`, `seq` (whole numbers from 0) and `step array<bigint>`; `last` is the largest `seq` of all;
    `compose(a, b)` is the step "a, then b" and `apply(states, steps)` moves states over steps, both for arrays of them at
    once; `start` has `keys` and `state array<bigint>`. No piece has more than `fan` rows, at any level.
    """
    names, levels, width = key_schema(elements, keys), [elements.select(*keys, F.col("seq").cast("long").alias("seq"), "step")], last

    def above(level: DataFrame) -> DataFrame:
        return level.withColumn("piece", index_chunk("seq", fan))

    def fold(table: pa.Table, starts: np.ndarray) -> pa.Table:
        heads = table.take(pa.array(starts[:-1]))
        return heads.select([*keys, "piece"]).rename_columns([*keys, "seq"]).append_column("step", lists(fold_pieces(numbers(table, "step"), starts, compose, backward)))

    def spread(table: pa.Table, starts: np.ndarray) -> pa.Table:
        before = numbers(table.take(pa.array(starts[:-1])), "state")
        return table.select([*keys, "seq"]).append_column("state", lists(spread_pieces(numbers(table, "step"), starts, before, apply, backward)))

    while width > 0:
        levels.append(cut_lineage(by_piece(above(levels[-1]), [*keys, "piece"], ["seq"], f"{names}, seq long, step array<bigint>", fold)))
        width //= fan
    states = join_same(levels[-1].select(*keys, "seq"), start, keys)
    for level in reversed(levels[:-1]):
        down = join_same(above(level), states.withColumnRenamed("seq", "piece"), [*keys, "piece"])
        states = by_piece(down, [*keys, "piece"], ["seq"], f"{names}, seq long, state array<bigint>", spread)
    return states


def cheapest_path(rows: DataFrame, keys: Sequence[str], cost: Sequence[Column], penalty: np.ndarray, *, idx: str = "idx", size: int = 512, fan: int = 1024) -> DataFrame:
    """(keys, idx, choice): the cheapest choice of a state for every row, in whole numbers.

    `cost` are the costs of the states of a row, `penalty[a, b]` that of going from a to b. Of equally cheap states the first
    is taken. A piece of `size` rows is a matrix of path costs (entered in a, left in b); matrices compose, so every piece gets
    the costs it is entered with; from the last piece back it gets the state it ends in; then it walks its own rows.
    """
    n = len(penalty)
    names = key_schema(rows, keys)
    slim = cut_lineage(rows.select(*keys, F.col(idx).cast("long").alias("idx"), F.array(*cost).alias("cost"), index_chunk(idx, size).alias("seq")))
    last = slim.agg(F.max("seq")).first()[0] or 0
    piece = [*keys, "seq"]

    def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.reshape(-1, n, n, 1) + b.reshape(-1, 1, n, n)).min(axis=2).reshape(len(a), -1)

    def entered(states: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return (states[:, :, None] + steps.reshape(-1, n, n)).min(axis=1)

    def moves(table: pa.Table) -> np.ndarray:
        """The step of every row: its costs, and the penalty but for the first row of a recording."""
        first = table.column("idx").to_numpy() == 0
        return np.where(first[:, None, None], 0, penalty[None]) + numbers(table, "cost")[:, None, :]

    def matrix(table: pa.Table, starts: np.ndarray) -> pa.Table:
        whole = fold_pieces(moves(table).reshape(len(table), -1), starts, min_plus)
        return table.take(pa.array(starts[:-1])).select(piece).append_column("step", lists(whole))

    def walked(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best state before each row for every state at it, and the costs behind each piece."""
        steps, ladder = moves(table), Ladder(starts)
        now, back = numbers(table.take(pa.array(starts[:-1])), "state")[ladder.order], np.empty((len(table), n), np.int64)
        for p in range(ladder.steps):
            at = ladder.at(p)
            options = now[: len(at), :, None] + steps[at]
            back[at], now[: len(at)] = options.argmin(axis=1), options.min(axis=1)
        return back, ladder.by_piece(now)

    def origins(table: pa.Table, starts: np.ndarray) -> pa.Table:
        back, final = walked(table, starts)
        out = table.take(pa.array(starts[:-1])).select(piece)
        return out.append_column("step", lists(fold_pieces(back, starts, follow, backward=True))).append_column("cheapest", pa.array(final.argmin(axis=1)))

    def follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The step "back over a, then back over b", or states a moved back over b."""
        return np.take_along_axis(b, a, axis=1)

    def path(table: pa.Table, starts: np.ndarray) -> pa.Table:
        back, _ = walked(table, starts)
        ends = numbers(table.take(pa.array(starts[:-1])), "behind")
        return table.select([*keys, "idx"]).append_column("choice", pa.array(spread_pieces(back, starts, ends, follow, backward=True)[:, 0]))

    matrices = by_piece(slim, piece, ["idx"], f"{names}, seq long, step array<bigint>", matrix)
    zero = slim.select(*keys).distinct().select(*keys, F.array(*[F.lit(0).cast("long")] * n).alias("state"))
    entries = scan_steps(cut_lineage(matrices), keys, last, min_plus, entered, zero, fan=fan)
    ready = cut_lineage(join_same(slim, entries, piece))
    ended = cut_lineage(by_piece(ready, piece, ["idx"], f"{names}, seq long, step array<bigint>, cheapest long", origins))
    final = ended.groupBy(*keys).agg(F.array(F.max_by("cheapest", "seq")).alias("state"))
    behind = scan_steps(ended, keys, last, follow, follow, final, fan=fan, backward=True).withColumnRenamed("state", "behind")
    return by_piece(join_same(ready, behind, piece), piece, ["idx"], f"{names}, idx long, choice long", path)
