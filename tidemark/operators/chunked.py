"""Ordered operations over one long key without putting the key into one task.

A window partitioned by the recording id alone sends a recording to one task. Here a recording is cut into
chunks of consecutive rows; every chunk is processed on its own, and only one small summary row per chunk is
ordered across the recording (with 65,536 rows per chunk the summary is about 1/65,536 of the input). The
carried-in values are joined back on (key, chunk), so the large side is shuffled once and never by key alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.session import cut_lineage

ROWS_PER_CHUNK = 65_536


def index_chunk(position: str | Column, rows: int = ROWS_PER_CHUNK) -> Column:
    """Chunk number of a row from its dense position."""
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(rows)).cast("long")


def _order(order: Sequence[str]) -> list[Column]:
    return [F.col(name) for name in order]


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where a null key equals a null key; the keys appear once."""
    other = right.select(*[F.col(k).alias(f"__same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = [F.col(k).eqNullSafe(F.col(f"__same_{k}")) for k in keys]
    return left.join(other, condition, how).drop(*[f"__same_{k}" for k in keys])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    cumsum: dict[str, Column] | None = None,
    cummax: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    row_number: str | None = None,
) -> DataFrame:
    """Add ordered columns per key, computed per chunk with carried-in values.

    `lag`/`lead`: value of the previous/next row. `cumsum`/`cummax`: over all *earlier* rows (exclusive; sum 0
    and max null for the first row). `last`: last non-null value up to and including the row; `last_before` leaves
    the row itself out. `following`: first non-null value from the row on. `row_number`: 1-based position. `chunk` must not decrease along `order`.
    """
    lag, lead, cumsum, cummax = lag or {}, lead or {}, cumsum or {}, cummax or {}
    last, last_before, following = last or {}, last_before or {}, following or {}
    # One struct as key: its equality and hash take null fields as equal, and one partitioning serves window and join.
    base = df.withColumn("__g", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("c")))
    inputs = {f"__in_{n}": e for group in (lag, lead, cumsum, cummax, last, last_before, following) for n, e in group.items()}
    base = base.withColumns(inputs) if inputs else base
    by = ["__g"]
    position = F.struct(*_order(order))

    aggregates = [F.count(F.lit(1)).alias("__n")]
    if lag:
        aggregates.append(F.max_by(F.struct(*[F.col(f"__in_{n}").alias(n) for n in lag]), position).alias("__tail"))
    if lead:
        aggregates.append(F.min_by(F.struct(*[F.col(f"__in_{n}").alias(n) for n in lead]), position).alias("__head"))
    aggregates += [F.sum(f"__in_{n}").alias(f"__s_{n}") for n in cumsum]
    aggregates += [F.max(f"__in_{n}").alias(f"__s_{n}") for n in cummax]
    for n in (*last, *last_before):
        value = F.when(F.col(f"__in_{n}").isNotNull(), F.struct(position.alias("p"), F.col(f"__in_{n}").alias("v")))
        aggregates.append(F.max(value)["v"].alias(f"__s_{n}"))
    for n in following:
        value = F.when(F.col(f"__in_{n}").isNotNull(), F.struct(position.alias("p"), F.col(f"__in_{n}").alias("v")))
        aggregates.append(F.min(value)["v"].alias(f"__s_{n}"))

    across = Window.partitionBy(*[F.col(f"__g.k{i}") for i in range(len(keys))]).orderBy(F.col("__g.c"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    # Backwards: a frame from a row to the end would be walked anew for every row.
    after = Window.partitionBy(*[F.col(f"__g.k{i}") for i in range(len(keys))]).orderBy(F.desc("__g.c")).rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    if lag:
        carry.append(F.lag("__tail").over(across).alias("__tail"))
    if lead:
        carry.append(F.lead("__head").over(across).alias("__head"))
    carry += [F.sum(f"__s_{n}").over(before).alias(f"__k_{n}") for n in cumsum]
    carry += [F.max(f"__s_{n}").over(before).alias(f"__k_{n}") for n in cummax]
    carry += [F.last(f"__s_{n}", ignorenulls=True).over(before).alias(f"__k_{n}") for n in (*last, *last_before)]
    carry += [F.last(f"__s_{n}", ignorenulls=True).over(after).alias(f"__k_{n}") for n in following]
    if row_number:
        carry.append(F.sum("__n").over(before).alias("__k_rn"))
    carried = base.groupBy(*by).agg(*aggregates).select(*by, *carry)

    local = Window.partitionBy(*by).orderBy(*_order(order))
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy(*by).orderBy(F.desc("__rn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = {"__rn": F.row_number().over(local)}
    for n in lag:
        steps[f"__l_{n}"] = F.lag(f"__in_{n}").over(local)
    if lead:
        steps["__ld"] = F.lead(F.struct(*[F.col(f"__in_{n}").alias(n) for n in lead])).over(local)
    for n in cumsum:
        steps[f"__l_{n}"] = F.sum(f"__in_{n}").over(earlier)
    for n in cummax:
        steps[f"__l_{n}"] = F.max(f"__in_{n}").over(earlier)
    for n in last:
        steps[f"__l_{n}"] = F.last(f"__in_{n}", ignorenulls=True).over(upto)
    for n in last_before:
        steps[f"__l_{n}"] = F.last(f"__in_{n}", ignorenulls=True).over(earlier)
    placed = base.withColumns(steps)
    if following:
        placed = placed.withColumns({f"__l_{n}": F.last(f"__in_{n}", ignorenulls=True).over(onward) for n in following})

    joined = placed.join(carried, "__g")
    result = {}
    for n in lag:
        result[n] = F.when(F.col("__rn") > 1, F.col(f"__l_{n}")).otherwise(F.col("__tail")[n])
    for n in lead:
        result[n] = F.when(F.col("__ld").isNotNull(), F.col("__ld")[n]).otherwise(F.col("__head")[n])
    for n in cumsum:
        result[n] = F.coalesce(f"__l_{n}", F.lit(0)) + F.coalesce(f"__k_{n}", F.lit(0))
    for n in cummax:
        result[n] = F.greatest(f"__l_{n}", f"__k_{n}")
    for n in (*last, *last_before, *following):
        result[n] = F.coalesce(f"__l_{n}", f"__k_{n}")
    if row_number:
        result[row_number] = F.col("__rn") + F.coalesce("__k_rn", F.lit(0))
    joined = joined.withColumns(result)
    return joined.drop(*[c for c in joined.columns if c.startswith("__")])


def number_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    state: str,
    *,
    run: str = "run",
    edge: Sequence[str] = (),
    gap: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Number maximal runs of equal `state` per key, from 0.

    With `gap`, a run also ends where `gap(previous row struct, row)` holds; `edge` names the columns of that struct.
    One summary row per chunk (first and last row, changes inside) is enough to offset the chunk's own numbering.
    """
    by = ["__g"]
    local = Window.partitionBy(*by).orderBy(*_order(order))
    columns = [state, *edge]
    here = F.struct(*[F.col(c).alias(c) for c in columns])

    def differs(previous: Column, current: Column) -> Column:
        changed = ~previous[state].eqNullSafe(current[state])
        return changed if gap is None else changed | F.coalesce(gap(previous, current), F.lit(False))

    rows = df.withColumn("__g", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("c"))).withColumn("__here", here)
    rows = rows.withColumn("__prev", F.lag("__here").over(local))
    rows = rows.withColumn("__new", F.when(F.col("__prev").isNotNull(), differs(F.col("__prev"), F.col("__here")).cast("long")).otherwise(0))
    rows = rows.withColumn("__local", F.sum("__new").over(local))
    position = F.struct(*_order(order))
    edges = rows.groupBy(*by).agg(
        F.min_by("__here", position).alias("__head"), F.max_by("__here", position).alias("__tail"), F.max("__local").alias("__inside")
    )
    across = Window.partitionBy(*[F.col(f"__g.k{i}") for i in range(len(keys))]).orderBy(F.col("__g.c"))
    before = F.lag("__tail").over(across)
    edges = edges.withColumn("__opens", F.when(before.isNotNull(), differs(before, F.col("__head")).cast("long")).otherwise(0))
    upto = across.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("__inside") + F.col("__opens")).over(upto), F.lit(0)) + F.col("__opens")
    offsets = edges.select(*by, offset.alias("__offset"))
    numbered = rows.join(offsets, "__g").withColumn(run, (F.col("__offset") + F.col("__local")).cast("long"))
    return numbered.drop(*[c for c in numbered.columns if c.startswith("__")])


def attach_by_piece(
    rows: DataFrame, per_run: DataFrame, keys: Sequence[str], run: str, chunk: Column
) -> DataFrame:
    """Bring run-level columns back to the rows. The rows are joined by (key, chunk, run), so that a run that spans
    most of a recording is spread over its chunks instead of meeting in one join key."""
    cut = rows.withColumn("__c", chunk)
    pieces = join_same(cut.select(*keys, "__c", run).distinct(), per_run, [*keys, run])
    return join_same(cut, pieces, [*keys, "__c", run]).drop("__c")


def select_rounds(
    ranked: DataFrame, keys: Sequence[str], maximum: int, columns: Sequence[str], state: dict[str, tuple[str, Column]], fits: Callable[[Column, Column], Column],
    take: Callable[[Column, Column], dict[str, Column]], rank: str, at_once: int = 64,
) -> DataFrame:
    """Greedy selection in rank order: take each row that `fits(state, row)`, at most `maximum` per key; adds `picked`.

    `state` maps a name to (type, initial value); `take(state, row)` gives the values after taking a row; `columns` are those
    that both look at. What does not fit must never fit later. A round drops, where they lie, the rows that no longer fit, and
    walks the next `at_once` rows of every key, of which tasks send no more. The first row of a round always fits, so there
    are `maximum` rounds at most and mostly one or two. A key of any size is never collected.
    """
    kind = ranked.schema[rank].dataType.simpleString()
    types = {**{n: t for n, (t, _) in state.items()}, "picked": f"array<{kind}>", "last": kind}
    shape = f"struct<{','.join(f'{n}:{t}' for n, t in types.items())}>"
    source = cut_lineage(ranked.select(*keys, F.col(rank).alias("__rank"), F.struct(*columns).alias("__row")))
    first = {**{n: v for n, (_, v) in state.items()}, "picked": F.array(), "last": F.lit(None)}
    packed = lambda values: F.struct(*[values[n].cast(t).alias(n) for n, t in types.items()]).cast(shape)
    current = source.select(*keys).distinct().withColumn("__state", packed(first))
    finished, order = None, Window.partitionBy(*keys).orderBy("__rank")

    def step(s: Column, item: Column) -> Column:
        row, place = item["row"], item["rank"]
        moved = {**{n: s[n] for n in state}, "picked": s["picked"], "last": place}
        taken = {**moved, **take(s, row), "picked": F.array_append(s["picked"], place)}
        return F.when((F.size(s["picked"]) < maximum) & fits(s, row), packed(taken)).otherwise(packed(moved))

    while True:
        later = F.coalesce(F.col("__rank") > F.col("__state.last"), F.lit(True))
        open_rows = join_same(source, current, keys).where(later & fits(F.col("__state"), F.col("__row")))
        near = open_rows.select(*keys, "__rank", "__row").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= at_once)
        batch = near.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("__rank").alias("rank"), F.col("__row").alias("row")))).alias("__batch"))
        walked = join_same(current, batch, keys, "left").withColumn("__batch", F.coalesce("__batch", F.array().cast(batch.schema["__batch"].dataType)))
        walked = cut_lineage(walked.select(*keys, F.aggregate("__batch", F.col("__state"), step).alias("__state"), (F.size("__batch") == at_once).alias("__more")))
        done = walked.where(~F.col("__more") | (F.size("__state.picked") >= maximum)).select(*keys, "__state")
        finished = done if finished is None else finished.unionByName(done)
        current = walked.where(F.col("__more") & (F.size("__state.picked") < maximum)).select(*keys, "__state")
        if current.isEmpty():
            break
    picks = finished.select(*keys, F.posexplode("__state.picked").alias("picked", rank)).withColumn("picked", (F.col("picked") + 1).cast("long"))
    return join_same(ranked, picks, [*keys, rank], "left")


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], start: Callable, step: Callable, finish: Callable | None, schema: str
) -> DataFrame:
    """Run a small state machine over the ordered rows of every key.

    `start()` gives a state, `step(state, row)` yields output rows, `finish(state)` yields the rest at the end of a
    key; rows are plain tuples in column order. Rows stream through Arrow batches, sorted by Spark: a key is never
    held in memory, and ten thousand short keys cost one pass instead of ten thousand calls.
    """
    columns = df.columns
    at = [columns.index(k) for k in keys]
    fields = to_arrow_schema(T._parse_datatype_string(schema))

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = tuple(row[i] for i in at)
                if key != current:
                    if state is not None and finish is not None:
                        out.extend(finish(state))
                    current, state = key, start()
                out.extend(step(state, row))
            yield table(out)
        if state is not None and finish is not None:
            yield table(list(finish(state)))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


# ---------------------------------------------------------------------------------------------------------
# Pointer chains: greedy packing rules of the form "a group that starts at i ends before next(i)".


def _targets(table: pa.Table, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sorted rows of whole chunks: the row that each row's `nxt` names, and whether its own chunk holds that one."""
    pos, nxt, chunk = (table.column(c).to_numpy() for c in ("pos", "nxt", "__chunk"))
    # Chunks side by side, each as wide as `size`: one sorted line of places for all of them.
    shift = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * size - chunk * size
    line, wanted = pos + shift, np.minimum(nxt, (chunk + 1) * size) + shift
    place = np.searchsorted(line, wanted)
    inside = (nxt < (chunk + 1) * size) & (place < len(line)) & (line[np.minimum(place, len(line) - 1)] == wanted)
    return np.where(inside, place, np.arange(len(line))), inside


def _jump(place: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Where the chain from each position leaves its chunk: pointer doubling over whole arrays."""
    while not ((further := place[place]) == place).all():
        place = further
    return nxt[place]


def _visited(place: np.ndarray, inside: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Which positions the chains from `entry` pass inside their chunks: marks spread by doubling jumps."""
    seen, jump, alive = entry.copy(), place, inside.copy()
    while alive.any():
        marked = np.flatnonzero(seen & alive)
        seen[jump[marked]] = True
        alive = alive & alive[jump]
        jump = jump[jump]
    return seen


def chain_starts(df: DataFrame, keys: Sequence[str], *, rows: int = 4096, fan: int = 64) -> DataFrame:
    """Positions visited by following `nxt` from the first position of every key.

    `df` has `keys`, dense `pos` (from 0) and `nxt` > `pos` (one past the last position ends the chain). Chains are
    contracted level by level: within chunks of `rows` positions every position learns, by pointer doubling over arrays,
    where it leaves its chunk; only positions that another chunk can enter go on, in chunks `fan` times as wide. Once a
    chunk spans the longest key, the visited positions are marked downwards through the same levels. Where chains do not
    merge, a level keeps up to as many rows as enter its chunks; the chunks of an Arrow batch are handled together, as arrays of
    three numbers a row, so that ten thousand short keys do not cost ten thousand calls.
    """
    from tidemark.operators.stepwise import by_piece

    names = [f"__k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("pos").cast("long"), F.col("nxt").cast("long"))
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*names).schema.fields)
    levels = [cut_lineage(base)]
    first = cut_lineage(base.groupBy(*names).agg(F.min("pos").alias("pos")))
    longest = levels[0].agg(F.max("pos")).first()[0] or 0

    def by_chunk(level: DataFrame, size: int, columns: Sequence[str], work: Callable, fields: str) -> DataFrame:
        """Apply `work(rows of whole chunks, their targets)`, which gives rows with a mask or new `nxt`."""
        cut = level.select(*names, F.floor(F.col("pos") / size).cast("long").alias("__chunk"), *columns)
        return by_piece(cut, [*names, "__chunk"], ["pos"], fields, lambda table, starts: work(table, *_targets(table, starts, size)))

    def contract(table: pa.Table, place: np.ndarray, inside: np.ndarray) -> pa.Table:
        return table.select([*names, "pos"]).append_column("nxt", pa.array(_jump(place, table.column("nxt").to_numpy()), pa.int64()))

    def mark(table: pa.Table, place: np.ndarray, inside: np.ndarray) -> pa.Table:
        entry = table.column("entry").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        return table.select([*names, "pos"]).filter(pa.array(_visited(place, inside, entry)))

    sizes = [rows]
    while longest >= sizes[-1]:
        exits = cut_lineage(by_chunk(levels[-1], sizes[-1], ["pos", "nxt"], contract, f"{key_fields}, pos long, nxt long"))
        entered = exits.select(*names, F.col("nxt").alias("pos")).unionByName(first).distinct()
        levels.append(cut_lineage(join_same(exits, entered, [*names, "pos"])))
        sizes.append(sizes[-1] * fan)
    seen = first
    for level, size in zip(reversed(levels), reversed(sizes), strict=True):
        marked = join_same(level, seen.withColumn("entry", F.lit(True)), [*names, "pos"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
        seen = by_chunk(marked, size, ["pos", "nxt", "entry"], mark, f"{key_fields}, pos long")
    return seen.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "pos")
