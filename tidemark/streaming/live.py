"""Live forms of the timeline operators on Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import TRANSCRIPT
from tidemark.functions import text as tx
from tidemark.operators.chunked import join_same
from tidemark.operators.jobs import latest_per_key
from tidemark.operators.stepwise import key_schema
from tidemark.session import cut_lineage


def state_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame | InOrderStream, name: str, mode: str = "append") -> DataFrame:
    """Process what is available now into a parquet table and read it back; nothing passes through the driver."""
    if isinstance(stream, InOrderStream):
        return stream.run(name)
    spark = stream.sparkSession
    folder = state_folder(spark, name)
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None]) -> str:
    spark = stream.sparkSession
    folder = state_folder(spark, name)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return folder


def live_windows(stream: DataFrame, keys: Sequence[str], ts: str, delay: str, size: str, step: str | None = None, **aggregates: Column) -> DataFrame:
    """Tumbling (or, with `step`, overlapping) windows per recording, emitted once the watermark has passed them."""
    window = F.window(ts, size, step) if step else F.window(ts, size)
    grouped = stream.withWatermark(ts, delay).groupBy(*keys, window.alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), *aggregates)


def live_runs(stream: DataFrame, keys: Sequence[str], ts: str, delay: str, gap: str) -> DataFrame:
    """Runs of rows of one key that are less than `gap` apart."""
    runs = stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("samples"))
    return runs.select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "samples")


#: Ordered state needs timers and lists, which Spark keeps in this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Hands the rows of a key to `step(state, at, row)` in the order of their times, once the watermark has passed them.

    Rows wait in a list that the watermark bounds: Spark drops later ones, and a timer hands earlier ones on. Of a key only a
    small state of plain types is remembered; `step` returns the next one and the rows to emit. After more than `idle`
    microseconds without a row a key starts anew, and its state is removed once the watermark shows that."""

    def __init__(self, step: Callable, idle: int | None, columns: Sequence[str]) -> None:
        self.step, self.idle, self.columns = step, idle, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, tie long, row string")
        self.known = handle.getValueState("known", "state string, newest long")
        self.alarm = handle.getValueState("alarm", "at long")

    def _wake(self, at: int | None) -> None:
        """One timer a key, the earliest that is needed."""
        if self.alarm.exists():
            self.handle.deleteTimer(self.alarm.get()[0])
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            values = [(int(at), int(tie), row) for at, tie, row in frame[["at", "tie", "row"]].itertuples(index=False)]
            self.waiting.appendList(values)
            least = min(values)[0]
            first = least if first is None else min(first, least)
        if first is not None and (not self.alarm.exists() or first // 1000 + 1 < self.alarm.get()[0]):
            self._wake(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(row) for row in self.waiting.get()) if self.waiting.exists() else []
        ready = [row for row in rows if row[0] <= passed]
        state, newest = None, None
        if self.known.exists():
            text, newest = self.known.get()
            state = json.loads(text)
        out = []
        for at, _, row in ready:
            if self.idle is not None and newest is not None and at - newest > self.idle:
                state = None
            state, emitted = self.step(state, at, json.loads(row))
            out.extend((*key, *values) for values in emitted)
            newest = at
        rest = rows[len(ready) :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        quiet = self.idle is not None and newest is not None and newest + self.idle < passed
        if quiet or newest is None:
            self.known.clear()
        else:
            self.known.update((json.dumps(state), newest))
        times = [rest[0][0]] if rest else []
        times += [newest + self.idle + 1000] if self.idle is not None and newest is not None and not quiet else []
        self._wake(min(times) // 1000 + 1 if times else None)
        yield pd.DataFrame(out, columns=self.columns)


#: The time of a row that brings the state of its key from earlier batches.
BEFORE = -(2**63)


def fold_in_pieces(rows: DataFrame, keys: Sequence[str], step: Callable, idle: int | None, passed: int, schema: str, tail: int = 10_000) -> DataFrame:
    """Rows (keys, at, tie, row) of every key folded by `step` in their order; a row at `BEFORE` brings a state and, as tie, its newest time.

    The ordered rows are cut into as many pieces as there are tasks, whatever their keys. A piece that continues the key of the one
    before it starts from a guess: the state after the last `tail` rows of that key there. Then the states in which the pieces
    really end are compared with the guesses, and pieces that started from a wrong one are done again, until all agree. What a
    state has forgotten it cannot guess wrongly, so few are; at worst, when nothing is ever forgotten, one piece follows the other.
    Of a piece only its first and last key and one state come to the driver. Gives keys and columns of `schema`, `__piece`, `__kind`
    (0: emitted by `step`, 1: last state of a key, 2: of a piece whose key goes on), `__state` and `__newest`.
    """
    names = list(keys)
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(names)])
    order = [key, "at", "tie", "row"]
    # sorted by the same columns as dealt, so that a piece is a range
    dealt = rows.select(*names, "at", "tie", "row").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("__piece", F.spark_partition_id().cast("long")))
    kinds = key_schema(rows, names)
    fields = T._parse_datatype_string(f"{kinds}, {schema}, __piece long, __kind int, __state string, __newest long")
    emitted = T._parse_datatype_string(schema).names
    arrow, blank = to_arrow_schema(fields), (None,) * len(emitted)

    def advance(known, at, tie, row):
        """(state, newest) after a row, and what it emits."""
        state, newest = known
        if at == BEFORE:
            return (json.loads(row), tie), []
        if idle is not None and newest is not None and at - newest > idle:
            state = None
        state, out = step(state, at, json.loads(row))
        return (state, at), out

    def tuples(batch):
        columns = [batch.column(c).to_pylist() for c in (*names, "at", "tie", "row")]
        for values in zip(*columns, strict=True):
            yield values[: len(names)], *values[len(names) :]

    ends = T._parse_datatype_string(f"__piece long, first struct<{kinds}>, last struct<{kinds}>, __state string, __newest long")

    def guess(batches):
        kept, first, piece = [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first, piece = next(tuples(batch.slice(0, 1)))[0], batch.column("__piece")[0].as_py()
            kept.append(batch)
            while len(kept) > 1 and sum(b.num_rows for b in kept[1:]) >= tail:
                kept.pop(0)
        if first is None:
            return
        last, known = next(tuples(kept[-1].slice(kept[-1].num_rows - 1)))[0], (None, None)
        skip = max(0, sum(b.num_rows for b in kept) - tail)
        for n, (of, at, tie, row) in enumerate(r for b in kept for r in tuples(b)):
            if n >= skip and of == last:
                known, _ = advance(known, at, tie, row)
        edge = [dict(zip(names, k, strict=True)) for k in (first, last)]
        yield pa.RecordBatch.from_pylist([{"__piece": piece, "first": edge[0], "last": edge[1], "__state": json.dumps(known[0]), "__newest": known[1]}], to_arrow_schema(ends))

    found = sorted(dealt.mapInArrow(guess, ends).collect(), key=lambda r: r["__piece"])
    ending = {r["__piece"]: (r["__state"], r["__newest"]) for r in found}
    follows = {b["__piece"]: a["__piece"] for a, b in zip(found, found[1:]) if a["last"] == b["first"]}  # noqa: B905
    goes_on, start = frozenset(follows.values()), {p: ending[before] for p, before in follows.items()}

    def fold(batches):
        current, known, piece = None, (None, None), None

        def finish(on: bool):
            if known[1] is not None and (on or idle is None or known[1] + idle >= passed):
                yield (*current, *blank, piece, 2 if on else 1, json.dumps(known[0]), known[1])

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            if piece is None:
                piece = batch.column("__piece")[0].as_py()
                current = next(tuples(batch.slice(0, 1)))[0]
                if piece in start:
                    text, newest = start[piece]
                    known = json.loads(text), newest
            for of, at, tie, row in tuples(batch):
                if of != current:
                    out.extend(finish(False))
                    current, known = of, (None, None)
                known, values = advance(known, at, tie, row)
                out.extend((*of, *v, piece, 0, None, None) for v in values)
            if out:
                yield table(out)
        if piece is not None and (out := list(finish(piece in goes_on))):
            yield table(out)

    result, again = None, None
    while again is None or again:
        todo = dealt if again is None else dealt.where(F.col("__piece").isin(again))
        done = cut_lineage(todo.mapInArrow(fold, fields))
        result = done if result is None else result.where(~F.col("__piece").isin(again)).unionByName(done)
        ending.update({r["__piece"]: (r["__state"], r["__newest"]) for r in done.where("__kind = 2").select("__piece", "__state", "__newest").collect()})
        again = [p for p, before in follows.items() if start[p] != ending[before]]
        start.update({p: ending[follows[p]] for p in again})
    return result


class InOrderStream:
    """A stream whose rows are folded per key in event time (see `live_in_order`), run by `run_to_table`.

    The rows that wait for the watermark and the states of the keys are tables with one version a micro-batch, so a batch may be
    replayed, and a key with any share of the rows is sorted and folded by all tasks (see `fold_in_pieces`). `streaming` gives the
    same as a streaming table, for keys of which few rows wait: there they are one list in the state store."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], ts: str, delay: str, step: Callable, schema: str, idle: int | None) -> None:
        self.rows, self.keys, self.ts, self.delay, self.step, self.emits, self.idle = rows, list(keys), ts, delay, step, schema, idle
        self.schema = T._parse_datatype_string(f"{key_schema(rows, keys)}, {schema}")

    def streaming(self) -> DataFrame:
        self.rows.sparkSession.conf.set(*STORE)
        waits = self.rows.withWatermark(self.ts, self.delay)
        return waits.groupBy(*self.keys).transformWithStateInPandas(InOrder(self.step, self.idle, self.schema.names), self.schema, "Append", "EventTime")

    def run(self, name: str) -> DataFrame:
        spark = self.rows.sparkSession
        folder = state_folder(spark, name)
        delay = spark.range(1).select(F.unix_millis(F.expr(f"timestamp_seconds(0) + INTERVAL '{self.delay}'"))).first()[0]
        plain = self.rows.drop(self.ts)

        def version(table: str, number: int, schema) -> DataFrame:
            try:
                return spark.read.schema(schema).parquet(f"{folder}/{table}/batch={number}")
            except AnalysisException:  # no such batch
                return spark.createDataFrame([], schema)

        def put(rows: DataFrame, table: str, number: int) -> None:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/{table}/batch={number}")

        def handle(batch: DataFrame, number: int) -> None:
            late = passed = 0
            if number > 0:
                newest = spark.read.parquet(f"{folder}/newest").where(F.col("batch") < number)
                times = newest.agg(F.max(F.when(F.col("batch") < number - 1, F.col("at"))), F.max("at")).first()
                late, passed = (max(0, 0 if t is None else t // 1000 - delay) * 1000 for t in times)
            put(batch.agg(F.max("at").alias("at")), "newest", number)
            rows = batch.select(*plain.columns).where(F.col("at") > late).unionByName(version("waiting", number - 1, plain.schema))
            put(rows.where(F.col("at") > passed), "waiting", number)
            known = version("known", number - 1, plain.schema)
            if passed > 0:
                folded = fold_in_pieces(rows.where(F.col("at") <= passed).unionByName(known), self.keys, self.step, self.idle, passed, self.emits)
                put(folded.where("__kind = 0").select(*self.schema.names), "out", number)
                known = folded.where("__kind = 1").select(*self.keys, F.lit(BEFORE).alias("at"), F.col("__newest").alias("tie"), F.col("__state").alias("row"))
            put(known, "known", number)

        run_batches(self.rows, f"{name}-run", handle)
        try:
            last = spark.read.parquet(f"{folder}/newest").agg(F.max("batch")).first()[0]
        except AnalysisException:  # the stream has no rows
            return spark.createDataFrame([], self.schema)
        handle(spark.createDataFrame([], plain.schema), last + 1)  # rows that the last watermark has passed
        try:
            return spark.read.schema(self.schema).parquet(f"{folder}/out").drop("batch")
        except AnalysisException:  # the watermark has passed nothing
            return spark.createDataFrame([], self.schema)


def live_in_order(
    stream: DataFrame, keys: Sequence[str], ts: str, delay: str, columns: dict[str, Column], step: Callable, schema: str, tie: Column | None = None, idle_seconds: int | None = None
) -> InOrderStream:
    """Rows of every key folded in event time, whatever order they arrive in: keys and the rows that `step` emits.

    `step(state, at, row)` gets the state before (None for a new key), the row's time in microseconds and its `columns` as
    a dictionary without nulls, and returns (state, emitted tuples); states are plain types that JSON can hold. Equal times go by
    `tie`, a whole number. Rows later than the watermark and rows without a time are left out.
    """
    rows = stream.where(F.col(ts).isNotNull())
    rows = rows.select(*keys, ts, F.unix_micros(ts).alias("at"), F.coalesce(F.lit(0) if tie is None else tie, F.lit(0)).cast("long").alias("tie"), F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()])).alias("row"))
    return InOrderStream(rows, keys, ts, delay, step, schema, None if idle_seconds is None else idle_seconds * 1_000_000)


def live_hysteresis(
    stream: DataFrame, keys: Sequence[str], ts: str, delay: str, state: str, confirmation: int, tie: Column | None = None, idle_seconds: int | None = None
) -> InOrderStream:
    """Confirmed transitions with the time of the first sample that carried the new state, in event time.

    What is remembered per recording is the current state, the pending one, its start and its count. Null is a state like others."""

    def step(before, at: int, row: dict):
        value = row.get("state")
        if before is None:
            return [value, None, 0, 0], []
        current, pending, since, count = before
        if value == current:
            return [current, None, 0, 0], []
        since, count = (since, count + 1) if count and value == pending else (at, 1)
        if count >= confirmation:
            return [value, None, 0, 0], [(current, value, since)]
        return [current, value, since, count], []

    return live_in_order(stream, keys, ts, delay, {"state": F.col(state)}, step, "from_state string, to_state string, start_us long", tie, idle_seconds)


def live_unrepeated(
    stream: DataFrame, keys: Sequence[str], ts: str, delay: str, end: str, text: str, alike: float = TRANSCRIPT.duplicate_jaccard, remembered: int = TRANSCRIPT.duplicate_window, tie: Column | None = None
) -> InOrderStream:
    """Transcript segments without those that repeat one of the last `remembered` kept ones: they share time with it and at least
    `alike` of both word sets. `ts` and `end` are times. What was emitted stays, so the first hearing is kept, not the better one."""

    def step(before, at: int, row: dict):
        kept, words, until = before or [], set(row.get("words") or []), row.get("until", at)
        for start, stop, heard in kept:
            both = words.union(heard)
            if min(until, stop) > max(at, start) and both and len(words.intersection(heard)) >= alike * len(both):
                return kept, []
        return [*kept, [at, until, sorted(words)]][-remembered:], [(at, until, row.get("text"))]

    columns = {"until": F.unix_micros(end), "text": F.col(text), "words": F.array_distinct(tx.words(F.col(text)))}
    return live_in_order(stream, keys, ts, delay, columns, step, "start_us long, end_us long, text string", tie)


def live_distinct(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


class CurrentTable:
    """The latest row per key of everything seen so far, in `buckets` by key, as versioned files.

    A batch rewrites only the buckets that it touches, under its own number, and then writes which version holds each bucket.
    A replayed batch starts from the version before it and overwrites its own, so it changes nothing. A reader opens one version
    per bucket: reading costs the keys, not the batches.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], newest: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.folder, self.keys, self.newest, self.buckets = spark, folder, list(keys), [F.col(c) for c in newest], buckets

    def _holders(self, before: int | None = None) -> dict[int, int]:
        """bucket -> the version that holds it, after the last batch (before batch `before`): at most `buckets` rows."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/holders")
        except AnalysisException:  # nothing written yet
            return {}
        rows = rows if before is None else rows.where(F.col("number") < before)
        last = rows.agg(F.max("number")).first()[0]
        return {} if last is None else {r["bucket"]: r["version"] for r in rows.where(F.col("number") == last).collect()}

    def _rows(self, holders: dict[int, int], schema) -> DataFrame | None:
        paths = [f"{self.folder}/version={v}/bucket={b}" for b, v in sorted(holders.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def merge(self, batch: DataFrame, number: int) -> None:
        holders = self._holders(number)
        latest = cut_lineage(latest_per_key(batch, self.keys, self.newest))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in latest.select(bucket.alias("bucket")).distinct().collect()]
        old = self._rows({b: v for b, v in holders.items() if b in touched}, latest.schema)
        merged = latest if old is None else latest_per_key(latest.unionByName(old), self.keys, self.newest)
        placed = merged.withColumn("bucket", bucket)
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.folder}/version={number}")
        rows = [(b, v) for b, v in (holders | dict.fromkeys(touched, number)).items()]
        self.spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/holders/number={number}")

    def read(self, schema) -> DataFrame:
        found = self._rows(self._holders(), schema)
        return self.spark.createDataFrame([], schema) if found is None else found


def live_job_state(stream: DataFrame, keys: Sequence[str], newest: Sequence[str], buckets: int = 64) -> DataFrame:
    """Latest row per job, kept up to date by every micro-batch (see `CurrentTable`)."""
    spark = stream.sparkSession
    table = CurrentTable(spark, state_folder(spark, "job-state"), keys, newest, buckets)
    run_batches(stream, "job-state-run", table.merge)
    return table.read(stream.select(*keys, *[c for c in stream.columns if c not in keys]).schema)


def live_late_rows(stream: DataFrame, ts: str, delay_seconds: int) -> DataFrame:
    """Rows older than the newest time of all earlier batches minus the delay.

    Every batch records its newest time under its number, so a replayed or restarted batch sees the same limit.
    """
    spark = stream.sparkSession
    folder = state_folder(spark, "late")

    def handle(batch: DataFrame, number: int) -> None:
        limit = None
        if number > 0:
            limit = spark.read.parquet(f"{folder}/newest").where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        late = F.lit(False) if limit is None else F.unix_micros(ts) < limit - delay_seconds * 1_000_000
        batch.where(late).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        batch.agg(F.max(F.unix_micros(ts)).alias("newest")).write.mode("overwrite").parquet(f"{folder}/newest/batch={number}")

    run_batches(stream, "late-run", handle)
    return spark.read.parquet(f"{folder}/out").drop("batch")


def live_missing(planned: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned work that the completed stream has not delivered up to now. Restarting continues from the checkpoint."""
    done = run_to_table(completed.select(*keys), "completed")
    return join_same(planned, done, keys, "left_anti")
