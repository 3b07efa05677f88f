"""Ordered folds of streams, and the table of current rows that batches keep up to date."""

import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from tidemark.streaming import live as lv

UTC = dt.timezone.utc


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Rows(Value):
    def appendList(self, rows):  # noqa: N802
        self.value = [*(self.value or []), *rows]

    put = Value.update


class Handle:
    """What the state store offers a processor, for one key."""

    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):  # noqa: N802
        return Rows()

    def getValueState(self, name, schema):  # noqa: N802
        return Value()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def feed(fold, handle, batches):
    """(rows, watermark in ms after them) batches, as Spark hands them on; returns what is emitted per batch."""
    out = []
    for rows, watermark in batches:
        if rows:
            list(fold.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=["at", "tie", "row"])]), Clock(0)))
        assert len(handle.timers) <= 1
        emitted = []
        while due := [t for t in handle.timers if t <= watermark]:
            handle.timers.discard(due[0])
            for frame in fold.handleExpiredTimer(("k",), Clock(watermark), None):
                emitted += frame.values.tolist()
        out.append(emitted)
    return out


def collector(idle=None):
    def step(state, at, row):
        state = (state or 0) + 1
        return state, [(at, row.get("v"), state)]

    fold, handle = lv.InOrder(step, idle, ["key", "at", "v", "n"]), Handle()
    fold.init(handle)
    return fold, handle


def row(at, v, tie=0):
    return (at, tie, json.dumps({"v": v}))


def test_rows_come_in_time_order_and_late_ones_wait():
    fold, handle = collector()
    out = feed(fold, handle, [([row(5000, "b"), row(3000, "a"), row(9_000_000, "z")], 0), ([row(4000, "x"), row(5000, "c", 1)], 6), ([], 10_000)])
    assert out == [[], [["k", 3000, "a", 1], ["k", 4000, "x", 2], ["k", 5000, "b", 3], ["k", 5000, "c", 4]], [["k", 9_000_000, "z", 5]]]
    assert not handle.timers and not fold.waiting.exists() and fold.known.exists()


def test_a_quiet_key_is_forgotten():
    fold, handle = collector(idle=2_000_000)
    out = feed(fold, handle, [([row(1_000_000, "a")], 500), ([row(2_000_000, "b")], 2500), ([], 3500)])
    assert out == [[], [["k", 1_000_000, "a", 1], ["k", 2_000_000, "b", 2]], []]
    assert fold.known.exists() and len(handle.timers) == 1
    assert feed(fold, handle, [([], 9000)]) == [[]]
    assert not fold.known.exists() and not fold.alarm.exists() and not fold.waiting.exists() and not handle.timers
    # a gap starts a key anew, whether or not the timer fired in between
    fold, handle = collector(idle=2_000_000)
    assert feed(fold, handle, [([row(1_000_000, "a"), row(9_000_000, "b")], 20_000)])[0] == [["k", 1_000_000, "a", 1], ["k", 9_000_000, "b", 1]]


def source(spark, tmp_path, batches, schema):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(seconds=seconds)


def test_hysteresis_with_null_keys_and_states(spark, tmp_path):
    states = [(0, "x"), (10, None), (20, None), (30, "y"), (40, None), (50, "y"), (60, "y"), (70, "y"), (5000, "z")]
    rows = [(k, at(s), v) for k in (None, "a") for s, v in states] + [("a", None, "x")]
    stream = source(spark, tmp_path, [rows[::2], rows[1::2]], "k string, ts timestamp, s string")
    got = lv.run_to_table(lv.live_hysteresis(stream, ["k"], "ts", "2 hours", "s", 2), "h").collect()
    assert got == []  # the watermark has passed nothing yet
    stream = source(spark, tmp_path / "b", [rows[:1] + rows[5:12], [*rows[1:5], *rows[12:]], [("end", at(99_999), "x")]], "k string, ts timestamp, s string")
    got = lv.run_to_table(lv.live_hysteresis(stream, ["k"], "ts", "2 hours", "s", 2), "h2").collect()
    base = int(at(0).timestamp()) * 1_000_000
    assert sorted(((str(r["k"]), r["from_state"], r["to_state"], r["start_us"] - base) for r in got), key=str) == sorted(
        [(k, *c) for k in ("None", "a") for c in (("x", None, 10_000_000), (None, "y", 50_000_000))], key=str
    )


def test_near_repeats_are_left_out(spark, tmp_path):
    said = ["uno dos tres cuatro cinco", "uno dos tres cuatro cinco", "seis siete ocho", None, "", "UNO dos, tres cuatro cinco seis", "uno dos tres cuatro cinco"]
    rows = [("a", at(i * 10), at(i * 10 + (25 if i < 6 else 5)), t) for i, t in enumerate(said)] + [("end", at(99_999), at(99_999), "x")]
    stream = source(spark, tmp_path, [rows], "k string, ts timestamp, until timestamp, text string")
    got = lv.run_to_table(lv.live_unrepeated(stream, ["k"], "ts", "1 hour", "until", "text"), "u").where("k = 'a'").orderBy("start_us").collect()
    # the second repeats the first; the sixth no longer shares time with the first; the last repeats the sixth
    assert [r["text"] for r in got] == [said[0], *said[2:6]]


def test_current_table_survives_replays(spark, tmp_path):
    schema = "k string, t int, v string"
    table = lv.CurrentTable(spark, f"{tmp_path}/current", ["k"], ["t"], buckets=4)
    df = lambda rows: spark.createDataFrame(rows, schema)
    assert table.read(df([("x", 1, "x")]).schema).collect() == []
    batches = [[(f"k{i}", 1, "old") for i in range(20)] + [(None, 1, "none")], [("k3", 2, "new"), ("k3", 0, "late"), (None, 5, "nil")], [("k7", 0, "late"), ("k99", 1, "fresh")]]
    for number, rows in enumerate(batches):
        table.merge(df(rows), number)
        if number == 1:
            table.merge(df(batches[1]), 1)  # replayed
    got = {r["k"]: r["v"] for r in table.read(df(batches[0]).schema).collect()}
    assert got == {**{f"k{i}": "old" for i in range(20)}, None: "nil", "k3": "new", "k99": "fresh"}
    assert table.read(df(batches[0]).schema).count() == 22
    assert len(table._holders()) <= 4  # one version is read per bucket
    table.merge(df(batches[2]), 2)
    assert {r["k"]: r["v"] for r in table.read(df(batches[0]).schema).collect()} == got


def test_missing_work_with_null_keys(spark, tmp_path):
    planned = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, n int")
    stream = source(spark, tmp_path, [[(None,), ("a",), ("a",)]], "k string")
    assert [tuple(r) for r in lv.live_missing(planned, stream, ["k"]).collect()] == [("b", 3)]


def test_a_key_is_folded_in_pieces(spark):
    """One key lies in many pieces (F11, F12). A piece that started from a wrong guess is done again."""
    def step(state, at, row):  # remembers two kept values for a while, so that a short look back guesses wrongly
        kept = [k for k in state or [] if k[0] > at]
        if any(k[1] == row["v"] for k in kept):
            return kept, []
        return [*kept, [at + 90, row["v"]]][-2:], [(at, row["v"])]

    rows = [(None if i % 10 == 0 else "hot" if i % 9 else "b", i * 7 % 1000, i % 3, json.dumps({"v": i * i % 5})) for i in range(900)] + [("quiet", lv.BEFORE, 5, "[[9, 1]]"), ("b", lv.BEFORE, -8, "[[60, 1]]")]
    plain, states = [], {}
    for key, moment, tie, text in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        known, newest = states.get(key, (None, None))
        if moment == lv.BEFORE:
            states[key] = json.loads(text), tie
            continue
        known, out = step(known, moment, json.loads(text))
        states[key] = known, moment
        plain += [(key, *o) for o in out]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "k string, at long, tie long, row string").repartition(3)
        for tail in (1, 10_000):
            done = lv.fold_in_pieces(frame, ["k"], step, None, 2000, "since long, v long", tail).collect()
            assert len({r["__piece"] for r in done if r.k == "hot"}) > 1
            assert sorted(((r.k, r.since, r.v) for r in done if r["__kind"] == 0), key=str) == sorted(plain, key=str)
            assert {r.k: (json.loads(r["__state"]), r["__newest"]) for r in done if r["__kind"] == 1} == states
            assert len([r for r in done if r["__kind"] == 1]) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batches_give_what_the_state_store_gives(spark, tmp_path):
    states = [(k, at(i * 37 % 900 * 20), "xyz"[i * i % 7 % 3]) for i in range(150) for k in ("a", None)] + [("end", at(40_000), "x")]
    for idle in (None, 900):
        found = []
        for way in ("run", "streaming"):
            stream = source(spark, tmp_path / f"{idle}-{way}", [states[:100], states[100:220], states[220:]], "k string, ts timestamp, s string")
            live = lv.live_hysteresis(stream, ["k"], "ts", "2 hours", "s", 2, idle_seconds=idle)
            found.append(sorted(map(str, lv.run_to_table(live if way == "run" else live.streaming(), "w").collect())))
        assert found[0] == found[1] and found[0]
