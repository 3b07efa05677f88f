"""Silence plans, speech regions, interval joins and as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import BOX, SILENCE
from tidemark.operators.chunked import chain_starts, index_chunk, join_same, number_runs, ordered_scan
from tidemark.session import cut_lineage

END = 1 << 60


def time_chunk(column: str | Column, seconds: float = 900.0) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.floor(value / seconds).cast("long")


def scan_silence_log(lines: DataFrame, durations: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Pair start and end marks of a detector log; a trailing open start closes at the clip's end."""
    start = F.regexp_extract(text, r"silence_start:\s*([0-9.]+)", 1)
    end = F.regexp_extract(text, r"silence_end:\s*([0-9.]+)", 1)
    marks = lines.select(
        *keys, order, F.when(start != "", "start").when(end != "", "end").alias("kind"),
        F.when(start != "", start).otherwise(end).try_cast("double").alias("value"),
    ).where("kind IS NOT NULL")
    near = join_same(ordered_scan(
        marks, keys, [order], index_chunk(order), lag={"prior_kind": F.col("kind"), "prior": F.col("value")}, lead={"next_kind": F.col("kind")}
    ), durations, keys)
    closed = (F.col("kind") == "end") & (F.col("prior_kind") == "start")
    trailing = (F.col("kind") == "start") & F.col("next_kind").isNull()
    pairs = near.where(closed | trailing).select(
        *keys, F.when(closed, F.col("prior")).otherwise(F.col("value")).alias("start"),
        F.when(closed, F.col("value")).otherwise(F.col("duration")).alias("end"), trailing.alias("open"),
    )
    return pairs.where(F.col("open") | (F.col("end") > F.col("start")))


def quiet_intervals(samples: DataFrame, keys: Sequence[str], idx: str, at: str, quiet: Column, step: float, minimum: float = SILENCE.minimum) -> DataFrame:
    """Intervals over which the level stays under the threshold for at least `minimum` seconds."""
    runs = number_runs(samples.withColumn("quiet", quiet), keys, [idx], index_chunk(idx), "quiet")
    merged = runs.where("quiet").groupBy(*keys, "run").agg(F.min(at).alias("start"), (F.max(at) + step).alias("end"))
    return merged.where(F.col("end") - F.col("start") >= minimum).drop("run")


def silence_cuts(
    silences: DataFrame, durations: DataFrame, keys: Sequence[str] = ("clip_id",),
    minimum: float = SILENCE.minimum, remove_after: float = SILENCE.remove_after, padding: float = SILENCE.padding,
) -> DataFrame:
    """Centred cuts inside the silences, overlapping cuts merged."""
    clipped = join_same(silences, durations, keys).select(
        *keys, F.greatest(F.lit(0.0), "start").alias("s"), F.least("source_duration", "end").alias("e")
    ).withColumn("d", F.col("e") - F.col("s"))
    keep = F.when(F.col("d") > remove_after, padding * 2).otherwise(max(padding * 2, 0.8))
    cuts = clipped.where(F.col("d") >= minimum).withColumn("keep", keep).where(F.col("d") - F.col("keep") > 0.05).select(
        *keys, (F.col("s") + F.col("keep") / 2).alias("a"), (F.col("e") - F.col("keep") / 2).alias("b")
    )
    seen = ordered_scan(cuts, keys, ["a", "b"], time_chunk("a"), cummax={"reach": F.col("b")})
    opens = F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach")), 1).otherwise(0)
    placed = ordered_scan(seen.withColumn("opens", opens), keys, ["a", "b"], time_chunk("a"), cumsum={"before": F.col("opens")})
    merged = placed.groupBy(*keys, (F.col("before") + F.col("opens")).alias("cut")).agg(F.min("a").alias("start"), F.max("b").alias("end"))
    return merged.withColumn("cut", F.col("cut").cast("long") - 1)


def keep_list(cuts: DataFrame, durations: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """What remains of every clip, with its place in the shortened output."""
    cuts = cut_lineage(cuts)
    gaps = ordered_scan(cuts, keys, ["cut"], index_chunk("cut"), lag={"prior": F.col("end")})
    heads = gaps.select(*keys, F.coalesce("prior", F.lit(0.0)).alias("a"), F.col("start").alias("b"))
    tails = join_same(durations, cuts.groupBy(*keys).agg(F.max("end").alias("last")), keys, "left").select(
        *keys, F.coalesce("last", F.lit(0.0)).alias("a"), F.col("source_duration").alias("b")
    )
    pieces = heads.unionByName(tails).where(F.col("b") > F.col("a") + 0.01)
    placed = ordered_scan(pieces, keys, ["a"], time_chunk("a"), cumsum={"output_start": F.col("b") - F.col("a")})
    kept = placed.select(*keys, F.col("a").alias("source_start"), F.col("b").alias("source_end"), F.col("output_start").cast("double").alias("output_start"))
    whole = join_same(durations.where("source_duration > 0"), pieces.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(0.0).alias("source_start"), F.col("source_duration").alias("source_end"), F.lit(0.0).alias("output_start")
    )
    return kept.unionByName(whole)


def speech_region_stats(regions: DataFrame, durations: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Voice share, runs and silences of every clip, head and tail silence included."""
    inside = join_same(regions, durations, keys).where("end > start").select(
        *keys, F.greatest(F.lit(0.0), "start").alias("s"), F.least("source_duration", "end").alias("e")
    )
    seen = ordered_scan(inside, keys, ["s", "e"], time_chunk("s"), cummax={"cursor": F.col("e")})
    quiet = F.greatest(F.lit(0.0), F.col("s") - F.greatest(F.lit(0.0), F.coalesce("cursor", F.lit(0.0))))
    facts = seen.groupBy(*keys).agg(
        F.sum(F.col("e") - F.col("s")).alias("voiced"), F.max(F.col("e") - F.col("s")).alias("longest"), F.count(F.lit(1)).alias("n"),
        F.max(quiet).alias("quiet"), F.max("e").alias("reach"), F.min("s").alias("first"), F.max_by("e", F.struct("s", "e")).alias("last"),
    )
    d = F.col("source_duration")
    ratio = F.when(d > 0, F.least(F.lit(1.0), F.coalesce("voiced", F.lit(0.0)) / d)).otherwise(0.0)
    return join_same(durations, facts, keys, "left").select(
        *keys, ratio.alias("voice_ratio"), F.coalesce("voiced", F.lit(0.0)).alias("voiced_seconds"),
        F.coalesce("longest", F.lit(0.0)).alias("longest_speech_run"), F.coalesce("n", F.lit(0)).alias("number_of_speech_regions"),
        F.greatest(F.coalesce("quiet", F.lit(0.0)), d - F.greatest(F.lit(0.0), F.coalesce("reach", F.lit(0.0)))).alias("longest_silence"),
        F.col("first").alias("speech_start_delay"), (d - F.col("last")).alias("speech_end_margin"),
        F.greatest(F.lit(0.0), 1 - ratio).alias("silence_ratio"),
        F.when(d > 0, F.least(F.lit(1.0), F.coalesce("longest", F.lit(0.0)) / d * 1.5)).otherwise(0.0).alias("speech_continuity"),
    )


def range_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str],
    condition: Column, bucket: float = 300.0, how: str = "inner",
) -> DataFrame:
    """Join ranges that share time. Both sides are spread over time buckets, so the join key is (key, bucket) and a
    long recording meets in many tasks. A pair is kept in its first common bucket only, so nothing is deduplicated.
    Column names of the two sides must differ except for the keys."""

    def spread(df: DataFrame, bounds: tuple[str, str], tag: str) -> DataFrame:
        low, high = (F.floor(F.col(c) / bucket).cast("long") for c in bounds)
        return df.withColumn(f"__{tag}", low).withColumn("__b", F.explode(F.sequence(low, F.greatest(low, high))))

    a, b = spread(left, left_range, "la"), spread(right, right_range, "lb")
    pairs = join_same(a, b, [*keys, "__b"]).where(condition & (F.col("__b") == F.greatest("__la", "__lb")))
    return pairs.drop("__b", "__la", "__lb")


def overlap_join(ranges: DataFrame, segments: DataFrame, keys: Sequence[str] = ("vod_id",), bucket: float = 300.0) -> DataFrame:
    """Ranges (`start`,`end`) with the segments (`seg_start`,`seg_end`) that overlap them."""
    return range_join(
        ranges, segments, keys, ("start", "end"), ("seg_start", "seg_end"),
        (F.col("seg_end") > F.col("start")) & (F.col("seg_start") < F.col("end")), bucket,
    )


def next_at_or_after(rows: DataFrame, keys: Sequence[str], at: str, value: str, probes: DataFrame, probe_at: str, chunk_seconds: float, name: str = "found", strict: bool = False) -> DataFrame:
    """As-of lookup: for every probe the first row of the same key with `at` >= `probe_at` (> when `strict`).

    Both tables are merged in time order and scanned once per chunk, so no pair of rows is ever built.
    """
    marks = rows.select(*keys, F.col(at).cast("double").alias("__at"), F.lit(0 if strict else 1).alias("__kind"), F.col(value).alias("__value"))
    packed = probes.withColumn("__p", F.struct(*[F.col(c) for c in probes.columns]))
    asks = packed.select(*keys, F.col(probe_at).cast("double").alias("__at"), F.lit(1 if strict else 0).alias("__kind"), F.col("__p").alias("__probe_row"))
    merged = marks.withColumn("__probe_row", F.lit(None).cast(packed.schema["__p"].dataType)).unionByName(
        asks.withColumn("__value", F.lit(None).cast(marks.schema["__value"].dataType))
    )
    merged = merged.withColumnsRenamed({"__at": "scan_at", "__kind": "scan_kind", "__value": "scan_value", "__probe_row": "scan_probe"})
    out = ordered_scan(merged, keys, ["scan_at", "scan_kind"], time_chunk("scan_at", chunk_seconds), following={name: F.col("scan_value")})
    return out.where(F.col("scan_probe").isNotNull()).select("scan_probe.*", name)


def scene_cuts(scores: DataFrame, keys: Sequence[str], at: str, score: str, threshold: float = BOX.scene_change, minimum: float = BOX.scene_min) -> DataFrame:
    """Accepted cut times: high difference, and at least `minimum` seconds after the last accepted one."""
    high = scores.where(F.col(score) >= threshold).select(*keys, F.col(at).alias("at"))
    placed = ordered_scan(high, keys, ["at"], time_chunk("at"), row_number="rn").withColumn("pos", F.col("rn").cast("long") - 1).drop("rn")
    placed = cut_lineage(placed)
    found = next_at_or_after(placed, keys, "at", "pos", placed.withColumn("until", F.col("at") + minimum), "until", 900.0)
    links = found.select(*keys, "pos", F.coalesce("found", F.lit(END)).alias("nxt"))
    return join_same(placed, chain_starts(links, keys), [*keys, "pos"]).select(*keys, "at")


def scenes_between(cuts: DataFrame, durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scenes from 0 over every cut to the end."""
    bounds = durations.select(*keys, F.lit(0.0).alias("at")).unionByName(cuts.select(*keys, "at"))
    ended = join_same(ordered_scan(bounds, keys, ["at"], time_chunk("at"), lead={"next_at": F.col("at")}), durations, keys)
    return ended.select(*keys, F.round("at", 3).alias("start"), F.round(F.coalesce("next_at", "duration"), 3).alias("end")).where("end > start")


def merge_short_scenes(scenes: DataFrame, keys: Sequence[str], minimum: float = BOX.scene_min) -> DataFrame:
    """A scene shorter than `minimum` joins the one before it; the first never does."""
    placed = ordered_scan(scenes, keys, ["start"], time_chunk("start"), row_number="rn")
    opens = F.when((F.col("end") - F.col("start") >= minimum) | (F.col("rn") == 1), 1).otherwise(0)
    grouped = ordered_scan(placed.withColumn("opens", opens), keys, ["start"], time_chunk("start"), cumsum={"before": F.col("opens")})
    return grouped.groupBy(*keys, (F.col("before") + F.col("opens")).alias("scene")).agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    ).withColumn("scene", F.col("scene").cast("long") - 1)


def coverage_problems(segments: DataFrame, durations: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """Order, gap, overlap and end problems of a segment list, and every start snapped to the end before it."""
    near = join_same(ordered_scan(segments, keys, [run], index_chunk(run), lag={"cursor": F.col("end")}, lead={"next_start": F.col("start")}), durations, keys)
    cursor = F.coalesce("cursor", F.lit(0.0))
    problem = (
        F.when((F.col("start") < cursor - 0.02) | (F.col("end") <= F.col("start")), "invalid_times")
        .when(F.col("start") > cursor + 0.15, "uncovered_gap")
        .when(F.col("next_start").isNull() & (F.abs(F.col("end") - F.col("duration")) > 0.2), "end_not_covered")
    )
    snapped = F.when(F.abs(F.col("start") - cursor) <= 0.15, cursor).otherwise(F.col("start"))
    return near.select(*keys, run, snapped.alias("snapped_start"), problem.alias("problem"))


def chapter_hints(windows: DataFrame, chapters: DataFrame, keys: Sequence[str], talking: Sequence[str], gameplay: Sequence[str], bucket: float = 300.0) -> DataFrame:
    """First chapter that contains the window's midpoint and carries a keyword; an absent end means no end.

    Closed chapters meet the windows in time buckets. Of the open ones only the first that has begun matters: a running
    minimum along the merged times of chapters and windows, which builds no pairs.
    """
    title = F.lower("title")
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(title, w))
    hint = F.when(has(talking), "talking").when(has(gameplay), "gameplay")
    hinted = chapters.withColumn("hint", hint).where("hint IS NOT NULL").select(
        *keys, "chapter_ord", "hint", F.coalesce("start_time", F.lit(0.0)).alias("c_start"), F.nullif("end_time", F.lit(0.0)).alias("c_end"))
    points = windows.withColumn("mid", (F.col("start") + F.col("end")) / 2)
    points = points.withColumn("mid2", F.col("mid"))
    closed = hinted.where("c_start < c_end")
    pairs = range_join(points, closed, keys, ("mid", "mid2"), ("c_start", "c_end"), (F.col("c_start") <= F.col("mid")) & (F.col("mid") < F.col("c_end")), bucket)
    inside = pairs.groupBy(*keys, "idx").agg(F.min(F.struct("chapter_ord", "hint")).alias("closed"))

    opened = hinted.where("c_end IS NULL").select(*keys, F.col("c_start").alias("at"), F.lit(0).alias("kind"), F.col("chapter_ord").cast("long").alias("tie"), F.struct((-F.col("chapter_ord")).cast("long").alias("o"), "hint").alias("chapter"))
    asked = points.select(*keys, F.col("mid").alias("at"), F.lit(1).alias("kind"), F.col("idx").cast("long").alias("tie"), F.lit(None).cast("struct<o:bigint,hint:string>").alias("chapter"))
    merged = ordered_scan(opened.unionByName(asked), keys, ["at", "kind", "tie"], time_chunk("at"), cummax={"first": F.col("chapter")})
    begun = merged.where("kind = 1").select(*keys, F.col("tie").alias("idx"), F.struct((-F.col("first.o")).alias("chapter_ord"), F.col("first.hint").alias("hint")).alias("opened"), F.col("first").isNotNull().alias("__some"))
    begun = begun.where("__some").drop("__some")
    order = F.col("closed.chapter_ord").cast("long")
    take_open = F.col("opened").isNotNull() & (order.isNull() | (F.col("opened.chapter_ord") < order))
    best = join_same(windows.select(*keys, F.col("idx")), inside, [*keys, "idx"], "left")
    best = join_same(best, begun, [*keys, "idx"], "left").withColumn("chapter_phase", F.when(take_open, F.col("opened.hint")).otherwise(F.col("closed.hint")))
    reason = F.when(F.col("chapter_phase") == "talking", "chapter_title_chatting_hint").when(
        F.col("chapter_phase") == "gameplay", "chapter_title_gameplay_hint"
    )
    return best.select(*keys, "idx", "chapter_phase").withColumn("chapter_reason", reason)
