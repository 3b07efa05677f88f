"""State timelines: confirmation, runs, segments, blocks, durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import LAYOUT, PHASE, PHASES
from tidemark.operators.chunked import attach_by_piece, index_chunk, join_same, number_runs, ordered_scan, select_rounds
from tidemark.operators.orderstats import at_rank, medians, ranked_values
from tidemark.session import cut_lineage

KEYS = ("vod_id",)


def hysteresis(
    samples: DataFrame, keys: Sequence[str] = KEYS, idx: str = "idx", state: str = "layout_id", confirmation: int = LAYOUT.confirmation
) -> DataFrame:
    """A state counts only after `confirmation` equal samples, from the first of them on.

    Runs of at least that length own themselves; every other run takes the last confirmed state before it, else
    the first state of the recording. Adds `accepted` and `hysteresis_reason`.
    """
    rows = cut_lineage(number_runs(samples, keys, [idx], index_chunk(idx), state))
    runs = rows.groupBy(*keys, "run").agg(
        F.min(state).alias("s_state"), F.count(F.lit(1)).alias("s_n"), F.min(idx).alias("s_first")
    )
    owned = F.when(F.col("s_n") >= confirmation, F.col("s_state"))
    first = F.when(F.col("run") == 0, F.col("s_state"))
    runs = ordered_scan(
        runs, keys, ["run"], index_chunk("run"), last={"confirmed": owned, "initial": first}, last_before={"earlier": owned}
    )
    runs = runs.withColumns({
        "accepted": F.coalesce("confirmed", "initial"),
        "before": F.when(F.col("run") > 0, F.coalesce("earlier", "initial")),
    })
    per_run = runs.select(*keys, "run", "accepted", "before", "s_first")
    joined = attach_by_piece(rows, per_run, keys, "run", index_chunk(idx))
    reason = F.when(F.col("accepted") != F.col(state), "layout_hysteresis_suppressed_transition").when(
        (F.col(idx) == F.col("s_first")) & (F.col("before") != F.col("accepted")) & F.lit(confirmation > 1),
        "layout_transition_confirmed",
    )
    return joined.withColumn("hysteresis_reason", reason).drop("run", "before", "s_first")


def representatives(samples: DataFrame, keys: Sequence[str] = KEYS, idx: str = "idx", state: str = "layout_id", value: str = "phase") -> DataFrame:
    """The value carried by the last sample of every state."""
    return samples.groupBy(*keys, state).agg(F.max_by(value, idx).alias(value))


def merge_state_runs(
    samples: DataFrame,
    durations: DataFrame,
    keys: Sequence[str] = KEYS,
    idx: str = "idx",
    state: str = "accepted",
    interval: float = LAYOUT.sample_seconds,
    median_of: Sequence[str] = ("confidence",),
    labels: Sequence[str] = (),
) -> DataFrame:
    """Consecutive equal states become one segment that ends one interval after its last sample, at most at the
    recording's end. `durations` has the keys and `duration`. Medians of the columns `median_of` and the distinct entries of
    the array columns `labels`, in the order they first occur, are added; neither gathers the samples of a run."""
    rows = number_runs(samples, keys, [idx], index_chunk(idx), state)
    if median_of or labels:
        rows = cut_lineage(rows.select(*dict.fromkeys([*keys, "run", idx, state, "frame_timestamp", "phase", *median_of, *labels])))
    run = [*keys, "run"]
    merged = rows.groupBy(*run).agg(
        F.min("frame_timestamp").alias("start"),
        F.max("frame_timestamp").alias("last_at"),
        F.min(state).alias("layout_id"),
        F.max_by("phase", idx).alias("phase"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    if median_of:
        merged = join_same(merged, medians(rows, run, median_of), run, "left")
    for name in labels:
        merged = join_same(merged, ordered_labels(rows, run, name, idx, name), run, "left")
        merged = merged.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    bounded = join_same(merged, durations, keys).withColumn("end", F.least("duration", F.col("last_at") + interval))
    return bounded.where("end > start").drop("last_at", "duration")


def ordered_labels(rows: DataFrame, keys: Sequence[str], labels: str, order: str, name: str) -> DataFrame:
    """Distinct labels of an array column per key, in the order they first occur. Only one row per distinct label
    and key reaches the final list."""
    exploded = rows.select(*keys, F.col(order).alias("__o"), F.posexplode(labels).alias("__p", "__label"))
    firsts = exploded.groupBy(*keys, "__label").agg(F.min(F.struct("__o", "__p")).alias("__at"))
    packed = F.sort_array(F.collect_list(F.struct("__at", "__label")))
    return firsts.groupBy(*keys).agg(F.transform(packed, lambda x: x["__label"]).alias(name))


def durations_of(samples: DataFrame, keys: Sequence[str] = KEYS, interval: float = LAYOUT.sample_seconds) -> DataFrame:
    return samples.groupBy(*keys).agg((F.max("frame_timestamp") + interval).alias("duration"))


def transitions(segments: DataFrame, keys: Sequence[str] = KEYS, run: str = "run", label: str = "phase") -> DataFrame:
    """`a_to_b` labels into and out of every segment."""
    near = ordered_scan(segments, keys, [run], index_chunk(run), lag={"before": F.col(label)}, lead={"after": F.col(label)})
    return near.withColumns({
        "transition_in": F.concat("before", F.lit("_to_"), label),
        "transition_out": F.concat(label, F.lit("_to_"), "after"),
    }).drop("before", "after")


def robust_confidence(rows: DataFrame, keys: Sequence[str], value: str = "confidence") -> DataFrame:
    """Trim a tenth at each side, then 0.6 median + 0.4 mean, from the ranks of the distinct values."""
    trim = F.floor(F.col("stat_total") / 10)
    h = ranked_values(rows, keys, value).withColumns({"stat_low": trim, "stat_high": F.col("stat_total") - trim})
    kept = F.greatest(F.lit(0), F.least(F.col("stat_before") + F.col("stat_count"), "stat_high") - F.greatest("stat_before", "stat_low"))
    span = F.col("stat_high") - F.col("stat_low")
    left, right = F.col("stat_low") + F.floor((span - 1) / 2), F.col("stat_low") + F.floor(span / 2)
    out = h.groupBy(*keys).agg(
        ((at_rank(left) + at_rank(right)) / 2).alias("mid"), (F.sum(F.col("stat_value") * kept) / F.sum(kept)).alias("mean")
    )
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mid") * 0.6 + F.col("mean") * 0.4))
    return out.select(*keys, score.alias("robust_confidence"))


def classify_blocks(
    segments: DataFrame,
    keys: Sequence[str] = KEYS,
    run: str = "run",
    target: str = "talking",
    minimum: float = PHASE.minimum_block,
    sustained: float = PHASE.sustained_talking,
) -> DataFrame:
    """Blocks of the target state with duration class, reasons and the class of what follows."""
    near = ordered_scan(
        segments, keys, [run], index_chunk(run), lead={"next_phase": F.col("phase"), "next_confidence": F.col("confidence")}
    )
    only = near.where(F.col("phase") == target)
    numbered = ordered_scan(only, keys, [run], index_chunk(run), row_number="number")
    duration = F.col("end") - F.col("start")
    ending = (
        F.when(F.col("next_phase").isNull(), "end_of_analysis")
        .when((F.col("next_phase") == "gameplay") & (F.col("next_confidence") >= 0.5), "gameplay_transition")
        .when(F.col("next_phase") == "unknown", "unknown_transition")
        .when(F.col("next_confidence") < 0.5, "low_confidence_transition")
        .otherwise("other_transition")
    )
    relevance = F.when(duration >= minimum, "secondary").when(duration >= sustained, "low_priority").otherwise("ignored")
    reason = (
        F.when(duration >= minimum, "long_sustained_conversation")
        .when(duration >= sustained, "short_sustained_conversation")
        .otherwise("below_relevant_talking_duration")
    )
    blocks = numbered.select(
        *keys, run, F.format_string("talking-%03d", "number").alias("id"), F.col("number").cast("long").alias("number"),
        "start", "end", duration.alias("duration_seconds"), "confidence", relevance.alias("relevance"),
        F.array_compact(F.array(reason, F.when(F.col("confidence") >= 0.65, "consistent_talking_window_scores"))).alias("selection_reason"),
        ending.alias("end_transition"),
    )
    primary = primary_block(blocks, keys, minimum).select(*keys, F.col("number").alias("primary_number"))
    marked = join_same(blocks, primary, keys, "left")
    is_primary = F.col("number") == F.col("primary_number")
    return marked.withColumns({
        "relevance": F.when(is_primary, "primary").otherwise(F.col("relevance")),
        "selection_reason": F.when(
            is_primary, F.concat(F.array(F.lit("primary_initial_long_talking_block")), "selection_reason")
        ).otherwise(F.col("selection_reason")),
        "is_primary": F.coalesce(is_primary, F.lit(False)),
    }).drop("primary_number")


def primary_block(blocks: DataFrame, keys: Sequence[str] = KEYS, minimum: float = PHASE.minimum_block) -> DataFrame:
    """First block that is long enough."""
    return blocks.where(F.col("duration_seconds") >= minimum).groupBy(*keys).agg(
        F.min_by("id", "number").alias("primary_talking_block_id"), F.min("number").alias("number")
    )


def budgeted_selection(
    blocks: DataFrame,
    keys: Sequence[str] = KEYS,
    minimum: float = PHASE.minimum_block,
    max_count: int = PHASE.max_blocks,
    max_total: float = PHASE.max_total,
) -> DataFrame:
    """Rank the long blocks (primary, confidence, duration) and take what fits the budget, at most `max_count`.

    The rank is a sortable struct; selection goes in rounds (see `select_rounds`) and collects no group.
    `priority` is the dense rank, counted per chunk of the ranked order.
    """
    long_blocks = blocks.where(F.col("duration_seconds") >= minimum)
    ranked = long_blocks.withColumn(
        "rank", F.struct((~F.col("is_primary")).alias("a"), (-F.col("confidence")).alias("b"), (-F.col("duration_seconds")).alias("c"), F.col("number").alias("d"))
    )
    coarse = F.floor(F.col("rank.b") * 1000).cast("long") + F.when(F.col("is_primary"), F.lit(-10_000)).otherwise(F.lit(0))
    ranked = ordered_scan(ranked, keys, ["rank"], coarse, row_number="priority")
    state = {"taken_total": ("double", F.lit(0.0)), "taken_count": ("int", F.lit(0))}
    fits = lambda s, row: (s["taken_total"] + row["duration_seconds"] <= max_total) | (s["taken_count"] == 0)
    take = lambda s, row: {"taken_total": s["taken_total"] + row["duration_seconds"], "taken_count": s["taken_count"] + 1}
    chosen = select_rounds(ranked, keys, max_count, ["duration_seconds"], state, fits, take, "priority")
    return chosen.withColumn("selected", F.col("picked").isNotNull())


def state_durations(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Seconds per phase, one column each."""
    seconds = lambda p: F.sum(F.when(F.col("phase") == p, F.col("end") - F.col("start")).otherwise(0.0))
    names = {"waiting_or_music": "waiting_seconds", "talking": "talking_seconds", "gameplay": "gameplay_seconds", "unknown": "unknown_seconds"}
    return segments.groupBy(*keys).agg(*[seconds(p).alias(names[p]) for p in PHASES])


def layout_segments(
    samples: DataFrame, keys: Sequence[str] = KEYS, confirmation: int = LAYOUT.confirmation, interval: float = LAYOUT.sample_seconds,
    median_of: Sequence[str] = ("confidence",), labels: Sequence[str] = (),
) -> DataFrame:
    """Confirmed samples merged into segments; the phase of a segment is the one of its confirmed state. If `reasons` are among
    the merged labels, those of the confirmation join each sample's own."""
    samples = cut_lineage(samples)  # three steps look at them
    confirmed = hysteresis(samples, keys, confirmation=confirmation)
    if "reasons" in labels:
        confirmed = confirmed.withColumn("reasons", F.array_compact(F.concat("reasons", F.array("hysteresis_reason"))))
    phases = representatives(samples, keys).withColumnRenamed("layout_id", "accepted")
    merged = merge_state_runs(confirmed, durations_of(samples, keys, interval), keys, interval=interval, median_of=median_of, labels=labels)
    named = phases.withColumnRenamed("accepted", "layout_id").withColumnRenamed("phase", "state_phase")
    return cut_lineage(join_same(merged, named, [*keys, "layout_id"]).withColumn("phase", F.col("state_phase")).drop("state_phase"))


def layout_timeline(samples: DataFrame, keys: Sequence[str] = KEYS, confirmation: int = LAYOUT.confirmation, interval: float = LAYOUT.sample_seconds) -> DataFrame:
    """One row per recording: segment count, completeness and warnings."""
    segs = layout_segments(samples, keys, confirmation, interval, median_of=()).groupBy(*keys).agg(F.count(F.lit(1)).alias("segments"))
    facts = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("completed_samples"),
        F.bool_and(F.col("phase") == "unknown").alias("blank"),
        (F.max("frame_timestamp") + interval).alias("duration"),
    )
    total = F.greatest(F.lit(1), F.floor((F.col("duration") - 1e-6) / interval) + 1).cast("long")
    return join_same(facts, segs, keys, "left").select(
        *keys, F.coalesce("segments", F.lit(0)).alias("segments"), "completed_samples", total.alias("total_samples"),
        F.when(F.col("blank"), F.array(F.lit("layout_no_determinable_samples"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
