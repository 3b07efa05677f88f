"""Phase windows: explainable scores, minimum-cost smoothing, gap bridging, micro-segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import GAMEPLAY_WORDS, LAYOUT, PHASE, PHASES, TALKING_WORDS, PhaseConfig
from tidemark.operators.chunked import ROWS_PER_CHUNK, index_chunk, join_same, number_runs, ordered_scan
from tidemark.operators.stepwise import cheapest_path
from tidemark.operators.timeline import KEYS, representatives, robust_confidence
from tidemark.session import cut_lineage

MICRO = 1_000_000


def windows_from_layout(
    confirmed: DataFrame, samples: DataFrame, durations: DataFrame, keys: Sequence[str] = KEYS, interval: float = LAYOUT.sample_seconds
) -> DataFrame:
    """Confirmed layout samples as phase windows with one-hot scores of the raw phase."""
    phases = representatives(samples, keys).withColumnsRenamed({"layout_id": "accepted", "phase": "new_phase"})
    rows = join_same(join_same(confirmed, phases, [*keys, "accepted"]), durations, keys)
    scores = [F.when(F.col("phase") == p, F.col("confidence")).otherwise(0.0).alias(p) for p in PHASES]
    changed = F.when(F.col("accepted") != F.col("layout_id"), F.lit("layout_hysteresis"))
    return rows.select(
        *keys, "idx", F.col("frame_timestamp").alias("start"), F.least("duration", F.col("frame_timestamp") + interval).alias("end"),
        F.col("phase").alias("raw_phase"), F.col("new_phase").alias("phase"), *scores,
        F.array_compact(F.array(changed)).alias("smoothing_reasons"),
    )


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def _ratio(value: Column, threshold: float) -> Column:
    return _clamp(value / max(threshold, 1e-6))


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def classify_windows(windows: DataFrame, keys: Sequence[str] = KEYS, config: PhaseConfig = PHASE) -> DataFrame:
    """Scores, raw phase, confidence, reasons and warnings of every window from its audio, probe and visual structs.

    Optional columns `chapter_phase` and `chapter_reason` add the chapter hint.
    """
    w, c = config.weights, config
    for name in ("chapter_phase", "chapter_reason"):
        if name not in windows.columns:
            windows = windows.withColumn(name, F.lit(None).cast("string"))
    seen = F.coalesce(F.col("visual.sampled"), F.lit(False))
    tried = F.coalesce(F.col("probe.attempted"), F.lit(False))
    number = lambda name, default=0.0: F.coalesce(F.col(f"audio.{name}"), F.lit(default))
    probed = lambda name: F.when(tried, F.coalesce(F.col(f"probe.{name}"), F.lit(0.0))).otherwise(0.0)
    visual = lambda name: F.when(seen, F.coalesce(F.col(f"visual.{name}"), F.lit(0.0))).otherwise(0.0)
    base = windows.withColumns({
        "voice": number("voice_ratio"), "continuity": number("speech_continuity"), "silence": number("silence_ratio", 1.0),
        "dynamics": number("dynamic_range"), "music": number("energy_continuity"),
        "quality": probed("transcript_quality_score"), "words": probed("words_per_second"), "repetition": probed("repeated_text_ratio"),
        "spoken": F.coalesce(F.col("probe.language") == c.language, F.lit(False)), "said": F.lower(F.coalesce("probe.text", F.lit(""))),
        "motion": visual("motion_score"), "scene": visual("scene_change_score"),
        "hint": F.when(seen, F.col("visual.layout_hint")).otherwise("unknown"),
        "face": seen & F.coalesce(F.col("visual.face_present"), F.lit(False)),
        "no_audio": F.col("audio").isNull(), "no_visual": ~seen,
    })
    v = {n: F.col(n) for n in base.columns}
    says = lambda words: F.exists(F.array(*[F.lit(x) for x in words]), lambda x: F.contains(v["said"], x))
    game_words, talk_words = says(GAMEPLAY_WORDS), says(TALKING_WORDS)
    talking = (
        w["talking_voice"] * _ratio(v["voice"], c.talking_voice) + w["talking_continuity"] * _ratio(v["continuity"], c.talking_continuity)
        + w["talking_transcript"] * _ratio(v["quality"], c.talking_quality) + w["talking_words"] * _ratio(v["words"], c.talking_words)
        + w["talking_spanish"] * _flag(v["spoken"])
        + w["talking_face"] * _flag(v["face"] & v["hint"].isin("fullscreen_camera_hint", "facecam_overlay_hint"))
        + w["talking_low_motion"] * (1 - _ratio(v["motion"], c.gameplay_motion * 1.5)) - w["talking_repetition_penalty"] * v["repetition"]
        + 0.06 * _flag(talk_words) + 0.08 * _flag(F.coalesce(v["chapter_phase"] == "talking", F.lit(False)))
    )
    waiting = (
        w["waiting_low_voice"] * (1 - _ratio(v["voice"], c.waiting_voice)) + w["waiting_silence"] * v["silence"]
        + w["waiting_repetition"] * v["repetition"] + w["waiting_music"] * v["music"] * (1 - v["voice"] * 0.5)
        + w["waiting_no_face"] * _flag(~v["face"]) + w["waiting_stable_visual"] * (1 - _ratio(F.greatest(v["motion"], v["scene"]), c.gameplay_motion))
    )
    broken = _clamp((v["voice"] - v["continuity"]) * 2 + F.when((v["voice"] > 0.1) & (v["voice"] < 0.55), 0.35).otherwise(0.0))
    gameplay = (
        w["gameplay_motion"] * _ratio(v["motion"], c.gameplay_motion) + w["gameplay_scene"] * _ratio(v["scene"], c.gameplay_scene)
        + w["gameplay_overlay"] * _flag(v["hint"] == "facecam_overlay_hint") + w["gameplay_dynamics"] * _ratio(v["dynamics"], 0.18)
        + w["gameplay_fragmented_speech"] * broken + 0.10 * _flag(game_words) + 0.08 * _flag(F.coalesce(v["chapter_phase"] == "gameplay", F.lit(False)))
    )
    scored = base.withColumns({
        "waiting_or_music": F.round(_clamp(waiting), 9), "talking": F.round(_clamp(talking), 9), "gameplay": F.round(_clamp(gameplay), 9),
        "game_words": game_words, "talk_words": talk_words,
    })
    # The best three scores in falling order; rounding to nine digits keeps equal sums equal.
    top = F.sort_array(F.array("waiting_or_music", "talking", "gameplay"), asc=False)
    scored = scored.withColumns({"best": top[0], "margin": F.round(top[0] - top[1], 9)})
    missing = (_flag(F.col("no_audio")) + _flag(F.col("no_visual"))) / 2
    ambiguity = 1 - _clamp(F.col("margin") / max(c.min_margin, 0.01))
    winner = F.when(F.col("waiting_or_music") == F.col("best"), "waiting_or_music").when(F.col("talking") == F.col("best"), "talking").otherwise("gameplay")
    blind = F.col("no_audio") & F.col("no_visual")
    weak = (F.col("best") < c.min_confidence) | (F.col("margin") < c.min_margin)
    scored = scored.withColumn("unknown", F.round(_clamp(0.08 + 0.72 * missing + 0.35 * ambiguity), 9))
    scored = scored.withColumn("raw_phase", F.when(blind | weak, "unknown").otherwise(winner))
    reason = lambda condition, text: F.when(condition, F.lit(text))
    reasons = F.array_compact(F.array(
        reason(v["voice"] >= c.talking_voice, "high_voice_ratio"), reason(v["continuity"] >= c.talking_continuity, "continuous_speech"),
        reason(v["quality"] >= c.talking_quality, "high_transcript_quality"), reason(v["spoken"] & (v["quality"] > 0), "spanish_speech_probe"),
        reason(v["repetition"] >= 0.35, "repetitive_transcript"), reason(v["silence"] >= 0.75, "long_silence_ratio"),
        reason(v["face"] & (v["hint"] == "fullscreen_camera_hint"), "stable_large_face"),
        reason(v["hint"] == "facecam_overlay_hint", "overlay_facecam_layout"), reason(v["motion"] >= c.gameplay_motion, "high_motion"),
        reason(v["scene"] >= c.gameplay_scene, "high_scene_change"), reason(F.col("game_words"), "gameplay_language_hint"),
        reason(F.col("talk_words"), "conversation_language_hint"), F.col("chapter_reason"),
        F.when(blind, "insufficient_audio_and_visual_signals").when(weak, "contradictory_or_low_confidence_signals"),
    ))
    warnings = F.array_compact(F.array(
        reason(v["no_audio"], "audio_signals_unavailable"), reason(v["no_visual"], "visual_signals_unavailable")
    ))
    return scored.select(
        *keys, "idx", "start", "end", "raw_phase", F.when(F.col("raw_phase") == "unknown", F.col("unknown")).otherwise(F.col("best")).alias("raw_confidence"),
        *PHASES, reasons.alias("reasons"), warnings.alias("warnings"),
    )


# ---------------------------------------------------------------------------------------------------------
# Minimum-cost path. Costs are whole millionths, so that partial sums may be added in any grouping.


def _penalty_matrix(config: PhaseConfig) -> np.ndarray:
    p = config.penalties
    out = np.full((4, 4), round(p["common"] * MICRO), dtype=np.int64)
    for i, a in enumerate(PHASES):
        for j, b in enumerate(PHASES):
            if i == j:
                out[i, j] = round(p["same"] * MICRO)
            elif "unknown" in (a, b):
                out[i, j] = round(p["unknown"] * MICRO)
            elif (a, b) == ("waiting_or_music", "gameplay"):
                out[i, j] = round(p["waiting_gameplay"] * MICRO)
            elif (a, b) == ("gameplay", "waiting_or_music"):
                out[i, j] = round(p["gameplay_waiting"] * MICRO)
    return out


def smooth_phases(windows: DataFrame, keys: Sequence[str] = KEYS, config: PhaseConfig = PHASE, rows: int = 512, fan: int = 1024) -> DataFrame:
    """Cheapest phase path through a recording. Adds `phase`, `confidence` and `smoothing_reasons`.

    Positions `idx` count from 0. A recording is walked in pieces of `rows` windows (see `cheapest_path`)."""
    cost = [F.round((1 - F.col(p)) * MICRO).cast("long") for p in PHASES]
    paths = cheapest_path(windows, keys, cost, _penalty_matrix(config), size=rows, fan=fan)
    joined = join_same(windows, paths, [*keys, "idx"])
    joined = joined.withColumn("phase", F.element_at(F.array(*map(F.lit, PHASES)), (F.col("choice") + 1).cast("int"))).drop("choice")
    score = F.coalesce(*[F.when(F.col("phase") == p, F.col(p)) for p in PHASES])
    moved = F.col("phase") != F.col("raw_phase")
    return joined.withColumns({
        "confidence": _clamp((F.col("raw_confidence") + score) / 2),
        "smoothing_reasons": F.array_compact(F.array(
            F.when(moved, "temporal_viterbi_smoothing"), F.when(moved & (F.col("raw_phase") == "unknown"), "smoothed_short_unknown_gap"))),
    })


def _local_runs(windows: DataFrame, keys: Sequence[str], size: int, gap: bool = False) -> DataFrame:
    """Number the runs of equal `phase` inside every chunk of `size` windows: `__g` is key and chunk, `__piece` counts from 0.

    With `gap`, a hole in time ends a run too. A piece is the part of a run that lies in one chunk; steps that look at runs
    number the pieces across chunks (`number_runs`), so that the windows themselves meet no summary of their chunk."""
    local = Window.partitionBy("__g").orderBy("idx")
    changed = ~F.lag("phase").over(local).eqNullSafe(F.col("phase"))
    if gap:
        changed = changed | F.coalesce(F.abs(F.lag("end").over(local) - F.col("start")) > 0.01, F.lit(False))
    rows = windows.withColumn("__g", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], index_chunk("idx", size).alias("c")))
    rows = rows.withColumn("__new", F.when(F.row_number().over(local) > 1, changed.cast("long")).otherwise(0))
    return rows.withColumn("__piece", F.sum("__new").over(local)).drop("__new")


def _keys_of_chunk(keys: Sequence[str]) -> list[Column]:
    return [F.col("__g")[f"k{i}"].alias(k) for i, k in enumerate(keys)]


def _attach(rows: DataFrame, pieces: DataFrame, *columns: str) -> DataFrame:
    """Bring columns of pieces (`chunk`, `piece`) back to their windows."""
    there = pieces.select(F.col("chunk").alias("__g"), F.col("piece").alias("__piece"), *columns)
    return rows.join(there, ["__g", "__piece"]).drop("__g", "__piece")


def bridge_unknown_gaps(windows: DataFrame, keys: Sequence[str] = KEYS, radius: int = PHASE.radius, size: int = ROWS_PER_CHUNK) -> DataFrame:
    """Unknown windows between two equal phases take that phase, from left to right.

    For an unknown run between equal phases, the last `radius` windows see the phase on their right, and the first
    of those is reached from the left only if it lies within `radius` of the run's start; from there every later
    window follows. So the outcome depends on the run's bounds alone, and no window waits for another.
    """
    rows = cut_lineage(_local_runs(windows, keys, size))
    pieces = rows.groupBy("__g", "__piece").agg(F.min("phase").alias("phase"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    pieces = number_runs(pieces.select(*_keys_of_chunk(keys), F.col("__g").alias("chunk"), F.col("__piece").alias("piece"), "phase", "first", "last"),
                         keys, ["first"], index_chunk("first"), "phase")
    pieces = cut_lineage(pieces)
    runs = pieces.groupBy(*keys, "run").agg(F.min("phase").alias("run_phase"), F.min("first").alias("run_a"), F.max("last").alias("run_b"))
    runs = ordered_scan(runs, keys, ["run"], index_chunk("run"), lag={"left_phase": F.col("run_phase")}, lead={"right_phase": F.col("run_phase")})
    first = F.greatest(F.col("run_a"), F.col("run_b") + 1 - radius)
    bridged = (F.col("run_phase") == "unknown") & (F.col("left_phase") == F.col("right_phase")) & (first - F.col("run_a") + 1 <= radius)
    per_run = runs.select(*keys, "run", F.when(bridged, first).alias("bridge_from"), F.col("left_phase").alias("bridge_phase"))
    joined = _attach(rows, join_same(pieces, per_run, [*keys, "run"]), "bridge_from", "bridge_phase")
    hit = F.coalesce(F.col("idx") >= F.col("bridge_from"), F.lit(False))
    score = F.coalesce(*[F.when(F.col("bridge_phase") == p, F.col(p)) for p in PHASES])
    return joined.withColumns({
        "confidence": F.when(hit, score).otherwise(F.col("confidence")),
        "smoothing_reasons": F.when(hit, F.array_append("smoothing_reasons", F.lit("smoothed_short_unknown_gap"))).otherwise(F.col("smoothing_reasons")),
        "phase": F.when(hit, F.col("bridge_phase")).otherwise(F.col("phase")),
    }).drop("bridge_from", "bridge_phase")


def _trimmed(values: Column) -> Column:
    """`robust_confidence` of a sorted array. Equal values enter the mean as value times count, as they do there."""
    n = F.size(values)
    low = F.floor(n / 10).cast("int")
    span = n - 2 * low
    kept = F.slice(values, low + 1, F.greatest(span, F.lit(0)))
    at = lambda i: F.get(kept, F.floor(i).cast("int"))
    state = lambda total, value, count: F.struct(total.alias("total"), value.alias("value"), count.alias("count"))
    closed = lambda s: s["total"] + F.coalesce(s["value"] * s["count"], F.lit(0.0))
    mean = F.aggregate(
        kept, state(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0)),
        lambda s, x: F.when(s["value"] == x, state(s["total"], s["value"], s["count"] + 1.0)).otherwise(state(closed(s), x, F.lit(1.0))),
        lambda s: closed(s) / span,
    )
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (at((span - 1) / 2) + at(span / 2)) / 2 * 0.6 + mean * 0.4))
    return F.when(n > 0, score)


def _pieces(rows: DataFrame, keys: Sequence[str], labels: dict[str, Column] | None = None) -> DataFrame:
    """One row per piece of `_local_runs`, with the run it belongs to. The windows of a piece meet in one array, which gives its
    bounds, sorted confidences (`values`) and, for the array columns `labels`, the distinct entries as they first occur."""
    labels = labels or {}
    empty = F.array().cast("array<string>")
    lively = F.array_contains("reasons", "high_motion") | F.array_contains("reasons", "high_scene_change")
    item = F.struct("idx", "start", "end", F.col("confidence").cast("double").alias("confidence"), *[F.coalesce(c, empty).alias(n) for n, c in labels.items()])
    slim = rows.select("__g", "__piece", "phase", lively.alias("lively"), item.alias("item"))
    pieces = slim.groupBy("__g", "__piece").agg(F.sort_array(F.collect_list("item")).alias("items"), F.min("phase").alias("phase"), F.bool_or("lively").alias("lively"))
    items = F.col("items")
    pieces = cut_lineage(pieces.select(
        *_keys_of_chunk(keys), F.col("__g").alias("chunk"), F.col("__piece").alias("piece"), "phase", "lively", items[0]["idx"].alias("first"),
        items[0]["start"].alias("start"), F.element_at(items, -1)["end"].alias("end"), F.size(items).cast("long").alias("window_count"),
        F.sort_array(F.filter(items["confidence"], lambda x: x.isNotNull())).alias("values"),
        *[F.array_distinct(F.flatten(items[n])).alias(n) for n in labels],
    ))
    gap = lambda a, b: F.abs(a["end"] - b["start"]) > 0.01
    return cut_lineage(number_runs(pieces, keys, ["first"], index_chunk("first"), "phase", edge=("start", "end"), gap=gap))


def _segments(pieces: DataFrame, keys: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """One row per run. Only a run that spans chunks has its confidence computed from ranks over all its windows."""
    run = [*keys, "run"]
    at = lambda n: F.struct("first", F.col(n).alias("v"))
    merged = pieces.withColumn("confidence", _trimmed(F.col("values"))).groupBy(*run).agg(
        F.min(at("start"))["v"].alias("start"), F.max(at("end"))["v"].alias("end"), F.min("phase").alias("phase"), F.sum("window_count").alias("window_count"),
        F.bool_or("lively").alias("lively"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("pieces"),
        *[F.array_distinct(F.flatten(F.sort_array(F.collect_list(at(n)))["v"])).alias(n) for n in labels],
    )
    merged = cut_lineage(merged)
    long = merged.where("pieces > 1")
    if not long.isEmpty():
        values = join_same(pieces, long.select(*run), run).select(*run, F.explode("values").alias("value"))
        ranked = cut_lineage(robust_confidence(values, run, "value"))
        merged = join_same(merged, ranked, run, "left").withColumn("confidence", F.coalesce("robust_confidence", "confidence"))
    return merged.where(F.col("confidence").isNotNull()).select(*run, "start", "end", "phase", "window_count", "lively", "confidence", *labels)


def merge_phase_runs(windows: DataFrame, keys: Sequence[str] = KEYS, labels: bool = True, size: int = ROWS_PER_CHUNK) -> DataFrame:
    """Neighbouring windows of one phase become a segment; a hole in time also ends it."""
    named = {"reasons": F.concat("reasons", "smoothing_reasons"), "warnings": F.col("warnings")} if labels else {}
    return _segments(_pieces(_local_runs(windows, keys, size, gap=True), keys, named), keys, list(named))


def absorb_microsegments(windows: DataFrame, keys: Sequence[str] = KEYS, config: PhaseConfig = PHASE, size: int = ROWS_PER_CHUNK) -> DataFrame:
    """Short inner segments without a strong transition take the phase around them. One pass over fixed segments."""
    rows = cut_lineage(_local_runs(windows, keys, size, gap=True))
    pieces = _pieces(rows, keys)
    near = ordered_scan(_segments(pieces, keys), keys, ["run"], index_chunk("run"), lag={"left_phase": F.col("phase")}, lead={"right_phase": F.col("phase")})
    weak = F.col("confidence") < 0.55
    limit = F.when((F.col("phase") == "waiting_or_music") & weak, max(config.microsegment_max, config.waiting_min_segment)).when(
        (F.col("phase") == "gameplay") & weak, max(config.microsegment_max, config.gameplay_min_segment)
    ).otherwise(config.microsegment_max)
    absorbed = (
        (F.col("end") - F.col("start") <= limit) & (F.col("left_phase") == F.col("right_phase")) & (F.col("confidence") < 0.72) & ~F.col("lively")
    )
    per_run = near.select(*keys, "run", F.when(absorbed, F.col("left_phase")).alias("absorb_phase"))
    joined = _attach(rows, join_same(pieces, per_run, [*keys, "run"]), "absorb_phase")
    hit = F.col("absorb_phase").isNotNull()
    score = F.coalesce(*[F.when(F.col("absorb_phase") == p, F.col(p)) for p in PHASES])
    return joined.withColumns({
        "confidence": F.when(hit, score).otherwise(F.col("confidence")),
        "smoothing_reasons": F.when(hit, F.array_append("smoothing_reasons", F.lit("merged_low_confidence_transition"))).otherwise(F.col("smoothing_reasons")),
        "phase": F.when(hit, F.col("absorb_phase")).otherwise(F.col("phase")),
    }).drop("absorb_phase")


def phase_timeline(windows: DataFrame, keys: Sequence[str] = KEYS, config: PhaseConfig = PHASE) -> DataFrame:
    """Classify, smooth, bridge, absorb and merge: the phase segments of every recording."""
    raw = cut_lineage(classify_windows(windows, keys, config))
    smoothed = bridge_unknown_gaps(smooth_phases(raw, keys, config), keys, config.radius)
    return merge_phase_runs(absorb_microsegments(smoothed, keys, config), keys)
