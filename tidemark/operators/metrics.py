"""Detected boundaries against notes, metrics, report lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunked import join_same
from tidemark.functions.scalar import format_timecode

NOTES = [
    "talking_start", "talking_end", "gameplay_start", "gameplay_end", "talking_block_2_start", "talking_block_2_end", "talking_block_3_start", "talking_block_3_end",
]


def detector_boundaries(segments: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("vod_id",)) -> DataFrame:
    """The eight named boundaries of a timeline in long form. `blocks` has `number` and `is_primary`."""
    at = lambda n, c: F.max(F.when(F.col("number") == n, F.col(c)))
    first = lambda c: F.coalesce(F.max(F.when(F.col("is_primary"), F.col(c))), at(1, c))
    talk = blocks.groupBy(*keys).agg(
        first("start").alias("talking_start"), first("end").alias("talking_end"), at(2, "start").alias("talking_block_2_start"),
        at(2, "end").alias("talking_block_2_end"), at(3, "start").alias("talking_block_3_start"), at(3, "end").alias("talking_block_3_end"))
    game = segments.where("phase = 'gameplay'").groupBy(*keys).agg(F.min("start").alias("gameplay_start"), F.min_by("end", "start").alias("gameplay_end"))
    wide = join_same(join_same(segments.select(*keys).distinct(), talk, keys, "left"), game, keys, "left")
    return wide.unpivot(list(keys), NOTES, "transition", "detector_seconds")


def compare_notes(boundaries: DataFrame, notes: DataFrame, keys: Sequence[str] = ("vod_id",)) -> DataFrame:
    """Errors of the detector for every note that was taken. `notes` has one column per boundary."""
    taken = notes.unpivot(list(keys), NOTES, "transition", "actual_seconds").where("actual_seconds IS NOT NULL")
    error = F.col("detector_seconds") - F.col("actual_seconds")
    return join_same(taken, boundaries, [*keys, "transition"], "left").select(
        *keys, "transition", "detector_seconds", "actual_seconds", error.alias("error_seconds"), F.abs(error).alias("absolute_error_seconds"))


def segment_metrics(segments: DataFrame, comparisons: DataFrame, keys: Sequence[str] = ("vod_id",)) -> DataFrame:
    """Errors, omissions, false detections and duration-weighted confidence per recording."""
    length = F.col("end") - F.col("start")
    facts = segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detected_phase_count"), F.count_if(F.col("phase") == "talking").alias("talk"), F.count_if(F.col("phase") == "gameplay").alias("game"),
        F.coalesce(F.try_divide(F.sum(length * F.col("confidence")), F.sum(length)), F.lit(0.0)).alias("mean_confidence"))
    noted = lambda *names: F.count_if(F.col("transition").isin(*names))
    errors = comparisons.groupBy(*keys).agg(
        F.avg("absolute_error_seconds").alias("mean_absolute_error_seconds"), F.max("absolute_error_seconds").alias("maximum_absolute_error_seconds"),
        F.count_if(F.col("detector_seconds").isNull()).alias("omitted"), noted("talking_start", "talking_block_2_start", "talking_block_3_start").alias("noted_talk"),
        noted("gameplay_start").alias("noted_game"),
        # At most eight transitions exist, so the map is small.
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("error_seconds").isNotNull(), F.struct("transition", "error_seconds"))))).alias("error_by_transition"))
    over = lambda found, noted_: F.when(F.coalesce(noted_, F.lit(0)) > 0, F.greatest(F.lit(0), found - noted_)).otherwise(0)
    return join_same(facts, errors, keys, "left").select(
        *keys, "mean_absolute_error_seconds", "maximum_absolute_error_seconds", "error_by_transition", "detected_phase_count",
        F.coalesce("omitted", F.lit(0)).alias("omitted_phase_count"),
        (over(F.col("talk"), F.col("noted_talk")) + over(F.col("game"), F.col("noted_game"))).cast("long").alias("false_detection_count"), "mean_confidence")


def _listed(column: str) -> Column:
    text = F.array_join(column, ", ")
    return F.when(text == "", "none").otherwise(text)


def fixed(value: Column, places: int) -> Column:
    """A number with so many places, ties of its exact value to even; `format_string` would round the shortest decimal up."""
    return F.replace(F.format_number(value, places), F.lit(","))


def report_lines(
    facts: DataFrame, segments: DataFrame, comparisons: DataFrame, metrics: DataFrame, layouts: DataFrame | None = None, keys: Sequence[str] = ("vod_id",)
) -> DataFrame:
    """Markdown report as ordered rows (`section`, `ord`, `line`); a writer sorts them, no report is built in one place.

    `facts` has one row per recording: `pipeline_version`, `strategy`, `requires_coarse`, `title`, `completed_samples` (null
    for recordings analysed without layouts), `analyzed_duration`, the seconds per phase, `talking_blocks`,
    `primary_talking_block_id`, `warnings`, `analysis_seconds`, and the texts `thresholds` and `notes`. `segments` have `run`,
    times, `phase`, `confidence`, `reasons` and `warnings`; `layouts` the three scores of each matched layout.
    """
    clock = lambda c: format_timecode(F.col(c), "even")
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    bullets = lambda items: [F.concat(F.lit(f"- {name}: "), value) for name, value in items]
    block = lambda title: F.array(F.lit(""), F.lit(f"## {title}"), F.lit(""))
    whole = join_same(facts, metrics, keys, "left")

    def lines(df: DataFrame, section: int, array: Column) -> DataFrame:
        return df.select(*keys, F.lit(section).alias("section"), F.posexplode(array).alias("ord", "line"))

    head = F.array(F.lit("# Validation report"), F.lit(""), *bullets((
        ("Pipeline version", code(F.col("pipeline_version"))), ("Detection strategy", code(F.col("strategy"))), ("Requires coarse timeline", code(F.initcap(F.col("requires_coarse").cast("string")))),
        ("Source", F.col("title")), ("Layout samples", F.coalesce(F.col("completed_samples").cast("string"), F.lit("legacy unavailable"))), ("Analyzed duration", clock("analyzed_duration")),
        ("Waiting detected", clock("waiting_seconds")), ("Talking detected", clock("talking_seconds")), ("Gameplay detected", clock("gameplay_seconds")), ("Unknown", clock("unknown_seconds")),
        ("Talking blocks", F.col("talking_blocks").cast("string")), ("Primary block", F.coalesce("primary_talking_block_id", F.lit("none"))), ("Warnings", _listed("warnings")),
        ("Mean confidence", fixed(F.coalesce("mean_confidence", F.lit(0.0)), 3)), ("Analysis time", F.concat(fixed(F.greatest(F.lit(0.0), F.coalesce("analysis_seconds", F.lit(0.0))), 2), F.lit(" seconds"))))))
    fence = lambda text: F.concat(F.array(F.lit("```json")), F.split(F.coalesce(text, F.lit("null")), "\n"), F.array(F.lit("```")))
    parts = [lines(whole, 0, F.concat(head, block("Thresholds used"), fence(F.col("thresholds")), block("Detected segments")))]
    span = [F.lit("- "), clock("start"), F.lit("–"), clock("end"), F.lit(" ")]
    parts.append(segments.select(*keys, F.lit(1).alias("section"), F.col("run").cast("int").alias("ord"), F.concat(
        *span, F.col("phase"), F.lit(", confidence "), fixed(F.col("confidence"), 3), F.lit("; reasons: "), _listed("reasons"), F.lit("; warnings: "), _listed("warnings")).alias("line")))
    if layouts is not None:
        parts.append(lines(facts.where("completed_samples IS NOT NULL"), 2, block("Matched layouts")))
        parts.append(layouts.select(*keys, F.lit(2).alias("section"), (F.col("run") + 3).cast("int").alias("ord"), F.concat(
            *span, code(F.col("layout_id")), F.lit(": match "), fixed(F.col("match_score"), 3), F.lit(", second "), fixed(F.col("second_best_score"), 3), F.lit(", margin "), fixed(F.col("score_margin"), 3)).alias("line")))
    number = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(NOTES) for x in (n, i)]), F.col("transition"))
    detected = F.when(F.col("detector_seconds").isNull(), "missing").otherwise(clock("detector_seconds"))
    error = F.when(F.col("error_seconds").isNull(), "n/a").otherwise(F.concat(F.when(F.col("error_seconds") >= 0, "+").otherwise(""), fixed(F.col("error_seconds"), 1), F.lit(" seconds")))
    noted = join_same(facts.select(*keys), comparisons.groupBy(*keys).agg(F.count(F.lit(1)).alias("noted")), keys, "left")
    none = F.when(F.col("noted").isNull(), F.array(F.lit("No validation notes supplied."))).otherwise(F.array().cast("array<string>"))
    parts.append(lines(noted, 3, F.concat(block("Manual comparison"), none)))
    parts.append(comparisons.select(*keys, F.lit(3).alias("section"), (number + 3).alias("ord"), F.concat(
        F.lit("- "), F.col("transition"), F.lit(": detector "), detected, F.lit("; actual "), clock("actual_seconds"), F.lit("; error "), error).alias("line")))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    tail = F.array(*bullets((
        ("Mean absolute error", shown("mean_absolute_error_seconds")), ("Maximum absolute error", shown("maximum_absolute_error_seconds")), ("Detected phases", shown("detected_phase_count")),
        ("Omitted phases", shown("omitted_phase_count")), ("False detections", shown("false_detection_count")))))
    parts.append(lines(whole, 4, F.concat(block("Metrics"), tail, block("Validation notes JSON"), fence(F.col("notes")), F.array(F.lit("")))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
