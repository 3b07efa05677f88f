"""Sinks: timelines, subtitles, reports, candidate artifacts. The commit protocol makes each write atomic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import format_subtitle_time, wrap_caption

# The subtitle file's style table.
STYLE_FORMAT = (
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, "
    "ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
EVENT_FORMAT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def write_timeline(df: DataFrame, path: str, keys: Sequence[str] = ("bucket",), fmt: str = "parquet") -> None:
    """Overwrite only the partitions that occur in `df` (dynamic partition overwrite); the commit is atomic per write."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(fmt).save(path)


def with_bucket(df: DataFrame, key: str = "vod_id", buckets: int = 256) -> DataFrame:
    """Partition column for timelines: a hash bucket keeps the number of folders fixed however many recordings there are."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def subtitle_lines(captions: DataFrame, keys: Sequence[str] = ("clip_id",), vertical: bool = True, width: int | None = None, height: int | None = None) -> DataFrame:
    """Lines of one subtitle file per clip: `keys`, `ord`, `value`."""
    w, h = width or (1080 if vertical else 1280), height or (1920 if vertical else 720)
    size, margin = (88, 240) if vertical else (42, 70)
    head = [
        "[Script Info]", "ScriptType: v4.00+", f"PlayResX: {w}", f"PlayResY: {h}", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]", STYLE_FORMAT,
        f"Style: Shorts,DejaVu Sans,{size},&H00FFFFFF,&H00FFFFFF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,5,2,2,45,45,{margin},1", "", "[Events]", EVENT_FORMAT,
    ]
    header = captions.select(*keys).distinct().select(*keys, F.posexplode(F.array(*[F.lit(x) for x in head])).alias("p", "value")).select(
        *keys, F.struct((F.col("p") - len(head)).cast("double").alias("a"), F.lit(0.0).alias("b")).alias("ord"), "value")
    line = F.concat(F.lit("Dialogue: 0,"), format_subtitle_time(F.col("start")), F.lit(","), format_subtitle_time(F.col("end")), F.lit(",Shorts,,0,0,0,,"), wrap_caption(F.col("text")))
    body = captions.where("end > start").select(*keys, F.struct(F.col("start").alias("a"), F.col("end").alias("b")).alias("ord"), line.alias("value"))
    return header.unionByName(body)


def write_subtitles(lines: DataFrame, path: str, key: str = "clip_id") -> None:
    """One folder per clip with its lines in order. Range partitioning by clip and line keeps a long clip in several
    consecutive files instead of one task."""
    ordered = lines.repartitionByRange(F.col(key), F.col("ord")).sortWithinPartitions(key, "ord")
    ordered.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def write_candidate_artifacts(accepted: DataFrame, rejected: DataFrame, path: str, keys: Sequence[str] = ("vod_id",)) -> None:
    accepted.write.mode("overwrite").json(f"{path}/candidates")
    rejected.write.mode("overwrite").json(f"{path}/rejected_candidates")
    accepted.select(*keys, "id", "score", "penalties").write.mode("overwrite").json(f"{path}/score_breakdown")


def write_debug_extracts(raw: DataFrame, smoothed: DataFrame, graph: DataFrame, path: str) -> None:
    raw.write.mode("overwrite").json(f"{path}/raw_phase_scores")
    smoothed.write.mode("overwrite").json(f"{path}/smoothed_windows")
    graph.write.mode("overwrite").json(f"{path}/transition_graph")


def assemble_results(segments: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("vod_id",)) -> DataFrame:
    """One nested row per recording. The nested form is the result document of a recording, whose size the number of
    its segments bounds; samples and windows stay in their own tables."""
    timeline = segments.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("run", "start", "end", "phase", "confidence"))).alias("timeline"))
    talk = blocks.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("number", "id", "start", "end", "relevance"))).alias("talking_blocks"),
        F.max(F.when(F.col("is_primary"), F.col("id"))).alias("primary_talking_block_id"))
    warn = F.array_compact(F.array(F.when(F.col("primary_talking_block_id").isNull(), "primary_talking_block_not_found")))
    return timeline.join(talk, list(keys), "left").withColumn("warnings", warn).withColumn("talking_blocks", F.when(F.col("talking_blocks").isNull(), F.array().cast(talk.schema["talking_blocks"].dataType)).otherwise(F.col("talking_blocks")))
