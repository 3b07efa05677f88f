"""Sources: transcript chunks, guarded timelines, metadata, profiles. Schemas are given, never inferred."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.chunked import join_same
from tidemark.operators.rules import failed_rules
from tidemark.sources.pcm import read_pcm_samples  # noqa: F401  readers of all kinds are found here

WORD = "struct<start:double,end:double,word:string,probability:double>"
SEGMENT = f"struct<start:double,end:double,text:string,words:array<{WORD}>,avg_logprob:double,no_speech_probability:double>"
CHUNK = f"vod_id string, index int, start double, end double, language string, segments array<{SEGMENT}>"
BOX = "struct<x:int,y:int,width:int,height:int>"
REGION_PROFILE = (
    "id string, display_name string, version int, source_resolution struct<width:int,height:int>, "
    f"layouts array<struct<id:string,type:string,position:string,facecam_region:{BOX},content_region_of_interest:{BOX}>>, vertical struct<layout:string,facecam_height_ratio:double>"
)
FORMAT = "struct<format_id:string,ext:string,protocol:string,acodec:string,vcodec:string,abr:double,vbr:double,tbr:double,width:int,height:int,fps:double>"
METADATA = (
    "id string, title string, extractor string, extractor_key string, uploader string, channel string, duration double, webpage_url string, original_url string, "
    f"availability string, chapters array<struct<start_time:double,end_time:double,title:string>>, formats array<{FORMAT}>"
)
# Places that a region profile may name.
POSITIONS = [
    "top_left", "top_right", "bottom_left", "bottom_right", "left", "right", "center", "left_center", "right_center", "left_column", "right_column", "unknown",
]


def transcript_segments(chunks: DataFrame) -> DataFrame:
    return chunks.select("vod_id", F.col("index").alias("chunk_index"), "language", F.inline("segments"))


def read_transcript_chunks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Segments of chunk documents, one per file, or one per line with `lines`."""
    return transcript_segments(spark.read.schema(CHUNK).option("multiLine", not lines).json(path))


def segment_words(segments: DataFrame, keys: Sequence[str] = ("vod_id",)) -> DataFrame:
    return segments.select(*keys, F.inline("words"))


def read_guarded(spark: SparkSession, path: str, schema: str, cache_key: Column | str, lines: bool = False) -> DataFrame:
    """Timelines with the expected fingerprint. A file is one document, indented or not, or one document per line with `lines`;
    a file that does not parse is left out as a whole."""
    typed = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt", T.StringType())])
    reader = spark.read.schema(typed).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", not lines)
    rows = reader.json(path).withColumn("_file", F.col("_metadata.file_path"))
    broken = rows.where("_corrupt IS NOT NULL OR cache_key IS NULL").select("_file").distinct()  # nor can a document without a key be the expected one
    wanted = F.lit(cache_key) if isinstance(cache_key, str) else cache_key
    return rows.join(broken, "_file", "left_anti").where(F.col("cache_key") == wanted).select(*[f.name for f in typed.fields[:-1]])


def vod_metadata(raw: DataFrame, platform: Column) -> tuple[DataFrame, DataFrame]:
    """Metadata rows with defaults and whitelisted formats, and rejected rows with the reason."""
    heard = F.filter(F.coalesce("formats", F.array().cast(f"array<{FORMAT}>")), lambda f: F.coalesce(f["acodec"], F.lit("none")) != "none")
    shown = F.filter(F.coalesce("formats", F.array().cast(f"array<{FORMAT}>")), lambda f: F.coalesce(f["vcodec"], F.lit("none")) != "none")
    reason = F.when(~F.coalesce(F.col("duration") > 0, F.lit(False)), "duration_missing_or_invalid").when(F.size(heard) == 0, "no_audio_stream")
    rows = raw.select(
        platform.alias("platform"), F.coalesce("extractor", "extractor_key", platform).alias("extractor"), F.col("id").alias("vod_id"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled VOD")).alias("title"), "uploader", "channel", F.col("duration").alias("duration_seconds"), "chapters",
        F.coalesce("webpage_url", "original_url").alias("original_url"), "availability", heard.alias("audio_formats"), shown.alias("video_formats"), reason.alias("reason"))
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL").select("vod_id", "reason")


def profile_rules() -> dict[str, Column]:
    """Validity of region profiles."""
    size = F.col("source_resolution")
    inside = lambda b: (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] > 0) & (b["height"] > 0) & (b["x"] + b["width"] <= size["width"]) & (b["y"] + b["height"] <= size["height"])
    return {
        "version": F.coalesce(F.col("version") == 1, F.lit(False)), "safe_id": F.coalesce(F.col("id").rlike("^[a-z0-9][a-z0-9_-]{0,63}$"), F.lit(False)),
        "source_resolution": F.coalesce((size["width"] > 0) & (size["height"] > 0), F.lit(False)),
        "layout_type": F.forall("layouts", lambda l: l["type"].isin("small_facecam", "side_facecam", "fullscreen_face") & F.coalesce(l["position"], F.lit("unknown")).isin(POSITIONS)),
        "layout_ids": F.size(F.array_distinct(F.transform("layouts", lambda l: l["id"]))) == F.size("layouts"),
        "facecam_region": F.forall("layouts", lambda l: F.coalesce(inside(l["facecam_region"]), F.lit(False))),
        "content_region": F.forall("layouts", lambda l: l["content_region_of_interest"].isNull() | F.coalesce(inside(l["content_region_of_interest"]), F.lit(False))),
        "facecam_height_ratio": F.coalesce(F.col("vertical.facecam_height_ratio"), F.lit(0.38)).between(0.25, 0.55),
    }


def read_profiles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Valid region profiles of a folder, one JSON document per file, or per line with `lines`."""
    rows = spark.read.schema(REGION_PROFILE).option("multiLine", not lines).json(path)
    return rows.where(F.size(failed_rules(profile_rules())) == 0).withColumn("display_name", F.coalesce("display_name", "id"))


def profile_summary(profiles: DataFrame) -> DataFrame:
    """Id, version, enabled layouts and fingerprint. `layouts` needs `id` and `enabled`."""
    enabled = F.filter("layouts", lambda l: F.coalesce(l["enabled"], F.lit(True)))
    return profiles.select("id", "version", F.transform(enabled, lambda l: l["id"]).alias("enabled_layouts"), F.sha2(F.to_json(F.struct(*profiles.columns)), 256).alias("fingerprint"))


def embed_texts(texts: DataFrame, keys: Sequence[str], text: str, make_encoder: Callable[[], Callable] | None, requested: str, fallback: DataFrame) -> DataFrame:
    """Embeddings of a caller's encoder with truthful backend columns.

    `make_encoder()` is called once per task and returns `encode(list of texts) -> list of vectors`. If it cannot be
    made on the driver, the hashed embedding in `fallback` (`keys`, `embedding`) is used and the reason recorded.
    """
    reason = "no encoder given"
    if make_encoder is not None:
        try:
            make_encoder()
            reason = None
        except (ImportError, OSError, RuntimeError, ValueError) as exc:
            reason = f"{type(exc).__name__}: {str(exc)[:200]}"
    note = {"requested_backend": F.lit(requested), "effective_backend": F.lit(requested if reason is None else "hash-fallback"), "fallback_used": F.lit(reason is not None), "fallback_reason": F.lit(reason).cast("string")}
    if reason is not None:
        return join_same(texts.select(*keys), fallback, keys).withColumns(note)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            vectors = np.asarray(encoder(batch[text].tolist()), dtype=np.float64)
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.divide(vectors, lengths, out=vectors.copy(), where=lengths > 0)
            yield batch[list(keys)].assign(embedding=list(unit))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema.fields)
    return texts.select(*keys, text).mapInPandas(encode, f"{fields}, embedding array<double>").withColumns(note)


SEGMENTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_segmenter(name: str, segment: Callable[[DataFrame], DataFrame]) -> None:
    """Make a topic segmenter (segments in, topics out) available by name."""
    SEGMENTERS[name] = segment


def segment_topics(name: str, segments: DataFrame) -> DataFrame:
    from tidemark.operators.transcripts import topics

    SEGMENTERS.setdefault("default", topics)
    if name not in SEGMENTERS:
        raise ValueError(f"no segmenter {name!r}; known: {', '.join(sorted(SEGMENTERS))}")
    return SEGMENTERS[name](segments)


class StageCounts:
    """Row counts and the smallest and largest value of one column of every stage of a pipeline, taken while it runs."""

    def __init__(self) -> None:
        self.watched: list[tuple[str, Observation]] = []

    def watch(self, stage: str, df: DataFrame, order: str | None = None) -> DataFrame:
        """`df`, counted as `stage` by whatever action reads it first."""
        seen = Observation(f"{stage}-{uuid.uuid4().hex}")
        self.watched.append((stage, seen))
        bounds = [F.min(order).cast("double").alias("least"), F.max(order).cast("double").alias("most")] if order else []
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *bounds)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per stage, once the pipeline has run: (stage, place, rows, least, most)."""
        found = [(stage, place, seen.get["rows"], seen.get.get("least"), seen.get.get("most")) for place, (stage, seen) in enumerate(self.watched)]
        return spark.createDataFrame(found, "stage string, place int, rows long, least double, most double")
