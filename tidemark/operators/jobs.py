"""Job tables: history, lookups, sweeps, upserts, cached results, missing work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunked import join_same
from tidemark.functions import scalar as sc


def latest_per_key(rows: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """The newest row per key as one map-side-combined `max_by`: a hot key sends one row per task, not all its rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*newest))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def latest_cached_result(jobs: DataFrame) -> DataFrame:
    """Newest completed job per content key; ties go to the larger id."""
    return latest_per_key(jobs.where("status = 'completed'"), ["cache_key"], [F.col("updated_at"), F.col("id")])


def sweep_interrupted(jobs: DataFrame, active: Sequence[str], now: Column | str) -> DataFrame:
    hit = F.col("status").isin(list(active))
    stamp = F.lit(now) if isinstance(now, str) else now
    return jobs.withColumns({
        "status": F.when(hit, "failed").otherwise(F.col("status")),
        "error_message": F.when(hit, "Processing was interrupted by a restart."),
        "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
    })


def upsert_rows(base: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], now: str, newest: Sequence[Column] = ()) -> DataFrame:
    """Insert new keys and overwrite the non-null fields of known ones; touched rows get a new time stamp.

    Several changes of one key become one first: of each field the value of the newest change that has one, by `newest`
    (the largest value where no order is given).
    """
    order = lambda f: F.struct(*newest, F.col(f))
    changes = changes.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order(f))).alias(f) for f in fields])
    merged = base.select(key, *fields, "updated_at").join(
        changes.select(key, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("touched")), key, "full"
    )
    return merged.select(
        key, *[F.coalesce(f"new_{f}", f).alias(f) for f in fields],
        F.when(F.col("touched"), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def guarded_delete(jobs: DataFrame, wanted: DataFrame, active: Sequence[str] = tuple(sc.UNDELETABLE)) -> tuple[DataFrame, DataFrame]:
    """Remaining jobs, and per requested id what happened."""
    status = jobs.select("id", "status")
    outcome = wanted.join(status, "id", "left").select(
        "id", F.when(F.col("status").isNull(), "not_found").when(F.col("status").isin(list(active)), "active").otherwise("deleted").alias("outcome")
    )
    return jobs.join(outcome.where("outcome = 'deleted'").select("id"), "id", "left_anti"), outcome


def missing_work(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_same(planned, done.select(*keys), keys, "left_anti")


def fill_missing(planned: DataFrame, done: DataFrame, keys: Sequence[str], defaults: dict[str, Column], warning: str) -> DataFrame:
    """Planned rows with their results; missing ones get defaults and a warning."""
    joined = join_same(planned, done.withColumn("__done", F.lit(True)), keys, "left")
    return joined.withColumns({
        **{name: F.coalesce(name, value) for name, value in defaults.items()},
        "warning": F.when(F.col("__done").isNull(), warning),
    }).drop("__done")


def preview_link_check(jobs: DataFrame) -> DataFrame:
    """Render jobs against the preview they name: must exist, be ready, and have the same source and interval."""
    source = jobs.select(
        F.col("id").alias("source_job_id"), F.col("status").alias("s_status"), F.col("source_url").alias("s_url"),
        F.col("start_seconds").alias("s_start"), F.col("end_seconds").alias("s_end"),
    )
    joined = jobs.where("source_job_id IS NOT NULL").join(source, "source_job_id", "left")
    same = (F.col("source_url") == F.col("s_url")) & (F.col("start_seconds") == F.col("s_start")) & (F.col("end_seconds") == F.col("s_end"))
    outcome = F.when(F.col("s_status").isNull(), "preview_not_found").when(
        ~F.col("s_status").isin("ready", "completed"), "preview_not_ready"
    ).when(~same, "preview_mismatch").otherwise("ok")
    return joined.select("id", "source_job_id", outcome.alias("outcome"))


def union_history(analyses: DataFrame, renders: DataFrame, strategy: str = "transcript_topics") -> DataFrame:
    """One list: the analyses of one strategy, then the render jobs."""
    left = analyses.where(F.col("phase_detection_strategy") == strategy).withColumns({"kind": F.lit("analysis"), "ord": F.lit(0)})
    right = renders.withColumns({"kind": F.lit("render"), "ord": F.lit(1)})
    return left.unionByName(right, allowMissingColumns=True)


def first_available(base: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Value per key from the first source that has one, with the source's name; `missing` when none has."""
    out = base
    for number, (_, source) in enumerate(sources):
        out = out.join(source.select(key, F.col(value).alias(f"__v{number}")), key, "left")
    tag = F.lit("missing")
    for number in reversed(range(len(sources))):
        tag = F.when(F.col(f"__v{number}").isNotNull(), sources[number][0]).otherwise(tag)
    picked = F.coalesce(*[F.col(f"__v{n}") for n in range(len(sources))])
    return out.withColumns({"artifact_source": tag, value: picked}).drop(*[f"__v{n}" for n in range(len(sources))])


def resolve_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """The requested profile, else the one whose normalised id equals the normalised uploader.

    The profile table is reduced to one row per identity first. Spark decides from its size whether to broadcast.
    """
    known = profiles.groupBy("profile_id").agg(F.lit(True).alias("known"))
    by_name = profiles.groupBy(sc.normalize_identity(F.col("profile_id")).alias("identity")).agg(F.min("profile_id").alias("matched"))
    asked = requests.withColumn("identity", sc.normalize_identity(F.col("uploader"))).join(
        known.withColumnRenamed("profile_id", "requested"), "requested", "left"
    ).join(by_name, "identity", "left")
    by_user = F.col("requested") != "auto"
    named = F.col("matched").isNotNull() & (F.col("identity") != "")
    return asked.select(
        *[c for c in requests.columns],
        F.when(by_user & F.col("known"), F.col("requested")).when(~by_user & named, F.col("matched")).alias("profile"),
        F.when(by_user, F.when(F.col("known"), "selected_by_user").otherwise("unknown_profile"))
        .when(named, "matched_vod_uploader").otherwise("no_profile_match").alias("reason"),
    )
