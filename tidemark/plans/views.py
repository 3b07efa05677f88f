"""Engine inputs derived from the given tables, once as DataFrames and once as SQL for checking.

`VIEWS_SQL` uses plain whole-key windows; the DataFrame side numbers rows with chunked scans, so a single user
or order may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.chunked import index_chunk, ordered_scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, as it is split into files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def minute_of(ts: str) -> Column:
    """Chunk by minute of event time: a user with a third of all rows still spreads over the whole time range."""
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / 60).cast("long")


def days_of(ts: str) -> Column:
    """Chunk by five days of event time. The usual user has tens of events in a month: a chunk a minute would be one a row, so
    that the summary of the chunks were as long as the table."""
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / (5 * 86_400)).cast("long")


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def state_samples(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    rows = ordered_scan(events, ["user_id"], ["ts", "event_id"], days_of("ts"), row_number="rn")
    k = F.get_json_object("props", "$.k").cast("int")
    phase = (
        F.when(F.col("event_type").isin("click", "signup"), "talking")
        .when(F.col("event_type") == "view", "gameplay")
        .when(F.col("event_type") == "purchase", "waiting_or_music")
        .otherwise("unknown")
    )
    return rows.select(
        F.col("user_id").alias("vod_id"),
        (F.col("rn") - 1).cast("long").alias("idx"),
        (2.0 * (F.col("rn") - 1)).cast("double").alias("frame_timestamp"),
        F.col("event_type").alias("layout_id"),
        phase.alias("phase"),
        F.coalesce(k, F.lit(0)).alias("k"),
        (F.coalesce(k, F.lit(0)) / 100.0).alias("confidence"),
        F.col("value"),
    )


def silences(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    bounds = events.groupBy("user_id").agg(F.min(micros("ts")).alias("t0"))
    errors = events.where("event_type = 'error'").select("user_id", "event_id", micros("ts").alias("t"), "value")
    starts = errors.join(bounds, "user_id").select(
        F.col("user_id").alias("clip_id"),
        "event_id",
        ((F.col("t") - F.col("t0")) / 1e9).alias("start"),
        ((F.col("t") - F.col("t0")) / 1e9 + F.col("value") / 20.0).alias("end"),
    )
    return starts


def clip_durations(silence: DataFrame) -> DataFrame:
    return silence.groupBy("clip_id").agg((F.max("end") + 1).alias("source_duration"))


def coarse_windows(spark: SparkSession, folder: str) -> DataFrame:
    """One 30 s window per sample, every struct derived from the row's own numbers."""
    s = state_samples(spark, folder)
    k = F.col("k")
    audio = F.when(k >= 3, F.struct(
        (k / 100.0).alias("voice_ratio"),
        (F.pmod(k * 7, F.lit(100)) / 100.0).alias("speech_continuity"),
        (1 - k / 100.0).alias("silence_ratio"),
        (F.pmod(k * 11, F.lit(50)) / 100.0).alias("dynamic_range"),
        (F.pmod(k * 17, F.lit(100)) / 100.0).alias("energy_continuity"),
    ))
    text = (
        F.when(F.col("layout_id") == "click", "vamos a jugar")
        .when(F.col("layout_id") == "view", "el juego del mapa")
        .when(F.col("layout_id") == "purchase", "la historia del chat")
        .otherwise("musica")
    )
    probe = F.when(F.pmod(k, F.lit(5)) != 0, F.struct(
        F.lit(True).alias("attempted"), text.alias("text"), F.lit("es").alias("language"),
        (F.pmod(k * 3, F.lit(100)) / 100.0).alias("transcript_quality_score"),
        (F.pmod(k, F.lit(40)) / 20.0).alias("words_per_second"),
        (F.pmod(k * 19, F.lit(50)) / 100.0).alias("repeated_text_ratio"),
    ))
    visual = F.when(k >= 6, F.struct(
        F.lit(True).alias("sampled"),
        (F.pmod(k * 13, F.lit(100)) / 200.0).alias("motion_score"),
        (F.pmod(k * 23, F.lit(100)) / 250.0).alias("scene_change_score"),
        F.when(F.pmod(k, F.lit(3)) == 0, "fullscreen_camera_hint").when(F.pmod(k, F.lit(3)) == 1, "facecam_overlay_hint")
        .otherwise("no_face").alias("layout_hint"),
        (F.pmod(k, F.lit(3)) != 2).alias("face_present"),
    ))
    return s.select(
        "vod_id", "idx", (F.col("idx") * 30.0).alias("start"), (F.col("idx") * 30.0 + 30.0).alias("end"), "k",
        audio.alias("audio"), probe.alias("probe"), visual.alias("visual"),
    )


def word_count(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(column, r"\s+"), lambda w: w != "")).cast("long")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").withColumn("nw", word_count("text"))
    placed = ordered_scan(turns, ["conv_id"], ["turn"], index_chunk("turn"), cumsum={"words_before": F.col("nw")}, row_number="rn")
    return placed.select(
        F.col("conv_id").alias("vod_id"),
        (F.col("rn") - 1).cast("long").alias("pos"),
        "turn",
        (F.col("words_before") * 0.4).alias("start"),
        ((F.col("words_before") + F.col("nw")) * 0.4).alias("end"),
        "text",
        (-(F.col("turn") % 5) / 10.0).alias("avg_logprob"),
        ((F.col("turn") % 7) / 7.0).alias("no_speech_probability"),
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    start = (F.col("o_orderkey") % 5000).cast("long")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("cache_key"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed")
        .otherwise("processing").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
        start.alias("start_seconds"),
        (start + F.floor(F.col("o_totalprice") / 200)).cast("long").alias("end_seconds"),
        "o_totalprice",
        "o_orderpriority",
    )


def formats(spark: SparkSession, folder: str) -> DataFrame:
    """Media formats per recording. `ord` orders equal rows too, so duplicates of (order, line) stay apart."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("vod_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
        (F.col("l_quantity") * 4).alias("abr"),
        (F.col("l_extendedprice") / 50).alias("tbr"),
        (144 + 36 * (F.col("l_partkey") % 30)).cast("long").alias("height"),
        (F.col("l_returnflag") == "A").alias("audio_only"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


def rects(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("clip_id"),
        F.col("l_linenumber").cast("long").alias("frame_index"),
        F.col("l_partkey").alias("det_a"),
        F.col("l_suppkey").alias("det_b"),
        F.col("l_extendedprice").alias("det_c"),
        (F.col("l_partkey") % 1600).cast("long").alias("x"),
        (F.col("l_suppkey") * 7 % 800).cast("long").alias("y"),
        (20 + 4 * F.col("l_quantity")).cast("long").alias("width"),
        (20 + 40 * F.col("l_linenumber")).cast("long").alias("height"),
        F.round(1 - F.col("l_discount") * 8, 2).alias("confidence"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    rows = ordered_scan(
        e.select(F.col("label").cast("long").alias("vod_id"), "vec_id", "embedding"),
        ["vod_id"], ["vec_id"], index_chunk("vec_id"), row_number="rn",
    )
    return rows.select("vod_id", "vec_id", (F.col("rn") - 1).cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("embedding"))


VIEWS_SQL = {
    "state_samples": """
        SELECT user_id AS vod_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
          2.0::DOUBLE * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS frame_timestamp,
          event_type AS layout_id,
          CASE WHEN event_type IN ('click','signup') THEN 'talking' WHEN event_type = 'view' THEN 'gameplay'
               WHEN event_type = 'purchase' THEN 'waiting_or_music' ELSE 'unknown' END AS phase,
          coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k,
          coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) / 100.0::DOUBLE AS confidence, value
        FROM events""",
    "silences": """
        SELECT e.user_id AS clip_id, event_id, (epoch_us(ts) - t0) / 1e9::DOUBLE AS start,
          (epoch_us(ts) - t0) / 1e9::DOUBLE + value / 20.0::DOUBLE AS "end"
        FROM events e JOIN (SELECT user_id, min(epoch_us(ts)) AS t0 FROM events GROUP BY 1) b ON e.user_id = b.user_id
        WHERE event_type = 'error'""",
    "clip_durations": """SELECT clip_id, max("end") + 1 AS source_duration FROM silences GROUP BY 1""",
    "segments": """
        SELECT conv_id AS vod_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn,
          coalesce(sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 0.4::DOUBLE AS start,
          (sum(nw) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT * 0.4::DOUBLE AS "end",
          text, -(turn % 5) / 10.0::DOUBLE AS avg_logprob, (turn % 7) / 7.0::DOUBLE AS no_speech_probability
        FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS nw FROM conversations)""",
    "jobs": """
        SELECT o_orderkey AS id, o_custkey AS cache_key,
          CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'processing' END AS status,
          strftime(o_orderdate, '%Y-%m-%d') AS updated_at, o_orderkey % 5000 AS start_seconds,
          o_orderkey % 5000 + CAST(floor(o_totalprice / 200) AS BIGINT) AS end_seconds, o_totalprice, o_orderpriority
        FROM orders""",
    "formats": """
        SELECT l_orderkey AS vod_id, l_quantity * 4 AS abr, l_extendedprice / 50 AS tbr,
          144 + 36 * (l_partkey % 30) AS height, l_returnflag = 'A' AS audio_only,
          l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem""",
    "rects": """
        SELECT l_orderkey AS clip_id, CAST(l_linenumber AS BIGINT) AS frame_index, l_partkey AS det_a, l_suppkey AS det_b,
          l_extendedprice AS det_c, l_partkey % 1600 AS x, l_suppkey * 7 % 800 AS y,
          CAST(20 + 4 * l_quantity AS BIGINT) AS width, CAST(20 + 40 * l_linenumber AS BIGINT) AS height,
          round(1 - l_discount * 8, 2) AS confidence FROM lineitem""",
    "vectors": """
        SELECT CAST(label AS BIGINT) AS vod_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
          CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "coarse_windows": """
        SELECT vod_id, idx, idx * 30.0::DOUBLE AS start, idx * 30.0::DOUBLE + 30.0::DOUBLE AS "end", k, layout_id,
          k >= 3 AS has_audio, k % 5 <> 0 AS has_probe, k >= 6 AS has_visual,
          k / 100.0::DOUBLE AS voice_ratio, (k * 7 % 100) / 100.0::DOUBLE AS speech_continuity, 1 - k / 100.0::DOUBLE AS silence_ratio,
          (k * 11 % 50) / 100.0::DOUBLE AS dynamic_range, (k * 17 % 100) / 100.0::DOUBLE AS energy_continuity,
          CASE layout_id WHEN 'click' THEN 'vamos a jugar' WHEN 'view' THEN 'el juego del mapa'
               WHEN 'purchase' THEN 'la historia del chat' ELSE 'musica' END AS text,
          (k * 3 % 100) / 100.0::DOUBLE AS transcript_quality_score, (k % 40) / 20.0::DOUBLE AS words_per_second,
          (k * 19 % 50) / 100.0::DOUBLE AS repeated_text_ratio,
          (k * 13 % 100) / 200.0::DOUBLE AS motion_score, (k * 23 % 100) / 250.0::DOUBLE AS scene_change_score,
          CASE k % 3 WHEN 0 THEN 'fullscreen_camera_hint' WHEN 1 THEN 'facecam_overlay_hint' ELSE 'no_face' END AS layout_hint,
          k % 3 <> 2 AS face_present
        FROM state_samples""",
}

_NEEDS = {"clip_durations": ["silences"], "coarse_windows": ["state_samples"]}


def with_views(names: str, body: str, **extra: str) -> str:
    """`WITH` text for the named views (space separated) and extra named queries, then the body."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({VIEWS_SQL[n]})" for n in wanted] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
