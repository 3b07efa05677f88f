"""Registered queries: sources, sinks, streams. Files are written from the given tables into the shared checkpoint folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import terms as tm
from tidemark.operators import timeline as tl
from tidemark.operators import transcripts as tr
from tidemark.operators.chunked import ordered_scan
from tidemark.plans.catalog_timeline import SEGMENTS, hysteresis_sql, layout_segs
from tidemark.plans.catalog_candidates import EXPORTS, ranges  # noqa: F401
from tidemark.plans.registry import Registry
from tidemark.plans.views import formats, minute_of, segments, state_samples, table, with_views
from tidemark.sources import pcm
from tidemark.sources import readers as rd
from tidemark.sources import writers as wr
from tidemark.streaming import live as lv

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("read_transcript_chunks", with_views("segments", """SELECT vod_id, pos // 3 AS chunk_index, count(*) AS segments, sum("end" - start) AS seconds, md5(string_agg(text, '|' ORDER BY pos)) AS text_md5 FROM segments GROUP BY 1, 2"""))
def q_chunks(spark, folder):
    s = segments(spark, folder).withColumn("index", F.floor(F.col("pos") / 3).cast("int"))
    part = F.struct("pos", F.struct("start", "end", "text", F.lit(None).cast(f"array<{rd.WORD}>").alias("words"), "avg_logprob", "no_speech_probability").alias("s"))
    chunks = s.groupBy("vod_id", "index").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.lit("es").alias("language"), F.transform(F.sort_array(F.collect_list(part)), lambda x: x["s"]).alias("segments"))
    path = lv.state_folder(spark, "chunks")
    chunks.withColumn("vod_id", F.col("vod_id").cast("string")).write.json(path)
    back = rd.read_transcript_chunks(spark, path, lines=True)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "|")
    return back.groupBy(F.col("vod_id").cast("long").alias("vod_id"), F.col("chunk_index").cast("long").alias("chunk_index")).agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.col("end") - F.col("start")).alias("seconds"), F.md5(text).alias("text_md5"))


@query("read_timelines_guarded", with_views("state_samples", "SELECT vod_id, run, phase FROM segs WHERE vod_id % 3 <> 0 AND vod_id % 5 <> 0", **SEGMENTS))
def q_guarded(spark, folder):
    """One indented document per recording; every third has an old key, and every fifth file breaks off."""
    row = F.struct(F.col("run").cast("long").alias("run"), "phase")
    docs = layout_segs(spark, folder).groupBy("vod_id").agg(F.sort_array(F.collect_list(row)).alias("segments"))
    docs = docs.withColumn("cache_key", F.when(F.col("vod_id") % 3 == 0, "old").otherwise("current"))
    text = F.to_json(F.struct("vod_id", "cache_key", "segments"), {"pretty": "true"})
    text = F.when(F.col("vod_id") % 5 == 0, F.substring(text, 1, 40)).otherwise(text)
    path = lv.state_folder(spark, "timelines")
    docs.select(F.col("vod_id").alias("file"), text.alias("value")).write.partitionBy("file").text(path)
    kept = rd.read_guarded(spark, path, "vod_id long, cache_key string, segments array<struct<run:long,phase:string>>", "current")
    return kept.select("vod_id", F.inline("segments"))


@query("write_timelines", with_views("state_samples", "SELECT vod_id, run, phase, start, \"end\" FROM segs", **SEGMENTS))
def q_write_timelines(spark, folder):
    segs = wr.with_bucket(layout_segs(spark, folder), buckets=4)
    path = lv.state_folder(spark, "timeline-table")
    wr.write_timeline(segs.withColumn("phase", F.lit("stale")), path)
    wr.write_timeline(segs, path)
    return spark.read.parquet(path).select("vod_id", "run", "phase", "start", "end")


@query("write_subtitle_files", with_views("segments", """SELECT vod_id AS clip_id, count(*) + 13 AS lines, min(printf('Dialogue: 0,%d:%02d:%02d.%02d', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100)) AS first_line
    FROM (SELECT vod_id, CAST(round_even(start * 100, 0) AS BIGINT) AS c FROM segments) GROUP BY 1"""))
def q_subtitles(spark, folder):
    lines = wr.subtitle_lines(segments(spark, folder).select(F.col("vod_id").alias("clip_id"), "start", "end", "text"))
    path = lv.state_folder(spark, "subtitles")
    wr.write_subtitles(lines, path)
    back = spark.read.text(path)
    first = F.min(F.when(F.col("value").startswith("Dialogue"), F.regexp_extract("value", r"^(Dialogue: 0,[0-9:.]+)", 1)))
    return back.groupBy(F.col("clip_id").cast("long").alias("clip_id")).agg(F.count(F.lit(1)).alias("lines"), first.alias("first_line"))


@query("candidate_artifacts", """SELECT 'accepted' AS part, count(*) AS n FROM documents WHERE n_chars % 1000 >= 550 UNION ALL SELECT 'rejected', count(*) FROM documents WHERE n_chars % 1000 < 550 UNION ALL SELECT 'breakdown', count(*) FROM documents WHERE n_chars % 1000 >= 550""")
def q_artifacts(spark, folder):
    rows = ranges(spark, folder).withColumn("penalties", F.array(F.lit("none")))
    path = lv.state_folder(spark, "artifacts")
    wr.write_candidate_artifacts(rows.where("score >= 55"), rows.where("score < 55"), path)
    read = lambda sub, name: spark.read.schema("id long").json(f"{path}/{sub}").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return read("candidates", "accepted").union(read("rejected_candidates", "rejected")).union(read("score_breakdown", "breakdown"))


@query("debug_extracts", with_views("state_samples", """SELECT 'raw' AS part, count(*) AS n FROM state_samples UNION ALL SELECT 'smoothed', count(*) FROM confirmed UNION ALL SELECT 'graph', count(*) FROM segs""", **SEGMENTS))
def q_debug(spark, folder):
    raw = state_samples(spark, folder)
    path = lv.state_folder(spark, "debug")
    graph = tl.transitions(layout_segs(spark, folder)).select("vod_id", "phase", "start", "end", "transition_in", "transition_out")
    wr.write_debug_extracts(raw, tl.hysteresis(raw, confirmation=2), graph, path)
    read = lambda sub, name: spark.read.schema("vod_id long").json(f"{path}/{sub}").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return read("raw_phase_scores", "raw").union(read("smoothed_windows", "smoothed")).union(read("transition_graph", "graph"))


@query("read_vod_metadata", with_views("formats", """SELECT vod_id, CASE WHEN vod_id % 7 = 0 THEN 'duration_missing_or_invalid' WHEN count(CASE WHEN l_linenumber <> 1 THEN 1 END) = 0 THEN 'no_audio_stream' END AS reason,
    CASE WHEN vod_id % 7 = 0 OR count(CASE WHEN l_linenumber <> 1 THEN 1 END) = 0 THEN NULL WHEN vod_id % 5 = 0 THEN 'Untitled VOD' ELSE 'VOD ' || vod_id END AS title FROM formats GROUP BY 1"""))
def q_metadata(spark, folder):
    f = formats(spark, folder)
    entry = F.struct(F.lit(None).cast("string").alias("format_id"), F.lit("mp4").alias("ext"), F.lit("https").alias("protocol"), F.when(F.col("l_linenumber") == 1, "none").otherwise("aac").alias("acodec"),
        F.when(F.col("audio_only"), "none").otherwise("h264").alias("vcodec"), "abr", F.lit(None).cast("double").alias("vbr"), "tbr", F.lit(None).cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.lit(None).cast("double").alias("fps"))
    doc = f.groupBy("vod_id").agg(F.collect_list(entry).alias("formats")).select(
        F.col("vod_id").cast("string").alias("id"), F.when(F.col("vod_id") % 5 != 0, F.concat(F.lit("VOD "), F.col("vod_id").cast("string"))).alias("title"), F.when(F.col("vod_id") % 7 != 0, 100.0).alias("duration"), "formats")
    path = lv.state_folder(spark, "metadata")
    doc.write.json(path)
    good, bad = rd.vod_metadata(spark.read.schema(rd.METADATA).json(path), F.lit("twitch"))
    rows = good.select("vod_id", F.lit(None).cast("string").alias("reason"), "title").unionByName(bad.withColumn("title", F.lit(None).cast("string")))
    return rows.withColumn("vod_id", F.col("vod_id").cast("long"))


@query("read_profiles", """SELECT 'p' || s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'p' || s_suppkey ELSE s_name END AS display_name FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 6 <> 1""")
def q_profiles(spark, folder):
    k = F.col("s_suppkey")
    box = F.struct(F.lit(10).alias("x"), F.lit(10).alias("y"), F.when(k % 6 == 1, 5000).otherwise(300).alias("width"), F.lit(200).alias("height"))
    layout = F.struct(F.lit("a").alias("id"), F.lit("small_facecam").alias("type"), F.lit("top_left").alias("position"), box.alias("facecam_region"))
    docs = table(spark, folder, "supplier").select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), F.when(k % 5 != 0, F.col("s_name")).alias("display_name"), F.when(k % 4 == 0, 2).otherwise(1).alias("version"),
        F.struct(F.lit(1920).alias("width"), F.lit(1080).alias("height")).alias("source_resolution"), F.array(layout).alias("layouts"))
    path = lv.state_folder(spark, "profiles")
    docs.write.json(path)
    return rd.read_profiles(spark, path, lines=True).select("id", "display_name")


@query("profile_summary", """SELECT 'p' || s_suppkey AS id, 1 AS version, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'a,b' END AS enabled_layouts FROM supplier""")
def q_profile_summary(spark, folder):
    k = F.col("s_suppkey")
    layouts = F.array(F.struct(F.lit("a").alias("id"), F.lit(True).alias("enabled")), F.struct(F.lit("b").alias("id"), (k % 2 != 0).alias("enabled")))
    p = table(spark, folder, "supplier").select(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.lit(1).alias("version"), layouts.alias("layouts"))
    return rd.profile_summary(p).select("id", "version", F.array_join("enabled_layouts", ",").alias("enabled_layouts"))


@query("embed_texts", with_views("segments", """SELECT vod_id, pos, CASE WHEN length(text) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length, 'length-encoder' AS effective_backend, FALSE AS fallback_used FROM segments"""))
def q_embed(spark, folder):
    s = segments(spark, folder)

    def make():
        import zlib

        return lambda texts: [[len(t), t.count(" "), zlib.crc32(t.encode()) % 97] for t in texts]

    e = rd.embed_texts(s, ["vod_id", "pos"], "text", make, "length-encoder", tm.hash_embedding(s, ["vod_id", "pos"]))
    return e.select("vod_id", "pos", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"), "effective_backend", "fallback_used")


@query("pluggable_segmenter", with_views("segments", """SELECT vod_id, min(start) AS start, max("end") AS "end" FROM segments GROUP BY 1"""))
def q_segmenter(spark, folder):
    rd.register_segmenter("whole", lambda s: s.groupBy("vod_id").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    return rd.segment_topics("whole", segments(spark, folder))


@query("read_pcm_files", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
    s AS (SELECT user_id, rn * 20 + j AS i, (event_id * 7919 + j * 13) % 65536 - 32768 AS v FROM e, (SELECT unnest(range(20)) AS j))
    SELECT user_id || '.wav' AS clip_id, i // 400 AS frame_index, count(*) AS samples, sum(v) / 32768.0::DOUBLE AS total, arg_min(v, i) / 32768.0::DOUBLE AS first, NULL::VARCHAR AS error FROM s GROUP BY user_id, i // 400
    UNION ALL SELECT 'notes.txt', NULL, NULL, NULL, NULL, 'not a WAV file' FROM (SELECT count(*) FROM events)""")
def q_read_pcm_files(spark, folder):
    samples = state_samples(spark, folder).select("vod_id", "idx").join(numbered_events(spark, folder), ["vod_id", "idx"])
    samples = samples.select("vod_id", "idx", "event_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("j"))
    samples = samples.select("vod_id", (F.col("idx") * 20 + F.col("j")).alias("i"), ((F.col("event_id") * 7919 + F.col("j") * 13) % 65536 - 32768).alias("v"))
    path = lv.state_folder(spark, "sound")
    pcm.write_pcm(samples, path, "vod_id", "i", "v").write.format("noop").mode("overwrite").save()
    spark.createDataFrame([("notes",)], "value string").coalesce(1).write.text(f"{path}/text")
    read = pcm.read_pcm_samples(spark, path, split_bytes=1000)  # files of about 2,700 bytes lie in several tasks
    double = F.transform("samples", lambda x: x.cast("double"))
    return read.select(
        F.when(F.col("error").isNull(), F.col("clip_id")).otherwise("notes.txt").alias("clip_id"), "frame_index", F.when(F.col("error").isNull(), F.size("samples")).cast("long").alias("samples"),
        F.aggregate(double, F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at(double, 1).alias("first"), "error")


def numbered_events(spark, folder):
    """Events with their place in their recording."""
    rows = ordered_scan(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], minute_of("ts"), row_number="rn")
    return rows.select(F.col("user_id").alias("vod_id"), (F.col("rn") - 1).cast("long").alias("idx"), "event_id")


@query("stage_counts", with_views("state_samples", """SELECT 'samples' AS stage, 0 AS place, count(*) AS rows, min(frame_timestamp) AS least, max(frame_timestamp) AS most FROM state_samples
    UNION ALL SELECT 'confirmed', 1, count(*), min(frame_timestamp), max(frame_timestamp) FROM confirmed UNION ALL SELECT 'segments', 2, count(*), min(start), max(start) FROM segs
    UNION ALL SELECT 'talking', 3, count(*), min(start), max(start) FROM segs WHERE phase = 'talking'""", **SEGMENTS))
def q_stage_counts(spark, folder):
    counts = rd.StageCounts()
    samples = counts.watch("samples", state_samples(spark, folder), "frame_timestamp")
    confirmed = counts.watch("confirmed", tl.hysteresis(samples, confirmation=2), "frame_timestamp")
    phases = tl.representatives(state_samples(spark, folder)).select("vod_id", F.col("layout_id").alias("accepted"), F.col("phase").alias("state_phase"))
    merged = tl.merge_state_runs(confirmed, tl.durations_of(state_samples(spark, folder)), median_of=()).withColumnRenamed("layout_id", "accepted").join(phases, ["vod_id", "accepted"])
    segments_ = counts.watch("segments", merged, "start")
    talking = counts.watch("talking", segments_.where("state_phase = 'talking'"), "start")
    talking.write.format("noop").mode("overwrite").save()
    return counts.table(spark)


# ---- streams over the events and orders tables


def event_stream(spark, folder, slices: int | None = None, group=None):
    """The events as a stream. With `slices`, they arrive in that many groups of files, one group per micro-batch, dealt out by
    `group`. The default is the event number: every group covers the whole time range, so later ones bring rows behind the newest
    time seen."""
    events = table(spark, folder, "events")
    reader = spark.readStream.schema(events.schema)
    if slices is None:
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    else:
        path, tasks = lv.state_folder(spark, "events"), 4
        number = F.col("event_id") % slices if group is None else group
        for part in range(slices):  # one group after the other, so that file times give the order of arrival
            events.where(number == part).repartition(tasks).write.mode("append").parquet(path)
        rows = reader.option("maxFilesPerTrigger", tasks).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def shuffled_stream(spark, folder):
    """The events in three batches by time, a third of them user 0's. An event comes up to twenty hours late, in any order."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    span = table(spark, folder, "events").agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    late = t + F.pmod(F.xxhash64("event_id"), F.lit(20 * 3600)) * 1_000_000
    third = F.least(F.floor((late - span["a"]) * 3 / (span["b"] - span["a"] + 1)), F.lit(2))
    stream = event_stream(spark, folder, 3, third)
    return stream.withColumn("user_id", F.when(F.col("event_id") % 3 == 1, 0).otherwise(F.col("user_id")).cast("long"))


_LIMIT = "(SELECT max(epoch_us(ts)) - {d}::BIGINT * 1000000 FROM events)"


@query("stream_windows", f"""SELECT user_id, s AS start_us, s + 3600000000 AS end_us, count(*) AS n, sum(value) AS total FROM (SELECT *, epoch_us(ts) // 3600000000 * 3600000000 AS s FROM events)
    WHERE s + 3600000000 <= {_LIMIT.format(d=600)} GROUP BY 1, 2""")
def q_stream_windows(spark, folder):
    w = lv.live_windows(event_stream(spark, folder), ["user_id"], "ts", "10 minutes", "1 hour", n=F.count(F.lit(1)), total=F.sum("value"))
    return lv.run_to_table(w, "windows")


@query("stream_overlapping", f"""SELECT event_type, s AS start_us, s + 1800000000 AS end_us, count(*) AS n FROM (SELECT event_type, unnest([(epoch_us(ts) // 900000000) * 900000000, (epoch_us(ts) // 900000000 - 1) * 900000000]) AS s FROM events)
    WHERE s + 1800000000 <= {_LIMIT.format(d=600)} GROUP BY 1, 2""")
def q_stream_overlapping(spark, folder):
    w = lv.live_windows(event_stream(spark, folder), ["event_type"], "ts", "10 minutes", "1800 seconds", "900 seconds", n=F.count(F.lit(1)))
    return lv.run_to_table(w, "overlapping")


@query("stream_runs", f"""SELECT user_id, event_type, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS samples FROM (
      SELECT *, sum(nb) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS isl FROM (SELECT user_id, event_type, event_id, epoch_us(ts) AS t,
        CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS nb FROM events))
    GROUP BY user_id, event_type, isl HAVING max(t) + 21600000000 <= {_LIMIT.format(d=600)}""")
def q_stream_runs(spark, folder):
    return lv.run_to_table(lv.live_runs(event_stream(spark, folder), ["user_id", "event_type"], "ts", "10 minutes", "6 hours"), "runs")


_SHUFFLED = "SELECT event_id, event_type, props, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 1 THEN 0 ELSE user_id END AS user_id FROM events"


@query("stream_hysteresis", f"""WITH hot AS ({_SHUFFLED}), state_samples AS (SELECT user_id AS vod_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS idx, event_type AS layout_id FROM hot
      WHERE t <= {_LIMIT.format(d=86400)}), {', '.join(f'{k} AS ({v})' for k, v in hysteresis_sql(2).items())}
    SELECT vod_id AS user_id, prior AS from_state, accepted AS to_state, t AS start_us FROM confirmed WHERE prior <> accepted""")
def q_stream_hysteresis(spark, folder):
    changes = lv.live_hysteresis(shuffled_stream(spark, folder), ["user_id"], "ts", "1 day", "event_type", 2, F.col("event_id"))
    return lv.run_to_table(changes, "hysteresis")


_HEARD = f"""SELECT user_id, t AS start_us, t + 30000000::BIGINT * (event_id % 4000) AS end_us, event_type || ' uno dos tres k' || (event_id % 2) AS text, list_sort([event_type, 'uno', 'dos', 'tres', 'k' || (event_id % 2)]) AS w,
    row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ({_SHUFFLED}) WHERE t <= {_LIMIT.format(d=86400)}"""


@query("stream_unrepeated", f"""WITH RECURSIVE heard AS ({_HEARD}), walk(user_id, rn, keep, last) AS (
    SELECT user_id, rn, true, [{{'a': start_us, 'b': end_us, 'w': w}}] FROM heard WHERE rn = 1 UNION ALL
    SELECT user_id, rn, NOT again, CASE WHEN again THEN last ELSE list_append(last, {{'a': start_us, 'b': end_us, 'w': w}})[-8:] END FROM (
      SELECT h.*, k.last, len(list_filter(k.last, lambda x: least(x.b, h.end_us) > greatest(x.a, h.start_us) AND len(list_intersect(x.w, h.w)) >= 0.72 * len(list_distinct(list_concat(x.w, h.w))))) > 0 AS again
      FROM walk k JOIN heard h ON h.user_id = k.user_id AND h.rn = k.rn + 1))
    SELECT h.user_id, start_us, end_us, text FROM walk JOIN heard h USING (user_id, rn) WHERE keep""")
def q_stream_unrepeated(spark, folder):
    s = shuffled_stream(spark, folder)
    heard = s.select("user_id", "event_id", "ts", (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 4000) * 30)).alias("until"), F.concat("event_type", F.lit(" uno dos tres k"), F.col("event_id") % 2).alias("text"))
    return lv.run_to_table(lv.live_unrepeated(heard, ["user_id"], "ts", "1 day", "until", "text", tie=F.col("event_id")), "unrepeated")


@query("stream_dedup_transcript", "SELECT user_id, count(DISTINCT event_type || props) AS kept FROM events GROUP BY 1")
def q_stream_dedup(spark, folder):
    kept = lv.run_to_table(lv.live_distinct(event_stream(spark, folder).select("user_id", "event_type", "props", "ts"), ["user_id", "event_type", "props"], "ts", "40 days"), "distinct")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))


@query("stream_job_state", "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type FROM events GROUP BY 1")
def q_stream_job_state(spark, folder):
    s = event_stream(spark, folder, slices=3).select("user_id", "event_id", "event_type", "ts")
    return lv.live_job_state(s, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@query("stream_late_rows", """SELECT event_id, user_id FROM events WHERE (event_id % 3 = 1 AND ts < (SELECT max(ts) FROM events WHERE event_id % 3 = 0) - INTERVAL 600 SECOND)
    OR (event_id % 3 = 2 AND ts < (SELECT max(ts) FROM events WHERE event_id % 3 < 2) - INTERVAL 600 SECOND)""")
def q_stream_late(spark, folder):
    return lv.live_late_rows(event_stream(spark, folder, slices=3).select("event_id", "user_id", "ts"), "ts", 600).select("event_id", "user_id")


@query("incremental_missing", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def q_incremental(spark, folder):
    planned = table(spark, folder, "events").select("event_id", "user_id")
    return lv.live_missing(planned, event_stream(spark, folder, slices=3).where("event_type <> 'error'"), ["event_id"])
