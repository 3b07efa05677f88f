"""Registered queries: scalar functions, ranges, job tables, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.operators import jobs as jb
from tidemark.operators import ranges as rg
from tidemark.operators import rules as ru
from tidemark.plans.registry import Registry
from tidemark.plans.views import formats, jobs, rects, state_samples, table, with_views

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_TIMECODE = """CASE o_orderkey % 7 WHEN 0 THEN lpad(CAST(o_orderkey % 130 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 75 AS VARCHAR), 2, '0')
    WHEN 1 THEN CAST(o_orderkey % 30 AS VARCHAR) || ':' || lpad(CAST(o_custkey % 70 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 61 AS VARCHAR), 2, '0')
    WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN ' ' || CAST(o_orderkey % 50 AS VARCHAR) || ':0' || CAST(o_custkey % 10 AS VARCHAR) || ' '
    WHEN 4 THEN CAST(o_custkey % 90 AS VARCHAR) || ':' || CAST(o_orderkey % 60 AS VARCHAR) WHEN 5 THEN o_orderpriority
    ELSE CAST(o_custkey AS VARCHAR) || '.' || CAST(o_orderkey % 10 AS VARCHAR) END"""


def timecodes(spark, folder):
    text = _TIMECODE.replace("VARCHAR", "STRING")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.expr(text).alias("timecode"))


@query("parse_timecode", f"""
    WITH t AS (SELECT o_orderkey AS id, {_TIMECODE} AS timecode FROM orders), p AS (SELECT *, string_split(trim(timecode), ':') AS p FROM t)
    SELECT id, timecode, CASE WHEN regexp_full_match(trim(timecode), '[0-9]+:[0-5][0-9]') THEN CAST(p[1] AS BIGINT) * 60 + CAST(p[2] AS BIGINT)
      WHEN regexp_full_match(trim(timecode), '[0-9]+:[0-5][0-9]:[0-5][0-9]') THEN CAST(p[1] AS BIGINT) * 3600 + CAST(p[2] AS BIGINT) * 60 + CAST(p[3] AS BIGINT) END AS seconds FROM p""")
def q_parse_timecode(spark, folder):
    return timecodes(spark, folder).withColumn("seconds", sc.parse_timecode(F.col("timecode")))


@query("parse_timecode_lenient", f"""
    WITH t AS (SELECT o_orderkey AS id, {_TIMECODE} AS timecode FROM orders), p AS (SELECT *, string_split(trim(timecode), ':') AS p FROM t)
    SELECT id, timecode, CASE WHEN regexp_full_match(trim(timecode), '[0-9]+([.][0-9]+)?') THEN CAST(trim(timecode) AS DOUBLE)
      WHEN regexp_full_match(trim(timecode), '[0-9]+:[0-9]+') AND try_cast(p[1] AS BIGINT) <= 59 AND try_cast(p[2] AS BIGINT) <= 59 THEN CAST(p[1] AS DOUBLE) * 60 + CAST(p[2] AS DOUBLE)
      WHEN regexp_full_match(trim(timecode), '[0-9]+:[0-9]+:[0-9]+') AND try_cast(p[2] AS BIGINT) <= 59 AND try_cast(p[3] AS BIGINT) <= 59
        THEN CAST(p[1] AS DOUBLE) * 3600 + CAST(p[2] AS DOUBLE) * 60 + CAST(p[3] AS DOUBLE) END AS seconds FROM p""")
def q_parse_timecode_lenient(spark, folder):
    return timecodes(spark, folder).withColumn("seconds", sc.parse_timecode_lenient(F.col("timecode")))


@query("validate_clip_interval", with_views("jobs", """
    SELECT id, CASE WHEN end_seconds <= start_seconds THEN 'end_not_after_start' WHEN end_seconds - start_seconds > 1800 THEN 'exceeds_maximum_duration'
      WHEN end_seconds > 5000.5 THEN 'end_beyond_recording' ELSE 'ok' END AS reason FROM jobs"""))
def q_validate_clip_interval(spark, folder):
    reason = sc.clip_interval_problem(F.col("start_seconds"), F.col("end_seconds"), 1800, F.lit(5000.0))
    return jobs(spark, folder).select("id", reason.alias("reason"))


@query("format_timecode", with_views("state_samples", """
    SELECT vod_id, idx, printf('%02d:%02d:%02d', a // 3600, a % 3600 // 60, a % 60) AS floored, printf('%02d:%02d:%02d', b // 3600, b % 3600 // 60, b % 60) AS rounded,
      CASE WHEN c >= 3600 THEN printf('%02d:%02d:%02d', c // 3600, c % 3600 // 60, c % 60) ELSE printf('%02d:%02d', c % 3600 // 60, c % 60) END AS short
    FROM (SELECT vod_id, idx, CAST(floor(v) AS BIGINT) AS a, CAST(round_even(v, 0) AS BIGINT) AS b, CAST(floor(v + 0.5) AS BIGINT) AS c
          FROM (SELECT vod_id, idx, value * 11 + frame_timestamp AS v FROM state_samples))"""))
def q_format_timecode(spark, folder):
    at = F.col("value") * 11 + F.col("frame_timestamp")
    return state_samples(spark, folder).select(
        "vod_id", "idx", sc.format_timecode(at).alias("floored"), sc.format_timecode(at, "even").alias("rounded"), sc.format_timecode(at, "short").alias("short")
    )


@query("format_subtitle_time", """
    SELECT event_id, printf('%d:%02d:%02d.%02d', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100) AS stamp
    FROM (SELECT event_id, CAST(round_even(value * 37 * 100, 0) AS BIGINT) AS c FROM events)""")
def q_format_subtitle_time(spark, folder):
    return table(spark, folder, "events").select("event_id", sc.format_subtitle_time(F.col("value") * 37).alias("stamp"))


@query("wrap_caption_text", """
    WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(translate(trim(regexp_replace(text, '\\s+', ' ', 'g')), '{}', '()'), ' '), lambda x: x <> '') AS words FROM conversations),
    f AS (SELECT conv_id, turn, list_reduce(words, lambda acc, x: CASE
        WHEN acc[len(acc)] = '' THEN list_append(acc[:len(acc)-1], x)
        WHEN length(acc[len(acc)] || ' ' || x) > 18 THEN list_append(acc, x)
        ELSE list_append(acc[:len(acc)-1], acc[len(acc)] || ' ' || x) END, ['']) AS lines FROM w)
    SELECT conv_id, turn, array_to_string(lines[:2], '\\N') AS caption FROM f""")
def q_wrap_caption_text(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", sc.wrap_caption(F.col("text")).alias("caption"))


_URLS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.twitch.tv/videos/' || CAST(page_id * 7919 + 100 AS VARCHAR) || regexp_extract(url, '([?#].*)$', 1)
    WHEN 1 THEN 'https://youtu.be/' || substr(md5(url), 1, 11) || regexp_extract(url, '([?#].*)$', 1)
    WHEN 2 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=5&list=' || CAST(page_id AS VARCHAR)
    WHEN 3 THEN 'https://youtube.com/live/' || substr(md5(url), 1, 8) WHEN 4 THEN url ELSE 'https://m.twitch.tv/channel' || CAST(page_id AS VARCHAR) END AS url FROM pages"""


def urls(spark, folder):
    text = _URLS[len("SELECT page_id, "):_URLS.rindex(" AS url FROM")].replace("VARCHAR", "STRING")
    return table(spark, folder, "pages").select("page_id", F.expr(text).alias("url"))


_URLPARTS = f"""WITH urls AS ({_URLS}), u AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS frag,
    regexp_extract(url, '^([^?#]*)', 1) AS base, page_id * 37 + 0.5::DOUBLE AS secs FROM urls)"""


@query("deep_link_url", _URLPARTS + """, k AS (SELECT *, CAST(round_even(secs, 0) AS BIGINT) AS v,
      list_transform(list_filter(string_split(q, '&'), lambda p: p <> ''), lambda p: [split_part(p, '=', 1), split_part(p, '=', 2)]) AS pairs FROM u),
    s AS (SELECT *, CASE WHEN ends_with(host, 'twitch.tv') THEN (v // 3600) || 'h' || (v % 3600 // 60) || 'm' || (v % 60) || 's'
      WHEN host IN ('youtube.com','www.youtube.com','m.youtube.com','youtu.be') THEN CAST(v AS VARCHAR) END AS stamp FROM k)
    SELECT page_id, CASE WHEN stamp IS NULL THEN NULL WHEN len(list_filter(pairs, lambda p: p[1] = 't')) > 0
      THEN base || '?' || array_to_string(list_transform(pairs, lambda p: p[1] || '=' || CASE WHEN p[1] = 't' THEN stamp ELSE p[2] END), '&') || frag
      ELSE base || '?' || array_to_string(list_append(list_transform(pairs, lambda p: p[1] || '=' || p[2]), 't=' || stamp), '&') || frag END AS link FROM s""")
def q_deep_link_url(spark, folder):
    return urls(spark, folder).select("page_id", sc.deep_link(F.col("url"), F.col("page_id") * 37 + 0.5).alias("link"))


_IDENTITY = _URLPARTS + """, i AS (SELECT *, CASE WHEN host IN ('twitch.tv','www.twitch.tv','m.twitch.tv') THEN nullif(regexp_extract(path, '^/videos/([0-9]+)/?$', 1), '') END AS tw,
      CASE WHEN host = 'youtu.be' THEN trim(path, '/') WHEN host IN ('youtube.com','www.youtube.com','m.youtube.com') THEN
        CASE WHEN regexp_extract(q, '(^|&)v=([^&]*)', 2) <> '' THEN regexp_extract(q, '(^|&)v=([^&]*)', 2)
             WHEN regexp_matches(path, '^/(live|shorts)/') THEN string_split(trim(path, '/'), '/')[-1] END END AS yt FROM u),
    ident AS (SELECT *, CASE WHEN tw IS NOT NULL THEN 'twitch' WHEN regexp_full_match(yt, '[A-Za-z0-9_-]{6,64}') THEN 'youtube' END AS platform,
      CASE WHEN tw IS NOT NULL THEN tw WHEN regexp_full_match(yt, '[A-Za-z0-9_-]{6,64}') THEN yt END AS vod FROM i)"""


@query("source_identity", _IDENTITY + " SELECT page_id, platform, vod AS vod_id FROM ident")
def q_source_identity(spark, folder):
    ident = sc.source_identity(F.col("url"))
    return urls(spark, folder).select("page_id", ident["platform"].alias("platform"), ident["vod_id"].alias("vod_id"))


@query("source_url_allowed", _IDENTITY + """ SELECT page_id, CASE WHEN host NOT IN ('twitch.tv','www.twitch.tv','m.twitch.tv') THEN 'unsupported_host' WHEN NOT contains(path, '/videos/') THEN 'not_a_recording' ELSE 'ok' END AS clip_form,
    CASE WHEN host NOT IN ('twitch.tv','www.twitch.tv','m.twitch.tv','youtube.com','www.youtube.com','m.youtube.com','youtu.be') THEN 'unsupported_host' WHEN platform IS NULL THEN 'not_a_recording' ELSE 'ok' END AS analysis_form FROM ident""")
def q_source_url_allowed(spark, folder):
    return urls(spark, folder).select(
        "page_id", sc.source_problem(F.col("url"), "clip").alias("clip_form"), sc.source_problem(F.col("url"), "analysis").alias("analysis_form")
    )


@query("normalize_identity", "SELECT c_custkey, regexp_replace(lower(coalesce(c_name, '')), '[^a-z0-9]', '', 'g') AS identity FROM customer")
def q_normalize_identity(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", sc.normalize_identity(F.col("c_name")).alias("identity"))


@query("clean_tags", """SELECT doc_id, CASE WHEN len(string_split(text, '.')) <= 50 THEN array_to_string(list_transform(list_filter(string_split(text, '.'), lambda t: trim(t, ' ') <> ''), lambda t: substr(trim(t, ' '), 1, 100)), '|') END AS tags FROM documents""")
def q_clean_tags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(sc.clean_tags(F.split("text", r"\.")), "|").alias("tags"))


@query("normalize_job_options", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'vertical' ELSE 'horizontal' END AS output_format,
    o_orderstatus = 'P' AND o_orderkey % 3 <> 0 AS smart_vertical_layout, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE 'auto' END AS streamer_profile FROM orders""")
def q_normalize_job_options(spark, folder):
    o = table(spark, folder, "orders")
    asked = F.when(F.col("o_orderkey") % 3 != 1, F.col("o_orderkey") % 3 != 0)  # null: the caller did not say
    vertical = F.col("o_orderstatus") == "P"
    fmt = F.when(vertical, "vertical").otherwise("horizontal")
    return o.select(
        F.col("o_orderkey").alias("id"), fmt.alias("output_format"),
        F.when(vertical, F.coalesce(asked, F.lit(True))).otherwise(False).alias("smart_vertical_layout"),
        F.when(vertical, F.col("o_orderpriority")).otherwise("auto").alias("streamer_profile"),
    )


@query("status_bucket_filter", with_views("jobs", "SELECT CASE status WHEN 'processing' THEN 'running' ELSE status END AS bucket, count(*) AS n FROM jobs GROUP BY 1"))
def q_status_bucket_filter(spark, folder):
    return jobs(spark, folder).groupBy(sc.status_bucket(F.col("status")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("backfill_strategy", """SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1-%' THEN 'profile_layout_match' WHEN o_orderpriority LIKE '2-%' THEN 'visual_layout' ELSE 'legacy_heuristic' END AS strategy,
    NOT (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%') AS requires_coarse FROM orders""")
def q_backfill_strategy(spark, folder):
    version = F.col("o_orderpriority")
    strategy = F.when(version.like("1-%"), "profile_layout_match").when(version.like("2-%"), "visual_layout").otherwise("legacy_heuristic")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), strategy.alias("strategy"), (strategy == "legacy_heuristic").alias("requires_coarse")
    )


@query("sweep_interrupted", with_views("jobs", """SELECT id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status,
    CASE WHEN status = 'processing' THEN 'Processing was interrupted by a restart.' END AS error_message, CASE WHEN status = 'processing' THEN '2030-01-01' ELSE updated_at END AS updated_at FROM jobs"""))
def q_sweep_interrupted(spark, folder):
    swept = jb.sweep_interrupted(jobs(spark, folder), [*sc.INTERRUPTIBLE, "processing"], "2030-01-01")
    return swept.select("id", "status", "error_message", "updated_at")


_STDERR = """CASE event_type WHEN 'error' THEN 'ERROR: Login Required; use cookies' WHEN 'view' THEN 'video does not exist' WHEN 'click' THEN 'this is PRIVATE' ELSE props END || chr(10) || '  ' || chr(10) || CAST(event_id AS VARCHAR) || ' tail  ' || chr(10)"""


@query("classify_error_text", f"""SELECT event_id, CASE event_type WHEN 'error' THEN 'login_required' WHEN 'view' THEN 'unavailable' WHEN 'click' THEN 'restricted' ELSE 'other' END AS error_class,
    CAST(event_id AS VARCHAR) || ' tail' AS last_line FROM (SELECT event_id, event_type, {_STDERR} AS stderr FROM events)""")
def q_classify_error_text(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.expr(_STDERR.replace("VARCHAR", "STRING")).alias("stderr"))
    return rows.select("event_id", sc.error_class(F.col("stderr")).alias("error_class"), sc.last_useful_line(F.col("stderr")).alias("last_line"))


@query("parse_rational_rate", """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN r BETWEEN 1 AND 120 THEN round(r, 3) ELSE 30.0 END AS fps
    FROM (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 END IS NULL AS ok,
      CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey * 10.0::DOUBLE / CAST(l_suppkey AS DOUBLE) END AS r FROM lineitem)""")
def q_parse_rational_rate(spark, folder):
    text = F.when(F.col("l_linenumber") == 1, "abc/1").otherwise(
        F.concat((F.col("l_partkey") * 10).cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", sc.parse_rate(text).alias("fps"))


@query("stage_fingerprint", """WITH a AS (SELECT o_orderkey AS id, sha256('{"p0":"audio-v1","p1":"' || o_custkey || '"}') AS audio_key, o_orderpriority AS p FROM orders),
    t AS (SELECT *, sha256('{"p0":"' || audio_key || '","p1":"model-a","p2":"1800","p3":"15"}') AS transcription_key FROM a), s AS (SELECT *, sha256('{"p0":"' || transcription_key || '","p1":"' || p || '","p2":"30","p3":"60","p4":"90"}') AS segmentation_key FROM t)
    SELECT id, audio_key, transcription_key, segmentation_key, sha256('{"p0":"' || segmentation_key || '","p1":"55","p2":"10"}') AS candidate_key FROM s""")
def q_stage_fingerprint(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority")
    keyed = o.withColumn("audio_key", sc.fingerprint(F.lit("audio-v1"), F.col("o_custkey")))
    keyed = keyed.withColumn("transcription_key", sc.fingerprint(F.col("audio_key"), F.lit("model-a"), F.lit(1800), F.lit(15)))
    keyed = keyed.withColumn("segmentation_key", sc.fingerprint(F.col("transcription_key"), F.col("o_orderpriority"), F.lit(30), F.lit(60), F.lit(90)))
    keyed = keyed.withColumn("candidate_key", sc.fingerprint(F.col("segmentation_key"), F.lit(55), F.lit(10)))
    return keyed.drop("o_custkey", "o_orderpriority")


@query("progress_percent", with_views("jobs", """SELECT id, CAST(least(100, greatest(0, 20 + floor(50 * (start_seconds / greatest(1, end_seconds))))) AS BIGINT) AS progress FROM jobs"""))
def q_progress_percent(spark, folder):
    return jobs(spark, folder).select("id", sc.progress_percent(F.col("start_seconds"), F.col("end_seconds"), 20, 70).alias("progress"))


@query("layout_to_phase", with_views("state_samples", """SELECT vod_id, idx, CASE phase WHEN 'talking' THEN 'fullscreen_face' WHEN 'gameplay' THEN 'small_facecam' WHEN 'unknown' THEN 'unknown' ELSE 'no_face' END AS layout,
    CASE phase WHEN 'waiting_or_music' THEN greatest(0, 1 - confidence) WHEN 'unknown' THEN greatest(0, confidence / 4) ELSE confidence END AS layout_confidence FROM state_samples"""))
def q_layout_to_phase(spark, folder):
    from tidemark.config import LAYOUT_TO_PHASE

    back = F.create_map(*[F.lit(x) for layout, phase in LAYOUT_TO_PHASE.items() for x in (phase, layout)])
    return state_samples(spark, folder).select(
        "vod_id", "idx", back[F.col("phase")].alias("layout"),
        sc.layout_confidence(F.col("phase"), F.col("confidence"), F.col("confidence") / 4).alias("layout_confidence"),
    )


@query("elapsed_seconds", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE greatest(0, o_custkey - 200) * 1.0::DOUBLE END AS elapsed FROM orders""")
def q_elapsed_seconds(spark, folder):
    o = table(spark, folder, "orders")
    created = F.when(F.col("o_orderkey") % 11 == 0, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    updated = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") - 200), "yyyy-MM-dd'T'HH:mm:ss")
    return o.select(F.col("o_orderkey").alias("id"), sc.elapsed_seconds(created, updated).alias("elapsed"))


@query("upsert_rows", with_views("jobs", """SELECT coalesce(j.id, c.id) AS id, coalesce(c.status, j.status) AS status, coalesce(c.cache_key, j.cache_key) AS cache_key,
      CASE WHEN c.id IS NOT NULL THEN '2030-01-01' ELSE j.updated_at END AS updated_at FROM jobs j FULL JOIN chg c ON j.id = c.id""",
    chg="SELECT l_orderkey + 10000 AS id, arg_max(CASE WHEN l_linenumber % 2 = 1 THEN 'ready' || l_linenumber END, CASE WHEN l_linenumber % 2 = 1 THEN {'n': l_linenumber, 'p': l_partkey} END) AS status, arg_max(l_suppkey, {'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS cache_key FROM lineitem GROUP BY 1"))
def q_upsert_rows(spark, folder):
    n = F.col("l_linenumber")
    changes = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") + 10000).alias("id"), F.when(n % 2 == 1, F.concat(F.lit("ready"), n.cast("string"))).alias("status"), F.col("l_suppkey").alias("cache_key"), "l_linenumber", "l_partkey")
    return jb.upsert_rows(jobs(spark, folder), changes, "id", ["status", "cache_key"], "2030-01-01", newest=[n, F.col("l_partkey")])


@query("guarded_delete", with_views("jobs", """SELECT w.id, CASE WHEN j.id IS NULL THEN 'not_found' WHEN status = 'processing' THEN 'active' ELSE 'deleted' END AS outcome
    FROM (SELECT DISTINCT l_orderkey * 2 AS id FROM lineitem) w LEFT JOIN jobs j ON w.id = j.id"""))
def q_guarded_delete(spark, folder):
    wanted = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 2).alias("id")).distinct()
    return jb.guarded_delete(jobs(spark, folder), wanted, [*sc.UNDELETABLE, "processing"])[1]


@query("jobs_after_delete", with_views("jobs", """SELECT id, status FROM jobs WHERE NOT (status <> 'processing' AND id IN (SELECT l_orderkey * 2 FROM lineitem))"""))
def q_jobs_after_delete(spark, folder):
    wanted = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 2).alias("id")).distinct()
    return jb.guarded_delete(jobs(spark, folder), wanted, [*sc.UNDELETABLE, "processing"])[0].select("id", "status")


@query("point_lookup", with_views("jobs", "SELECT id, status, start_seconds, end_seconds FROM jobs WHERE id = (SELECT max(o_orderkey) FROM orders)"))
def q_point_lookup(spark, folder):
    newest = table(spark, folder, "orders").agg(F.max("o_orderkey").alias("id"))
    return jobs(spark, folder).join(newest, "id").select("id", "status", "start_seconds", "end_seconds")


@query("validate_rows", """SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, unnest(list_filter([
      CASE WHEN l_quantity NOT BETWEEN 5 AND 45 THEN 'quantity_range' END, CASE WHEN l_discount > 0.08 THEN 'discount_range' END,
      CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'returnflag_enum' END, CASE WHEN l_extendedprice <= l_quantity * 100 THEN 'price_order' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""")
def q_validate_rows(spark, folder):
    rules = {
        "quantity_range": F.col("l_quantity").between(5, 45), "discount_range": F.col("l_discount") <= 0.08,
        "returnflag_enum": F.col("l_returnflag").isin("A", "N"), "price_order": F.col("l_extendedprice") > F.col("l_quantity") * 100,
    }
    return ru.violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"], rules)


@query("validate_job_payload", """SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN length(t) NOT BETWEEN 1 AND 100 THEN 'title_length' END,
      CASE WHEN NOT (p = 'auto' OR regexp_full_match(p, '[a-z0-9][a-z0-9_-]{0,63}')) THEN 'streamer_profile' END,
      CASE WHEN f NOT IN ('horizontal','vertical') THEN 'output_format' END, CASE WHEN v NOT IN ('private','unlisted','public') THEN 'privacy_status' END], lambda x: x IS NOT NULL)) AS rule
    FROM (SELECT o_orderkey, repeat('x', CAST(o_custkey % 120 AS INTEGER)) AS t, lower(o_orderpriority) AS p, CASE o_orderstatus WHEN 'F' THEN 'square' WHEN 'O' THEN 'vertical' ELSE 'horizontal' END AS f,
      CASE WHEN o_orderkey % 4 = 0 THEN 'secret' ELSE 'public' END AS v FROM orders)""")
def q_validate_job_payload(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr("repeat('x', cast(o_custkey % 120 as int))").alias("title"), F.lower("o_orderpriority").alias("profile"),
        F.when(F.col("o_orderstatus") == "F", "square").when(F.col("o_orderstatus") == "O", "vertical").otherwise("horizontal").alias("fmt"),
        F.when(F.col("o_orderkey") % 4 == 0, "secret").otherwise("public").alias("privacy"))
    rules = {
        "title_length": F.length("title").between(1, 100),
        "streamer_profile": (F.col("profile") == "auto") | F.col("profile").rlike("^[a-z0-9][a-z0-9_-]{0,63}$"),
        "output_format": F.col("fmt").isin("horizontal", "vertical"), "privacy_status": F.col("privacy").isin("private", "unlisted", "public"),
    }
    return ru.violations(o, ["id"], rules)


@query("duration_delta_check", """SELECT o_orderkey AS id, greatest(abs(e - r), abs(e - v), abs(v - a)) AS delta, CASE WHEN greatest(abs(e - r), abs(e - v), abs(v - a)) > 0.25 THEN 'duration_mismatch' WHEN o_orderkey % 13 = 0 THEN 'resolution_mismatch' ELSE 'ok' END AS outcome
    FROM (SELECT o_orderkey, o_totalprice / 1000 AS e, o_totalprice / 1000 + (o_custkey % 7) * 0.05::DOUBLE AS r, o_totalprice / 1000 - (o_custkey % 5) * 0.05::DOUBLE AS v, o_totalprice / 1000 + (o_custkey % 3) * 0.05::DOUBLE AS a FROM orders)""")
def q_duration_delta_check(spark, folder):
    o = table(spark, folder, "orders")
    e, c = F.col("o_totalprice") / 1000, F.col("o_custkey")
    r, v, a = e + (c % 7) * 0.05, e - (c % 5) * 0.05, e + (c % 3) * 0.05
    delta = F.greatest(F.abs(e - r), F.abs(e - v), F.abs(v - a))
    return o.select(F.col("o_orderkey").alias("id"), delta.alias("delta"),
        F.when(delta > 0.25, "duration_mismatch").when(F.col("o_orderkey") % 13 == 0, "resolution_mismatch").otherwise("ok").alias("outcome"))


# ---- ranges


def job_durations(spark, folder):
    return jobs(spark, folder).select(F.col("id").alias("vod_id"), F.floor(F.col("o_totalprice") / 200).cast("double").alias("duration"))


_DUR = "SELECT o_orderkey AS vod_id, floor(o_totalprice / 200) AS duration FROM orders"
_WINDOWS = """SELECT vod_id, idx, idx * 30.0::DOUBLE AS start, least(idx * 30.0::DOUBLE + 30, lim) AS "end", lim FROM (
    SELECT vod_id, duration AS lim, unnest(range(CAST(ceil(duration / 30) AS BIGINT))) AS idx FROM d)"""


@query("tumbling_windows", f"""WITH d AS ({_DUR}), w AS ({_WINDOWS}) SELECT vod_id, idx, start, "end",
    round(start + ("end" - start - least(10, "end" - start)) / 2, 3) AS sample_start, round(start + ("end" - start - least(10, "end" - start)) / 2 + least(10, "end" - start), 3) AS sample_end,
    CAST(floor(start / 900) AS BIGINT) AS block_index FROM w""")
def q_tumbling_windows(spark, folder):
    return rg.tumbling_windows(job_durations(spark, folder), ["vod_id"])


@query("window_blocks", f"""WITH d AS ({_DUR}), w AS ({_WINDOWS}) SELECT vod_id, CAST(floor(start / 900) AS BIGINT) AS block_index, count(*) AS windows, min(start) AS start, max("end") AS "end" FROM w GROUP BY 1, 2""")
def q_window_blocks(spark, folder):
    w = rg.tumbling_windows(job_durations(spark, folder), ["vod_id"])
    return w.groupBy("vod_id", "block_index").agg(F.count(F.lit(1)).alias("windows"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("overlapping_chunks", f"""WITH d AS ({_DUR}) SELECT vod_id, idx, idx * 285.0::DOUBLE AS start, least(duration, idx * 285.0::DOUBLE + 300) AS "end" FROM (
    SELECT vod_id, duration, unnest(range(greatest(1, CAST(ceil((duration - 300) / 285) AS BIGINT) + 1))) AS idx FROM d)""")
def q_overlapping_chunks(spark, folder):
    return rg.overlapping_chunks(job_durations(spark, folder), ["vod_id"], chunk=300, overlap=15)


@query("sample_grid", f"""WITH d AS ({_DUR}) SELECT vod_id, idx, round(idx * 60.0::DOUBLE, 3) AS "at" FROM (
    SELECT vod_id, unnest(range(greatest(1, CAST(floor((duration - 1e-6) / 60) AS BIGINT) + 1))) AS idx FROM d)""")
def q_sample_grid(spark, folder):
    return rg.sample_grid(job_durations(spark, folder), ["vod_id"], interval=60.0)


@query("scene_sample_grid", f"""WITH s AS (SELECT vod_id, 0.0::DOUBLE AS a0, duration / 500 AS b0 FROM ({_DUR})),
    g AS (SELECT *, greatest(3, least(12, CAST(ceil((b0 - a0) * 2) AS BIGINT))) AS n, least(0.3, (b0 - a0) / 4) AS m FROM s)
    SELECT vod_id, sample, a0 + m + (greatest(a0 + m, b0 - m) - (a0 + m)) * sample / greatest(1, n - 1) AS "at" FROM (SELECT *, unnest(range(n)) AS sample FROM g)""")
def q_scene_sample_grid(spark, folder):
    scenes = job_durations(spark, folder).select("vod_id", F.lit(0.0).alias("start"), (F.col("duration") / 500).alias("end"))
    return rg.scene_sample_grid(scenes, ["vod_id"])


@query("split_long_ranges", f"""WITH s AS (SELECT vod_id, 10.0::DOUBLE AS a, duration + 10 AS b FROM ({_DUR})), n AS (SELECT *, CASE WHEN b - a > 1200 THEN CAST(ceil((b - a) / 900) AS BIGINT) ELSE 1 END AS n FROM s)
    SELECT vod_id, piece, a + piece * ((b - a) / n) AS start, least(b, a + (piece + 1) * ((b - a) / n)) AS "end", CASE WHEN n > 1 THEN 'long_topic_natural_split' END AS split_reason FROM (SELECT *, unnest(range(n)) AS piece FROM n)""")
def q_split_long_ranges(spark, folder):
    topics = job_durations(spark, folder).select("vod_id", F.lit(10.0).alias("start"), (F.col("duration") + 10).alias("end"))
    return rg.split_long_ranges(topics, ["vod_id"])


@query("pad_ranges", with_views("jobs", """SELECT id, greatest(0, start_seconds - 5.0::DOUBLE) AS safe_start, end_seconds + 5.0::DOUBLE AS safe_end FROM jobs"""))
def q_pad_ranges(spark, folder):
    return rg.pad_ranges(jobs(spark, folder).select("id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))).select("id", "safe_start", "safe_end")


# ---- job tables


@query("read_jobs", with_views("jobs", "SELECT id, status, updated_at, end_seconds - start_seconds > 1800 AS too_long FROM jobs"))
def q_read_jobs(spark, folder):
    flagged = jobs(spark, folder).withColumn("too_long", (F.col("end_seconds") - F.col("start_seconds") > 1800))
    return flagged.select("id", "status", "updated_at", "too_long").orderBy(F.desc("updated_at"), "id")


@query("newest_first", with_views("jobs", "SELECT id, updated_at FROM jobs"))
def q_newest_first(spark, folder):
    return jobs(spark, folder).select("id", "updated_at").orderBy(F.desc("updated_at"), F.desc("id"))


@query("latest_cached_result", with_views("jobs", """SELECT cache_key, id, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY updated_at DESC, id DESC) AS rn FROM jobs WHERE status = 'completed') WHERE rn = 1"""))
def q_latest_cached_result(spark, folder):
    return jb.latest_cached_result(jobs(spark, folder)).select("cache_key", "id", "updated_at")


@query("missing_work", with_views("state_samples", """SELECT p.vod_id, p.idx FROM state_samples p WHERE NOT EXISTS (SELECT 1 FROM state_samples d WHERE d.vod_id = p.vod_id AND d.idx = p.idx AND d.layout_id <> 'error')"""))
def q_missing_work(spark, folder):
    planned = state_samples(spark, folder)
    return jb.missing_work(planned.select("vod_id", "idx"), planned.where("layout_id <> 'error'"), ["vod_id", "idx"])


@query("fill_missing_samples", with_views("state_samples", """SELECT vod_id, idx, CASE WHEN layout_id = 'error' THEN 'unknown' ELSE phase END AS phase, CASE WHEN layout_id = 'error' THEN 0 ELSE confidence END AS confidence,
    CASE WHEN layout_id = 'error' THEN 'sample_unavailable' END AS warning FROM state_samples"""))
def q_fill_missing(spark, folder):
    planned = state_samples(spark, folder)
    done = planned.where("layout_id <> 'error'").select("vod_id", "idx", "phase", "confidence")
    return jb.fill_missing(planned.select("vod_id", "idx"), done, ["vod_id", "idx"], {"phase": F.lit("unknown"), "confidence": F.lit(0.0)}, "sample_unavailable")


_LINKED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey + 1000000 ELSE o_orderkey - 1 END END AS source_job_id,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'processing' END AS status,
    'https://twitch.tv/videos/' || CAST(o_orderkey // 2 AS VARCHAR) AS source_url, o_orderkey // 2 % 100 AS start_seconds, o_orderkey // 2 % 100 + 50 + CASE WHEN o_orderkey % 8 = 7 THEN 1 ELSE 0 END AS end_seconds FROM orders"""


@query("preview_link_check", f"""WITH j AS ({_LINKED}) SELECT a.id, a.source_job_id, CASE WHEN b.id IS NULL THEN 'preview_not_found' WHEN b.status NOT IN ('ready','completed') THEN 'preview_not_ready'
    WHEN a.source_url <> b.source_url OR a.start_seconds <> b.start_seconds OR a.end_seconds <> b.end_seconds THEN 'preview_mismatch' ELSE 'ok' END AS outcome
    FROM j a LEFT JOIN j b ON a.source_job_id = b.id WHERE a.source_job_id IS NOT NULL""")
def q_preview_link_check(spark, folder):
    o = table(spark, folder, "orders")
    k, half = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 2)
    j = o.select(
        k.alias("id"), F.when(k % 2 == 1, F.when(k % 10 == 1, k + 1000000).otherwise(k - 1)).alias("source_job_id"),
        F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("processing").alias("status"),
        F.concat(F.lit("https://twitch.tv/videos/"), half.cast("string")).alias("source_url"), (half % 100).alias("start_seconds"),
        (half % 100 + 50 + F.when(k % 8 == 7, 1).otherwise(0)).alias("end_seconds"))
    return jb.preview_link_check(j)


@query("union_history", """SELECT 'analysis' AS kind, o_orderkey AS id, o_orderpriority AS strategy, NULL::BIGINT AS owner FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'render', l_orderkey, NULL, l_suppkey FROM lineitem""")
def q_union_history(spark, folder):
    analyses = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("phase_detection_strategy"))
    renders = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("owner"))
    merged = jb.union_history(analyses, renders, "1-URGENT")
    return merged.select("kind", "id", F.col("phase_detection_strategy").alias("strategy"), "owner")


@query("artifact_precedence", """SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN 'stored'
      WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') THEN 'embedded' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'derived' ELSE 'missing' END AS artifact_source FROM orders""")
def q_artifact_precedence(spark, folder):
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag", F.col("l_partkey").alias("timeline"))
    best = lambda cond: li.where(cond).groupBy("id").agg(F.max("timeline").alias("timeline"))
    sources = [("stored", best("l_returnflag = 'A'")), ("embedded", best("l_returnflag = 'N'")), ("derived", best("true"))]
    base = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return jb.first_available(base, sources, "id", "timeline").select("id", "artifact_source")


@query("profile_resolution", """SELECT c_custkey, CASE WHEN rq <> 'auto' THEN CASE WHEN rq IN (SELECT s_name FROM supplier) THEN rq END ELSE m END AS profile,
      CASE WHEN rq <> 'auto' THEN CASE WHEN rq IN (SELECT s_name FROM supplier) THEN 'selected_by_user' ELSE 'unknown_profile' END WHEN m IS NOT NULL THEN 'matched_vod_uploader' ELSE 'no_profile_match' END AS reason
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Supplier#' || right(c_name, 9) ELSE 'auto' END AS rq, (SELECT min(s_name) FROM supplier WHERE regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') = 'supplier' || right(c_name, 9)) AS m FROM customer)""")
def q_profile_resolution(spark, folder):
    c = table(spark, folder, "customer")
    number = F.expr("right(c_name, 9)")
    requests = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Supplier#"), number)).otherwise("auto").alias("requested"),
                        F.concat(F.lit("SUPPLIER - "), number).alias("uploader"))
    profiles = table(spark, folder, "supplier").select(F.col("s_name").alias("profile_id"))
    return jb.resolve_profiles(requests, profiles).select("c_custkey", "profile", "reason")


_FMT_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query("pick_audio_format", with_views("formats", f"""SELECT vod_id, audio_only, CASE WHEN abr <> 0 THEN abr WHEN tbr <> 0 THEN tbr ELSE 192 END AS kbps FROM (
    SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY audio_only DESC, CASE WHEN abr <> 0 THEN abr WHEN tbr <> 0 THEN tbr ELSE 192 END, {_FMT_ORDER}) AS rn FROM formats) WHERE rn = 1"""))
def q_pick_audio_format(spark, folder):
    f = formats(spark, folder)
    kbps = F.coalesce(F.nullif("abr", F.lit(0.0)), F.nullif("tbr", F.lit(0.0)), F.lit(192.0))
    best = F.min_by(F.struct("audio_only", kbps.alias("kbps")), F.struct(~F.col("audio_only"), kbps, "ord"))
    return f.groupBy("vod_id").agg(best.alias("b")).select("vod_id", "b.*")


@query("pick_video_format", with_views("formats", f"""SELECT vod_id, height, tbr FROM (
    SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY height BETWEEN 144 AND 480 DESC, abs(height - 360), tbr, {_FMT_ORDER}) AS rn FROM formats) WHERE rn = 1"""))
def q_pick_video_format(spark, folder):
    f = formats(spark, folder)
    height = F.coalesce(F.nullif("height", F.lit(0)), F.lit(360))
    rate = F.coalesce(F.nullif("tbr", F.lit(0.0)), F.lit(5000.0))
    in_range = F.coalesce(F.col("height"), F.lit(0)).between(144, 480)
    best = F.min_by(F.struct("height", "tbr"), F.struct(~in_range, F.abs(height - 360), rate, "ord"))
    return f.groupBy("vod_id").agg(best.alias("b")).select("vod_id", "b.*")


@query("format_summary_projection", with_views("formats", """SELECT vod_id, count(*) AS formats, count(CASE WHEN audio_only THEN 1 END) AS audio_formats, max(height) AS best_height FROM formats GROUP BY 1"""))
def q_format_summary(spark, folder):
    f = formats(spark, folder)
    # The kept fields only; addresses and headers never enter the projection.
    kept = f.select("vod_id", F.struct("abr", "tbr", "height", "audio_only").alias("fmt"))
    return kept.groupBy("vod_id").agg(
        F.count(F.lit(1)).alias("formats"), F.count_if("fmt.audio_only").alias("audio_formats"), F.max("fmt.height").alias("best_height"))


@query("sort_detections", with_views("rects", """SELECT clip_id, frame_index, det_a, det_b, det_c, row_number() OVER (PARTITION BY clip_id, frame_index ORDER BY confidence DESC, width * height DESC, det_a, det_b, det_c) AS rank FROM rects"""))
def q_sort_detections(spark, folder):
    from tidemark.operators.chunked import ordered_scan

    r = rects(spark, folder).withColumns({"neg_conf": -F.col("confidence"), "neg_area": -F.col("width") * F.col("height")})
    # Confidences lie in [0, 1]; a thousand bands spread a crowded frame over tasks.
    band = F.floor(F.col("neg_conf") * 1000).cast("long")
    ranked = ordered_scan(r, ["clip_id", "frame_index"], ["neg_conf", "neg_area", "det_a", "det_b", "det_c"], band, row_number="rank")
    return ranked.select("clip_id", "frame_index", "det_a", "det_b", "det_c", F.col("rank").cast("long").alias("rank"))
