"""Registered queries: silence plans, regions, interval joins, scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import GAMEPLAY_CHAPTER_WORDS, TALKING_CHAPTER_WORDS
from tidemark.operators import intervals as iv
from tidemark.operators import timeline as tl
from tidemark.operators.chunked import index_chunk, number_runs
from tidemark.plans.catalog_timeline import SEGMENTS, layout_segs
from tidemark.plans.registry import Registry
from tidemark.plans.views import clip_durations, segments, silences, state_samples, table, with_views

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

CUTS = {
    "c1": """SELECT s.clip_id, greatest(0, start) AS s, least(source_duration, "end") AS e FROM silences s JOIN clip_durations d ON s.clip_id = d.clip_id""",
    "c2": "SELECT *, e - s AS d, CASE WHEN e - s > 2.5 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS keep FROM c1 WHERE e - s >= 1.2::DOUBLE",
    "c3": "SELECT clip_id, s + keep / 2 AS a, e - keep / 2 AS b FROM c2 WHERE d - keep > 0.05::DOUBLE",
    "c4": "SELECT *, max(b) OVER (PARTITION BY clip_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM c3",
    "c5": "SELECT *, sum(CASE WHEN pm IS NULL OR a > pm THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY a, b) - 1 AS cut FROM c4",
    "cuts": """SELECT clip_id, CAST(cut AS BIGINT) AS cut, min(a) AS start, max(b) AS "end" FROM c5 GROUP BY 1, 2""",
}


@query("silence_cut_list", with_views("silences clip_durations", "SELECT * FROM cuts", **CUTS))
def q_silence_cut_list(spark, folder):
    s = silences(spark, folder)
    return iv.silence_cuts(s, clip_durations(s))


@query("keep_list", with_views("silences clip_durations", """SELECT clip_id, a AS source_start, b AS source_end,
      coalesce(sum(b - a) OVER (PARTITION BY clip_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS output_start FROM pieces WHERE b > a + 0.01::DOUBLE""", **CUTS,
    pieces="""SELECT clip_id, coalesce(lag("end") OVER (PARTITION BY clip_id ORDER BY cut), 0) AS a, start AS b FROM cuts
        UNION ALL SELECT d.clip_id, coalesce(m, 0), source_duration FROM clip_durations d LEFT JOIN (SELECT clip_id, max("end") AS m FROM cuts GROUP BY 1) c ON d.clip_id = c.clip_id"""))
def q_keep_list(spark, folder):
    s = silences(spark, folder)
    d = clip_durations(s)
    return iv.keep_list(iv.silence_cuts(s, d), d)


@query("speech_region_stats", with_views("silences clip_durations", """
    SELECT d.clip_id, least(1, voiced / source_duration) AS voice_ratio, voiced AS voiced_seconds, longest AS longest_speech_run, n AS number_of_speech_regions,
      greatest(quiet, source_duration - reach) AS longest_silence, first_s AS speech_start_delay, source_duration - last_e AS speech_end_margin,
      greatest(0, 1 - least(1, voiced / source_duration)) AS silence_ratio, least(1, longest / source_duration * 1.5::DOUBLE) AS speech_continuity
    FROM clip_durations d JOIN (SELECT clip_id, sum(e - s) AS voiced, max(e - s) AS longest, count(*) AS n, max(greatest(0, s - coalesce(cur, 0))) AS quiet, max(e) AS reach, min(s) AS first_s, max_by(e, s) AS last_e FROM r GROUP BY 1) f ON d.clip_id = f.clip_id""",
    r="""SELECT s.clip_id, start AS s, "end" AS e, max("end") OVER (PARTITION BY s.clip_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM silences s WHERE "end" > start"""))
def q_speech_region_stats(spark, folder):
    s = silences(spark, folder)
    return iv.speech_region_stats(s, clip_durations(s))


_LOG = """CASE layout_id WHEN 'error' THEN '[silencedetect] silence_start: ' || CAST(frame_timestamp AS VARCHAR) WHEN 'view' THEN '[silencedetect] silence_end: ' || CAST(frame_timestamp AS VARCHAR) || ' | silence_duration: 1' ELSE 'frame=' || CAST(idx AS VARCHAR) END"""


@query("scan_silence_log", with_views("state_samples", """
    SELECT m.vod_id, CASE WHEN kind = 'end' THEN pv ELSE v END AS start, CASE WHEN kind = 'end' THEN v ELSE duration END AS "end"
    FROM m JOIN (SELECT vod_id, max(frame_timestamp) + 2.0::DOUBLE AS duration FROM state_samples GROUP BY 1) d ON m.vod_id = d.vod_id
    WHERE (kind = 'end' AND pk = 'start' AND v > pv) OR (kind = 'start' AND nk IS NULL)""",
    m0="SELECT vod_id, idx, CASE layout_id WHEN 'error' THEN 'start' ELSE 'end' END AS kind, frame_timestamp AS v FROM state_samples WHERE layout_id IN ('error', 'view')",
    m="SELECT *, lag(kind) OVER w AS pk, lag(v) OVER w AS pv, lead(kind) OVER w AS nk FROM m0 WINDOW w AS (PARTITION BY vod_id ORDER BY idx)"))
def q_scan_silence_log(spark, folder):
    s = state_samples(spark, folder)
    lines = s.select("vod_id", "idx", F.expr(_LOG.replace("VARCHAR", "STRING")).alias("line"))
    return iv.scan_silence_log(lines, tl.durations_of(s), ["vod_id"], "idx", "line").select("vod_id", "start", "end")


@query("detect_silence_from_levels", with_views("state_samples", """
    SELECT vod_id, min(frame_timestamp) AS start, max(frame_timestamp) + 2.0::DOUBLE AS "end" FROM (
      SELECT *, sum(nb) OVER (PARTITION BY vod_id ORDER BY idx) AS isl FROM (
        SELECT *, confidence < 0.5 AS quiet, CASE WHEN lag(confidence < 0.5) OVER (PARTITION BY vod_id ORDER BY idx) = (confidence < 0.5) THEN 0 ELSE 1 END AS nb FROM state_samples)) WHERE quiet
    GROUP BY vod_id, isl HAVING max(frame_timestamp) + 2.0::DOUBLE - min(frame_timestamp) >= 4"""))
def q_detect_silence(spark, folder):
    return iv.quiet_intervals(state_samples(spark, folder), ["vod_id"], "idx", "frame_timestamp", F.col("confidence") < 0.5, 2.0, 4.0)


@query("overlap_join", with_views("segments", """
    SELECT t.vod_id, t.topic, s.pos FROM (SELECT vod_id, pos AS topic, start, start + 25.0::DOUBLE AS "end" FROM segments) t JOIN segments s
    ON t.vod_id = s.vod_id AND s."end" > t.start AND s.start < t."end" """))
def q_overlap_join(spark, folder):
    s = segments(spark, folder)
    topics = s.select("vod_id", F.col("pos").alias("topic"), "start", (F.col("start") + 25).alias("end"))
    parts = s.select("vod_id", "pos", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))
    return iv.overlap_join(topics, parts, bucket=20.0).select("vod_id", "topic", "pos")


_CHAPTERS = """SELECT vod_id, idx AS chapter_ord, frame_timestamp AS start_time, CASE WHEN k % 5 = 0 THEN NULL ELSE frame_timestamp + k / 2.0 END AS end_time,
    CASE k % 4 WHEN 0 THEN 'Just Chatting' WHEN 1 THEN 'Jugando al juego' WHEN 2 THEN 'intro' ELSE 'Final GAME' END AS title FROM {source} WHERE phase = 'gameplay'"""


@query("chapter_asof_join", with_views("state_samples", """
    SELECT s.vod_id, s.idx, h.hint AS chapter_phase, CASE h.hint WHEN 'talking' THEN 'chapter_title_chatting_hint' WHEN 'gameplay' THEN 'chapter_title_gameplay_hint' END AS chapter_reason
    FROM state_samples s LEFT JOIN (SELECT vod_id, idx, min_by(hint, chapter_ord) AS hint FROM (
      SELECT s.vod_id, s.idx, c.chapter_ord, c.hint FROM state_samples s JOIN hinted c ON s.vod_id = c.vod_id AND c.start_time <= s.frame_timestamp + 1 AND s.frame_timestamp + 1 < coalesce(c.end_time, 1e18)) GROUP BY 1, 2) h
    ON s.vod_id = h.vod_id AND s.idx = h.idx""",
    chapters=_CHAPTERS.format(source="state_samples"),
    hinted="SELECT *, CASE WHEN contains(lower(title), 'chat') THEN 'talking' ELSE 'gameplay' END AS hint FROM chapters WHERE title <> 'intro' AND start_time < coalesce(end_time, 1e18)"))
def q_chapter_asof(spark, folder):
    s = state_samples(spark, folder)
    k = F.col("k")
    chapters = s.where("phase = 'gameplay'").select(
        "vod_id", F.col("idx").alias("chapter_ord"), F.col("frame_timestamp").alias("start_time"),
        F.when(k % 5 != 0, F.col("frame_timestamp") + k / 2.0).alias("end_time"),
        F.when(k % 4 == 0, "Just Chatting").when(k % 4 == 1, "Jugando al juego").when(k % 4 == 2, "intro").otherwise("Final GAME").alias("title"))
    windows = s.select("vod_id", "idx", F.col("frame_timestamp").alias("start"), (F.col("frame_timestamp") + 2).alias("end"))
    return iv.chapter_hints(windows, chapters, ["vod_id"], TALKING_CHAPTER_WORDS, GAMEPLAY_CHAPTER_WORDS, bucket=30.0)


@query("contained_windows", with_views("state_samples", """SELECT g.vod_id, g.run, count(*) AS windows FROM segs g JOIN state_samples s
    ON s.vod_id = g.vod_id AND g.start <= s.frame_timestamp AND s.frame_timestamp + 2 <= g."end" GROUP BY 1, 2""", **SEGMENTS))
def q_contained_windows(spark, folder):
    segs = layout_segs(spark, folder).select("vod_id", "run", "start", "end")
    w = state_samples(spark, folder).select("vod_id", "idx", F.col("frame_timestamp").alias("w_start"), (F.col("frame_timestamp") + 2).alias("w_end"))
    inside = (F.col("start") <= F.col("w_start")) & (F.col("w_end") <= F.col("end"))
    return iv.range_join(segs, w, ["vod_id"], ("start", "end"), ("w_start", "w_end"), inside, 30.0).groupBy("vod_id", "run").agg(F.count(F.lit(1)).alias("windows"))


@query("point_in_segment", with_views("state_samples", """SELECT s.vod_id, s.idx, min(g.run) AS run FROM state_samples s JOIN segs g ON s.vod_id = g.vod_id AND g.start <= s.frame_timestamp AND s.frame_timestamp <= g."end" GROUP BY 1, 2""", **SEGMENTS))
def q_point_in_segment(spark, folder):
    segs = layout_segs(spark, folder).select("vod_id", "run", "start", "end")
    p = state_samples(spark, folder).select("vod_id", "idx", F.col("frame_timestamp").alias("p_at"), F.col("frame_timestamp").alias("p_at2"))
    inside = (F.col("start") <= F.col("p_at")) & (F.col("p_at") <= F.col("end"))
    return iv.range_join(segs, p, ["vod_id"], ("start", "end"), ("p_at", "p_at2"), inside, 30.0).groupBy("vod_id", "idx").agg(F.min("run").alias("run"))


@query("index_lookup_join", with_views("state_samples", """SELECT vod_id, idx, layout_id, accepted, accepted <> layout_id AS changed FROM confirmed""", **SEGMENTS))
def q_index_lookup_join(spark, folder):
    raw = state_samples(spark, folder)
    smooth = tl.hysteresis(raw, confirmation=2).select("vod_id", "idx", "accepted")
    return raw.select("vod_id", "idx", "layout_id").join(smooth, ["vod_id", "idx"]).withColumn("changed", F.col("accepted") != F.col("layout_id"))


@query("rounded_boundary_join", with_views("state_samples", """
    SELECT p.vod_id, p.start, p."end", g.layout_id FROM praw p LEFT JOIN segs g ON p.vod_id = g.vod_id AND CAST(round(p.start * 1000) AS BIGINT) = CAST(round(g.start * 1000) AS BIGINT) AND CAST(round(p."end" * 1000) AS BIGINT) = CAST(round(g."end" * 1000) AS BIGINT)""",
    **SEGMENTS,
    p1="SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY vod_id ORDER BY idx) = phase THEN 0 ELSE 1 END AS nbp FROM state_samples",
    p2="SELECT *, sum(nbp) OVER (PARTITION BY vod_id ORDER BY idx) AS isl FROM p1",
    praw="""SELECT vod_id, min(frame_timestamp) AS start, max(frame_timestamp) + 2.0::DOUBLE AS "end" FROM p2 GROUP BY vod_id, isl"""))
def q_rounded_boundary_join(spark, folder):
    s = state_samples(spark, folder)
    millis = lambda c: F.round(F.col(c) * 1000).cast("long")
    phases = number_runs(s, ["vod_id"], ["idx"], index_chunk("idx"), "phase").groupBy("vod_id", "run").agg(
        F.min("frame_timestamp").alias("start"), (F.max("frame_timestamp") + 2).alias("end")).withColumns({"a": millis("start"), "b": millis("end")})
    segs = layout_segs(spark, folder).select("vod_id", "layout_id", millis("start").alias("a"), millis("end").alias("b"))
    return phases.join(segs, ["vod_id", "a", "b"], "left").select("vod_id", "start", "end", "layout_id")


@query("scene_cuts", with_views("state_samples", """SELECT vod_id, "at" FROM walk""",
    cand="SELECT vod_id, idx * 0.5::DOUBLE AS \"at\" FROM state_samples WHERE confidence >= 0.4",
    walk="""SELECT * FROM (WITH RECURSIVE w(vod_id, "at") AS (SELECT vod_id, min("at") FROM cand GROUP BY 1
      UNION ALL SELECT w.vod_id, (SELECT min(c."at") FROM cand c WHERE c.vod_id = w.vod_id AND c."at" >= w."at" + 1.5) FROM w
        WHERE EXISTS (SELECT 1 FROM cand c WHERE c.vod_id = w.vod_id AND c."at" >= w."at" + 1.5)) SELECT * FROM w)"""))
def q_scene_cuts(spark, folder):
    s = state_samples(spark, folder).withColumn("at", F.col("idx") * 0.5)
    return iv.scene_cuts(s, ["vod_id"], "at", "confidence", 0.4, 1.5)


def scenes(spark, folder):
    """Raw states as scenes: consecutive equal states at two samples per second."""
    s = state_samples(spark, folder).withColumn("at", F.col("idx") * 0.5)
    runs = number_runs(s, ["vod_id"], ["idx"], index_chunk("idx"), "layout_id")
    return runs.groupBy("vod_id", "run").agg(F.min("at").alias("start"), (F.max("at") + 0.5).alias("end"), F.min("layout_id").alias("layout_id"))


SCENES = {
    "g1": "SELECT *, CASE WHEN lag(layout_id) OVER (PARTITION BY vod_id ORDER BY idx) = layout_id THEN 0 ELSE 1 END AS nb FROM state_samples",
    "g2": "SELECT *, CAST(sum(nb) OVER (PARTITION BY vod_id ORDER BY idx) - 1 AS BIGINT) AS run FROM g1",
    "scenes": """SELECT vod_id, run, min(idx) * 0.5::DOUBLE AS start, max(idx) * 0.5::DOUBLE + 0.5::DOUBLE AS "end", min(layout_id) AS layout_id FROM g2 GROUP BY 1, 2""",
}


@query("merge_short_scenes", with_views("state_samples", """SELECT vod_id, CAST(scene AS BIGINT) AS scene, min(start) AS start, max("end") AS "end" FROM (
    SELECT *, sum(CASE WHEN "end" - start >= 1 OR run = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY vod_id ORDER BY start) - 1 AS scene FROM scenes) GROUP BY 1, 2""", **SCENES))
def q_merge_short_scenes(spark, folder):
    return iv.merge_short_scenes(scenes(spark, folder), ["vod_id"], 1.0)


@query("scenes_between_cuts", with_views("state_samples", """SELECT vod_id, "at" AS start, coalesce(lead("at") OVER (PARTITION BY vod_id ORDER BY "at"), duration) AS "end" FROM (
    SELECT vod_id, 0.0::DOUBLE AS "at", duration FROM d UNION ALL SELECT s.vod_id, frame_timestamp, duration FROM state_samples s JOIN d ON s.vod_id = d.vod_id WHERE confidence >= 0.7 AND idx > 0)""",
    d="SELECT vod_id, max(frame_timestamp) + 2.0::DOUBLE AS duration FROM state_samples GROUP BY 1"))
def q_scenes_between(spark, folder):
    s = state_samples(spark, folder)
    cuts = s.where("confidence >= 0.7 AND idx > 0").select("vod_id", F.col("frame_timestamp").alias("at"))
    return iv.scenes_between(cuts, tl.durations_of(s), ["vod_id"])


@query("coverage_check", with_views("state_samples", """
    SELECT vod_id, run, CASE WHEN abs(a - cur) <= 0.15 THEN cur ELSE a END AS snapped_start, CASE WHEN a < cur - 0.02 OR b <= a THEN 'invalid_times' WHEN a > cur + 0.15 THEN 'uncovered_gap'
      WHEN nx IS NULL AND abs(b - duration) > 0.2 THEN 'end_not_covered' END AS problem
    FROM (SELECT f.*, duration, coalesce(lag(b) OVER w, 0) AS cur, lead(a) OVER w AS nx FROM f JOIN (SELECT vod_id, max("end") + 0.1::DOUBLE * (vod_id % 4) AS duration FROM scenes GROUP BY 1) d ON f.vod_id = d.vod_id WINDOW w AS (PARTITION BY f.vod_id ORDER BY run))""", **SCENES,
    f="""SELECT vod_id, run, start + (run % 5) * 0.0625::DOUBLE AS a, "end" + (run % 3) * 0.03125::DOUBLE AS b FROM scenes"""))
def q_coverage_check(spark, folder):
    sc = scenes(spark, folder)
    moved = sc.select("vod_id", "run", (F.col("start") + F.col("run") % 5 * 0.0625).alias("start"), (F.col("end") + F.col("run") % 3 * 0.03125).alias("end"))
    d = sc.groupBy("vod_id").agg((F.max("end") + 0.1 * (F.col("vod_id") % 4)).alias("duration"))
    return iv.coverage_problems(moved, d, ["vod_id"], "run")


