"""Registered queries over state timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import timeline as tl
from tidemark.operators.chunked import index_chunk, number_runs
from tidemark.plans.registry import Registry
from tidemark.plans.views import state_samples, with_views

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def joined(column: str):
    return F.array_join(column, ",")


def hysteresis_sql(k: int) -> dict[str, str]:
    return {
        "h1": "SELECT *, CASE WHEN lag(layout_id) OVER (PARTITION BY vod_id ORDER BY idx) = layout_id THEN 0 ELSE 1 END AS nb FROM state_samples",
        "h2": "SELECT *, sum(nb) OVER (PARTITION BY vod_id ORDER BY idx) AS isl FROM h1",
        "h3": "SELECT *, count(*) OVER (PARTITION BY vod_id, isl) AS n FROM h2",
        "h4": f"""SELECT * EXCLUDE (nb, isl, n), coalesce(
              last_value(CASE WHEN n >= {k} THEN layout_id END IGNORE NULLS) OVER (PARTITION BY vod_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              first_value(layout_id) OVER (PARTITION BY vod_id ORDER BY idx)) AS accepted FROM h3""",
        "h5": "SELECT *, lag(accepted) OVER (PARTITION BY vod_id ORDER BY idx) AS prior FROM h4",
        "confirmed": """SELECT *, CASE WHEN accepted <> layout_id THEN 'layout_hysteresis_suppressed_transition'
              WHEN prior <> accepted THEN 'layout_transition_confirmed' END AS hysteresis_reason FROM h5""",
    }


SEGMENTS = {
    **hysteresis_sql(2),
    "dur": "SELECT vod_id, max(frame_timestamp) + 2.0::DOUBLE AS duration FROM state_samples GROUP BY 1",
    "s1": "SELECT *, CASE WHEN prior = accepted THEN 0 ELSE 1 END AS nb2 FROM confirmed",
    "s2": "SELECT *, sum(nb2) OVER (PARTITION BY vod_id ORDER BY idx) - 1 AS run FROM s1",
    "s3": """SELECT s2.vod_id, CAST(run AS BIGINT) AS run, min(accepted) AS layout_id, min(frame_timestamp) AS start,
             least(min(duration), max(frame_timestamp) + 2.0::DOUBLE) AS "end", count(*) AS sample_count, median(confidence) AS confidence
             FROM s2 JOIN dur ON s2.vod_id = dur.vod_id GROUP BY 1, 2""",
    "segs": """SELECT *, CASE WHEN layout_id IN ('click','signup') THEN 'talking' WHEN layout_id = 'view' THEN 'gameplay'
               WHEN layout_id = 'purchase' THEN 'waiting_or_music' ELSE 'unknown' END AS phase FROM s3 WHERE "end" > start""",
}


def layout_segs(spark, folder) -> DataFrame:
    return tl.layout_segments(state_samples(spark, folder), confirmation=2)


@query("hysteresis", with_views("state_samples", "SELECT vod_id, idx, layout_id, accepted, hysteresis_reason FROM confirmed", **hysteresis_sql(3)))
def q_hysteresis(spark, folder):
    return tl.hysteresis(state_samples(spark, folder), confirmation=3).select("vod_id", "idx", "layout_id", "accepted", "hysteresis_reason")


DETAIL = {
    **SEGMENTS,
    "d0": "SELECT vod_id, CAST(run AS BIGINT) AS run, idx, k, list_filter([CASE WHEN k % 9 = 0 THEN 'high_motion' END, CASE WHEN k % 4 = 0 THEN 'calm' END, hysteresis_reason], lambda x: x IS NOT NULL) AS reasons, CASE WHEN k % 10 = 0 THEN ['late'] ELSE [] END AS warnings FROM s2",
    "d1": "SELECT vod_id, run, median((k * 7) % 100 / 100.0::DOUBLE) AS match_score, median((k * 3) % 50 / 100.0::DOUBLE) AS second_best_score, median(CASE WHEN k % 5 > 0 THEN k / 200.0::DOUBLE END) AS score_margin FROM d0 GROUP BY 1, 2",
    "d2": "SELECT vod_id, run, kind, string_agg(x, ',' ORDER BY i, p) AS labels FROM (SELECT vod_id, run, kind, x, min(idx) AS i, arg_min(p, idx) AS p FROM (SELECT vod_id, run, idx, 'r' AS kind, unnest(reasons) AS x, generate_subscripts(reasons, 1) AS p FROM d0 UNION ALL SELECT vod_id, run, idx, 'w', unnest(warnings), 1 FROM d0) GROUP BY vod_id, run, kind, x) GROUP BY vod_id, run, kind",
}


@query("merge_state_runs", with_views("state_samples", """SELECT s.vod_id, s.run, layout_id, phase, start, "end", sample_count, confidence, match_score, second_best_score, score_margin,
    coalesce(r.labels, '') AS reasons, coalesce(w.labels, '') AS warnings FROM segs s JOIN d1 USING (vod_id, run) LEFT JOIN d2 r ON r.vod_id = s.vod_id AND r.run = s.run AND r.kind = 'r' LEFT JOIN d2 w ON w.vod_id = s.vod_id AND w.run = s.run AND w.kind = 'w'""", **DETAIL))
def q_merge_state_runs(spark, folder):
    segs = detail_segs(spark, folder)
    return segs.select("vod_id", "run", "layout_id", "phase", "start", "end", "sample_count", *SCORES, joined("reasons").alias("reasons"), joined("warnings").alias("warnings"))


SCORES = ["confidence", "match_score", "second_best_score", "score_margin"]


def detail_segs(spark, folder) -> DataFrame:
    """Segments with the medians of their scores, reasons and warnings."""
    k = F.col("k")
    samples = state_samples(spark, folder).withColumns({
        "match_score": F.pmod(k * 7, F.lit(100)) / 100.0, "second_best_score": F.pmod(k * 3, F.lit(50)) / 100.0, "score_margin": F.when(k % 5 > 0, k / 200.0),
        "reasons": F.array_compact(F.array(F.when(k % 9 == 0, "high_motion"), F.when(k % 4 == 0, "calm"))), "warnings": F.array_compact(F.array(F.when(k % 10 == 0, "late"))),
    })
    return tl.layout_segments(samples, confirmation=2, median_of=SCORES, labels=["reasons", "warnings"])


@query("state_durations", with_views("state_samples", """
    SELECT vod_id, sum(CASE WHEN phase='waiting_or_music' THEN "end"-start ELSE 0 END) AS waiting_seconds,
      sum(CASE WHEN phase='talking' THEN "end"-start ELSE 0 END) AS talking_seconds,
      sum(CASE WHEN phase='gameplay' THEN "end"-start ELSE 0 END) AS gameplay_seconds,
      sum(CASE WHEN phase='unknown' THEN "end"-start ELSE 0 END) AS unknown_seconds FROM segs GROUP BY 1""", **SEGMENTS))
def q_state_durations(spark, folder):
    return tl.state_durations(tl.layout_segments(state_samples(spark, folder), confirmation=2, median_of=()))


@query("transitions", with_views("state_samples", """
    SELECT vod_id, run, phase, lag(phase) OVER w || '_to_' || phase AS transition_in,
      phase || '_to_' || lead(phase) OVER w AS transition_out FROM segs WINDOW w AS (PARTITION BY vod_id ORDER BY run)""", **SEGMENTS))
def q_transitions(spark, folder):
    return tl.transitions(layout_segs(spark, folder)).select("vod_id", "run", "phase", "transition_in", "transition_out")


ROBUST = """WITH r AS (SELECT {keys}, confidence, row_number() OVER (PARTITION BY {keys} ORDER BY confidence) - 1 AS rn,
      count(*) OVER (PARTITION BY {keys}) AS n FROM {source})
    SELECT {keys}, least(1, greatest(0, 0.6::DOUBLE * median(confidence) + 0.4::DOUBLE * avg(confidence))) AS robust_confidence
    FROM r WHERE rn >= floor(n / 10) AND rn < n - floor(n / 10) GROUP BY {keys}"""


@query("robust_confidence", with_views("state_samples", "SELECT * FROM (" + ROBUST.format(keys="vod_id, layout_id", source="state_samples") + ")"))
def q_robust_confidence(spark, folder):
    return tl.robust_confidence(state_samples(spark, folder), ["vod_id", "layout_id"])


BLOCKS = {
    **SEGMENTS,
    "b1": """SELECT *, lead(phase) OVER w AS np, lead(confidence) OVER w AS nc FROM segs WINDOW w AS (PARTITION BY vod_id ORDER BY run)""",
    "b2": """SELECT *, "end" - start AS duration_seconds, row_number() OVER (PARTITION BY vod_id ORDER BY run) AS number FROM b1 WHERE phase = 'talking'""",
    "b3": """SELECT *, min(CASE WHEN duration_seconds >= 8 THEN number END) OVER (PARTITION BY vod_id) AS pn FROM b2""",
    "blocks": """SELECT vod_id, 'talking-' || lpad(CAST(number AS VARCHAR), 3, '0') AS id, number, start, "end", duration_seconds, confidence,
        coalesce(number = pn, false) AS is_primary,
        CASE WHEN number = pn THEN 'primary' WHEN duration_seconds >= 8 THEN 'secondary' WHEN duration_seconds >= 4 THEN 'low_priority' ELSE 'ignored' END AS relevance,
        CASE WHEN number = pn THEN 'primary_initial_long_talking_block,' ELSE '' END ||
        CASE WHEN duration_seconds >= 8 THEN 'long_sustained_conversation' WHEN duration_seconds >= 4 THEN 'short_sustained_conversation' ELSE 'below_relevant_talking_duration' END ||
        CASE WHEN confidence >= 0.65 THEN ',consistent_talking_window_scores' ELSE '' END AS selection_reason,
        CASE WHEN np IS NULL THEN 'end_of_analysis' WHEN np = 'gameplay' AND nc >= 0.5 THEN 'gameplay_transition' WHEN np = 'unknown' THEN 'unknown_transition'
             WHEN nc < 0.5 THEN 'low_confidence_transition' ELSE 'other_transition' END AS end_transition FROM b3""",
}


def blocks_of(segs: DataFrame) -> DataFrame:
    return tl.classify_blocks(segs, minimum=8, sustained=4)


def blocks(spark, folder) -> DataFrame:
    return blocks_of(layout_segs(spark, folder))


@query("classify_blocks", with_views("state_samples", "SELECT * FROM blocks", **BLOCKS))
def q_classify_blocks(spark, folder):
    return blocks(spark, folder).withColumn("selection_reason", joined("selection_reason")).drop("run")


@query("primary_block", with_views("state_samples", """
    SELECT v.vod_id, min(CASE WHEN is_primary THEN id END) AS primary_talking_block_id,
      CASE WHEN min(CASE WHEN is_primary THEN id END) IS NULL THEN 'primary_talking_block_not_found' END AS warning
    FROM (SELECT DISTINCT vod_id FROM state_samples) v LEFT JOIN blocks b ON v.vod_id = b.vod_id GROUP BY 1""", **BLOCKS))
def q_primary_block(spark, folder):
    all_vods = state_samples(spark, folder).select("vod_id").distinct()
    found = tl.primary_block(blocks(spark, folder), minimum=8).drop("number")
    return all_vods.join(found, "vod_id", "left").withColumn(
        "warning", F.when(F.col("primary_talking_block_id").isNull(), "primary_talking_block_not_found")
    )


@query("budgeted_selection", with_views("state_samples", """
    SELECT vod_id, id, CAST(priority AS BIGINT) AS priority, selected FROM (
      SELECT r.vod_id, r.id, r.priority, coalesce(list_contains(g.chosen, r.priority), false) AS selected
      FROM ranked r JOIN last_step g ON r.vod_id = g.vod_id)""", **BLOCKS,
    ranked="""SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY is_primary DESC, confidence DESC, duration_seconds DESC, number) AS priority
              FROM blocks WHERE duration_seconds >= 8""",
    greedy="""SELECT * FROM (WITH RECURSIVE g(vod_id, step, total, chosen) AS (
        SELECT DISTINCT vod_id, 0::BIGINT, 0.0::DOUBLE, []::BIGINT[] FROM ranked
        UNION ALL
        SELECT g.vod_id, g.step + 1, CASE WHEN ok THEN total + duration_seconds ELSE total END, CASE WHEN ok THEN list_append(chosen, g.step + 1) ELSE chosen END
        FROM (SELECT g.*, r.duration_seconds, len(g.chosen) < 3 AND (len(g.chosen) = 0 OR g.total + r.duration_seconds <= 24) AS ok
              FROM g JOIN ranked r ON r.vod_id = g.vod_id AND r.priority = g.step + 1) g)
        SELECT * FROM g)""",
    last_step="SELECT vod_id, max_by(chosen, step) AS chosen FROM greedy GROUP BY 1"))
def q_budgeted_selection(spark, folder):
    picked = tl.budgeted_selection(blocks(spark, folder), minimum=8, max_count=3, max_total=24)
    return picked.select("vod_id", "id", F.col("priority").cast("long").alias("priority"), "selected")


@query("layout_timeline", with_views("state_samples", """
    SELECT s.vod_id, any_value(n.segments) AS segments, count(*) AS completed_samples, count(*) AS total_samples,
      CASE WHEN bool_and(phase = 'unknown') THEN 'layout_no_determinable_samples' ELSE '' END AS warnings
    FROM state_samples s JOIN (SELECT vod_id, count(*) AS segments FROM segs GROUP BY 1) n ON s.vod_id = n.vod_id GROUP BY 1""", **SEGMENTS))
def q_layout_timeline(spark, folder):
    return tl.layout_timeline(state_samples(spark, folder), confirmation=2).withColumn("warnings", joined("warnings"))


@query("phase_from_layout", with_views("state_samples", """
    SELECT c.vod_id, c.idx, c.frame_timestamp AS start, least(d.duration, c.frame_timestamp + 2.0::DOUBLE) AS "end", c.phase AS raw_phase,
      CASE WHEN accepted IN ('click','signup') THEN 'talking' WHEN accepted = 'view' THEN 'gameplay'
           WHEN accepted = 'purchase' THEN 'waiting_or_music' ELSE 'unknown' END AS phase,
      CASE WHEN c.phase = 'waiting_or_music' THEN confidence ELSE 0 END AS waiting_or_music,
      CASE WHEN c.phase = 'talking' THEN confidence ELSE 0 END AS talking,
      CASE WHEN c.phase = 'gameplay' THEN confidence ELSE 0 END AS gameplay,
      CASE WHEN c.phase = 'unknown' THEN confidence ELSE 0 END AS unknown,
      CASE WHEN accepted <> layout_id THEN 'layout_hysteresis' ELSE '' END AS smoothing_reasons
    FROM confirmed c JOIN dur d ON c.vod_id = d.vod_id""", **SEGMENTS))
def q_phase_from_layout(spark, folder):
    from tidemark.operators.phases import windows_from_layout

    samples = state_samples(spark, folder)
    out = windows_from_layout(tl.hysteresis(samples, confirmation=2), samples, tl.durations_of(samples))
    return out.withColumn("smoothing_reasons", joined("smoothing_reasons"))


@query("ordered_distinct_union", with_views("state_samples", """
    SELECT vod_id, string_agg(layout_id, ',' ORDER BY first_at) AS states FROM (
      SELECT vod_id, layout_id, min(idx) AS first_at FROM state_samples GROUP BY 1, 2) GROUP BY 1"""))
def q_ordered_distinct_union(spark, folder):
    rows = state_samples(spark, folder).withColumn("labels", F.array("layout_id"))
    return tl.ordered_labels(rows, ["vod_id"], "labels", "idx", "states").withColumn("states", joined("states"))


@query("run_numbers", with_views("state_samples", """
    SELECT vod_id, idx, CAST(sum(nb) OVER (PARTITION BY vod_id ORDER BY idx) - 1 AS BIGINT) AS run FROM (
      SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY vod_id ORDER BY idx) = phase THEN 0 ELSE 1 END AS nb FROM state_samples)"""))
def q_run_numbers(spark, folder):
    return number_runs(state_samples(spark, folder), ["vod_id"], ["idx"], index_chunk("idx", 16), "phase").select("vod_id", "idx", "run")
