"""Registered queries: phase windows from classification to segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import PHASES
from tidemark.operators import phases as ph
from tidemark.operators import timeline as tl
from tidemark.plans.registry import Registry
from tidemark.plans.views import coarse_windows, state_samples, with_views

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_R = lambda v, t: f"greatest(0, least(1, ({v}) / {t}::DOUBLE))"
CLASSIFY = {
    "v": """SELECT vod_id, idx, start, "end", CASE WHEN has_audio THEN voice_ratio ELSE 0 END AS voice, CASE WHEN has_audio THEN speech_continuity ELSE 0 END AS cont,
        CASE WHEN has_audio THEN silence_ratio ELSE 1 END AS sil, CASE WHEN has_audio THEN dynamic_range ELSE 0 END AS dyn, CASE WHEN has_audio THEN energy_continuity ELSE 0 END AS mus,
        CASE WHEN has_probe THEN transcript_quality_score ELSE 0 END AS qual, CASE WHEN has_probe THEN words_per_second ELSE 0 END AS wps, CASE WHEN has_probe THEN repeated_text_ratio ELSE 0 END AS rep,
        CASE WHEN has_visual THEN motion_score ELSE 0 END AS mo, CASE WHEN has_visual THEN scene_change_score ELSE 0 END AS sce, CASE WHEN has_visual THEN layout_hint ELSE 'unknown' END AS hint,
        has_visual AND face_present AS face, has_probe, has_audio, has_visual, CASE WHEN has_probe THEN text ELSE '' END AS txt FROM coarse_windows""",
    "sc0": f"""SELECT *, contains(txt, 'juga') OR contains(txt, 'juego') OR contains(txt, 'mapa') AS gw, contains(txt, 'chat') OR contains(txt, 'historia') AS tw,
        0.24*{_R('voice', 0.35)} + 0.18*{_R('cont', 0.40)} + 0.18*{_R('qual', 0.45)} + 0.12*{_R('wps', 0.45)} + CASE WHEN has_probe THEN 0.06 ELSE 0 END
          + CASE WHEN face AND hint IN ('fullscreen_camera_hint','facecam_overlay_hint') THEN 0.10 ELSE 0 END + 0.12*(1-{_R('mo', 0.27)}) - 0.18*rep AS t0,
        0.28*(1-{_R('voice', 0.20)}) + 0.20*sil + 0.12*rep + 0.18*mus*(1-voice*0.5) + CASE WHEN NOT face THEN 0.10 ELSE 0 END + 0.12*(1-{_R('greatest(mo, sce)', 0.18)}) AS w0,
        0.26*{_R('mo', 0.18)} + 0.20*{_R('sce', 0.16)} + CASE WHEN hint = 'facecam_overlay_hint' THEN 0.22 ELSE 0 END + 0.14*{_R('dyn', 0.18)}
          + 0.18*greatest(0, least(1, (voice-cont)*2 + CASE WHEN voice > 0.1 AND voice < 0.55 THEN 0.35 ELSE 0 END)) AS g0 FROM v""",
    "sc1": """SELECT *, round(greatest(0, least(1, w0)), 9) AS w, round(greatest(0, least(1, t0 + CASE WHEN tw THEN 0.06 ELSE 0 END)), 9) AS t, round(greatest(0, least(1, g0 + CASE WHEN gw THEN 0.10 ELSE 0 END)), 9) AS g FROM sc0""",
    "sc2": "SELECT *, greatest(w, t, g) AS best, round(greatest(w, t, g) - list_sort([w, t, g])[2], 9) AS margin FROM sc1",
    "classified": """SELECT vod_id, idx, start, "end", CASE WHEN (NOT has_audio AND NOT has_visual) OR best < 0.43 OR margin < 0.07 THEN 'unknown' WHEN w = best THEN 'waiting_or_music' WHEN t = best THEN 'talking' ELSE 'gameplay' END AS raw_phase,
        w AS waiting_or_music, t AS talking, g AS gameplay, best,
        round(greatest(0, least(1, 0.08 + 0.72 * (CASE WHEN has_audio THEN 0 ELSE 0.5 END + CASE WHEN has_visual THEN 0 ELSE 0.5 END) + 0.35 * (1 - greatest(0, least(1, margin / 0.07::DOUBLE))))), 9) AS unknown,
        array_to_string(list_filter([CASE WHEN voice >= 0.35 THEN 'high_voice_ratio' END, CASE WHEN cont >= 0.40 THEN 'continuous_speech' END, CASE WHEN qual >= 0.45 THEN 'high_transcript_quality' END,
          CASE WHEN has_probe AND qual > 0 THEN 'spanish_speech_probe' END, CASE WHEN rep >= 0.35 THEN 'repetitive_transcript' END, CASE WHEN sil >= 0.75 THEN 'long_silence_ratio' END,
          CASE WHEN face AND hint = 'fullscreen_camera_hint' THEN 'stable_large_face' END, CASE WHEN hint = 'facecam_overlay_hint' THEN 'overlay_facecam_layout' END, CASE WHEN mo >= 0.18 THEN 'high_motion' END,
          CASE WHEN sce >= 0.16 THEN 'high_scene_change' END, CASE WHEN gw THEN 'gameplay_language_hint' END, CASE WHEN tw THEN 'conversation_language_hint' END,
          CASE WHEN NOT has_audio AND NOT has_visual THEN 'insufficient_audio_and_visual_signals' WHEN best < 0.43 OR margin < 0.07 THEN 'contradictory_or_low_confidence_signals' END], lambda x: x IS NOT NULL), ',') AS reasons,
        array_to_string(list_filter([CASE WHEN NOT has_audio THEN 'audio_signals_unavailable' END, CASE WHEN NOT has_visual THEN 'visual_signals_unavailable' END], lambda x: x IS NOT NULL), ',') AS warnings FROM sc2""",
}


def joined(column):
    return F.array_join(column, ",")


@query("classify_phase_window", with_views("coarse_windows", """SELECT vod_id, idx, start, "end", raw_phase, CASE WHEN raw_phase = 'unknown' THEN unknown ELSE best END AS raw_confidence,
    waiting_or_music, talking, gameplay, unknown, reasons, warnings FROM classified""", **CLASSIFY))
def q_classify(spark, folder):
    return ph.classify_windows(coarse_windows(spark, folder)).withColumns({"reasons": joined("reasons"), "warnings": joined("warnings")})


_PEN = [[0, 100000, 200000, 50000], [100000, 0, 100000, 50000], [240000, 100000, 0, 50000], [50000, 50000, 50000, 0]]
_OPT = lambda s: "least(" + ", ".join(f"p.c{i} + {_PEN[i][s]}" for i in range(4)) + ")"
_ARG = lambda s: "CASE " + " ".join(f"WHEN p.c{i} + {_PEN[i][s]} = {_OPT(s)} THEN {i}" for i in range(4)) + " END"
VITERBI = {
    **CLASSIFY,
    "em": "SELECT vod_id, idx, CAST(round((1 - waiting_or_music) * 1e6) AS BIGINT) AS e0, CAST(round((1 - talking) * 1e6) AS BIGINT) AS e1, CAST(round((1 - gameplay) * 1e6) AS BIGINT) AS e2, CAST(round((1 - unknown) * 1e6) AS BIGINT) AS e3 FROM classified",
    "fw": f"""SELECT * FROM (WITH RECURSIVE f(vod_id, idx, c0, c1, c2, c3, b0, b1, b2, b3) AS (
        SELECT vod_id, idx, e0, e1, e2, e3, 0, 0, 0, 0 FROM em WHERE idx = 0 UNION ALL
        SELECT e.vod_id, e.idx, {', '.join(f'{_OPT(s)} + e{s}' for s in range(4))}, {', '.join(_ARG(s) for s in range(4))} FROM f p JOIN em e ON e.vod_id = p.vod_id AND e.idx = p.idx + 1) SELECT * FROM f)""",
    "bw": """SELECT * FROM (WITH RECURSIVE b(vod_id, idx, s) AS (
        SELECT vod_id, max(idx), max_by(CASE WHEN c0 = least(c0,c1,c2,c3) THEN 0 WHEN c1 = least(c0,c1,c2,c3) THEN 1 WHEN c2 = least(c0,c1,c2,c3) THEN 2 ELSE 3 END, idx) FROM fw GROUP BY 1 UNION ALL
        SELECT f.vod_id, f.idx - 1, CASE b.s WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 ELSE b3 END FROM b JOIN fw f ON f.vod_id = b.vod_id AND f.idx = b.idx WHERE f.idx > 0) SELECT * FROM b)""",
    "smooth": """SELECT c.*, CASE b.s WHEN 0 THEN 'waiting_or_music' WHEN 1 THEN 'talking' WHEN 2 THEN 'gameplay' ELSE 'unknown' END AS phase,
        (CASE WHEN raw_phase = 'unknown' THEN unknown ELSE best END + CASE b.s WHEN 0 THEN waiting_or_music WHEN 1 THEN talking WHEN 2 THEN gameplay ELSE unknown END) / 2 AS confidence
        FROM classified c JOIN bw b ON c.vod_id = b.vod_id AND c.idx = b.idx""",
}


@query("viterbi_smooth", with_views("coarse_windows", "SELECT vod_id, idx, phase, confidence FROM smooth", **VITERBI))
def q_viterbi(spark, folder):
    return ph.smooth_phases(ph.classify_windows(coarse_windows(spark, folder))).select("vod_id", "idx", "phase", "confidence")


def sample_windows(spark, folder):
    """Raw samples as 30 s windows with one-hot scores; `error` samples are unknown."""
    s = state_samples(spark, folder)
    scores = [F.when(F.col("phase") == p, F.col("confidence")).otherwise(F.col("k") % 7 / 10.0).alias(p) for p in PHASES]
    return s.select("vod_id", "idx", (F.col("idx") * 30.0).alias("start"), (F.col("idx") * 30.0 + 30.0 + F.when(F.col("k") % 17 == 0, 5.0).otherwise(0.0)).alias("end"), "phase",
        "confidence", *scores, F.array_compact(F.array(F.when(F.col("k") % 9 == 0, "high_motion"), F.when(F.col("k") % 4 == 0, "calm"))).alias("reasons"),
        F.array().cast("array<string>").alias("smoothing_reasons"), F.array_compact(F.array(F.when(F.col("k") % 10 == 0, "late"))).alias("warnings"))


_SW = """SELECT vod_id, idx, idx * 30.0::DOUBLE AS start, idx * 30.0::DOUBLE + 30.0::DOUBLE + CASE WHEN k % 17 = 0 THEN 5.0::DOUBLE ELSE 0 END AS "end", phase, confidence, k FROM state_samples"""


@query("bridge_unknown_gaps", with_views("state_samples", """SELECT vod_id, idx, phase FROM (WITH RECURSIVE w(vod_id, idx, phase, hist) AS (
      SELECT vod_id, idx, phase, [phase] FROM ahead WHERE idx = 0 UNION ALL
      SELECT vod_id, idx, newp, list_append(hist, newp)[-2:] FROM (SELECT a.vod_id, a.idx, w.hist, CASE WHEN a.phase = 'unknown' AND len(list_filter(w.hist, lambda x: x <> 'unknown')) > 0 AND list_filter(w.hist, lambda x: x <> 'unknown')[-1] = a.rp
        THEN a.rp ELSE a.phase END AS newp FROM w JOIN ahead a ON a.vod_id = w.vod_id AND a.idx = w.idx + 1)) SELECT * FROM w)""", sw=_SW,
    ahead="SELECT *, CASE WHEN p1 <> 'unknown' THEN p1 WHEN p2 <> 'unknown' THEN p2 END AS rp FROM (SELECT *, lead(phase) OVER w AS p1, lead(phase, 2) OVER w AS p2 FROM sw WINDOW w AS (PARTITION BY vod_id ORDER BY idx))"))
def q_bridge(spark, folder):
    return ph.bridge_unknown_gaps(sample_windows(spark, folder), radius=2).select("vod_id", "idx", "phase")


PRUNS = {
    "sw": _SW,
    "r1": """SELECT *, CASE WHEN lag(phase) OVER w = phase AND abs(lag("end") OVER w - start) <= 0.01 THEN 0 ELSE 1 END AS nb FROM sw WINDOW w AS (PARTITION BY vod_id ORDER BY idx)""",
    "r2": "SELECT *, CAST(sum(nb) OVER (PARTITION BY vod_id ORDER BY idx) - 1 AS BIGINT) AS run FROM r1",
    "r3": "SELECT *, row_number() OVER (PARTITION BY vod_id, run ORDER BY confidence) - 1 AS rn, count(*) OVER (PARTITION BY vod_id, run) AS n FROM r2",
    "rc": "SELECT vod_id, run, 0.6::DOUBLE * median(confidence) + 0.4::DOUBLE * avg(confidence) AS confidence FROM r3 WHERE rn >= floor(n / 10) AND rn < n - floor(n / 10) GROUP BY 1, 2",
    "rs": """SELECT r2.vod_id, r2.run, min(start) AS start, max("end") AS "end", min(phase) AS phase, count(*) AS window_count, bool_or(k % 9 = 0) AS lively, any_value(rc.confidence) AS confidence FROM r2 JOIN rc ON r2.vod_id = rc.vod_id AND r2.run = rc.run GROUP BY 1, 2""",
}


@query("merge_phase_runs", with_views("state_samples", """SELECT s.vod_id, s.run, s.start, s."end", s.phase, window_count, confidence, coalesce(l.reasons, '') AS reasons FROM rs s LEFT JOIN
    (SELECT vod_id, run, string_agg(r, ',' ORDER BY at0, r DESC) AS reasons FROM (SELECT vod_id, run, r, min(idx) AS at0 FROM (SELECT vod_id, run, idx, unnest(list_filter([CASE WHEN k % 9 = 0 THEN 'high_motion' END, CASE WHEN k % 4 = 0 THEN 'calm' END], lambda x: x IS NOT NULL)) AS r FROM r2) GROUP BY 1, 2, 3) GROUP BY 1, 2) l
    ON s.vod_id = l.vod_id AND s.run = l.run""", **PRUNS))
def q_merge_phase_runs(spark, folder):
    return ph.merge_phase_runs(sample_windows(spark, folder)).select("vod_id", "run", "start", "end", "phase", "window_count", "confidence", joined("reasons").alias("reasons"))


@query("absorb_microsegments", with_views("state_samples", """SELECT r2.vod_id, r2.idx, coalesce(a.np, r2.phase) AS phase FROM r2 LEFT JOIN
    (SELECT vod_id, run, CASE WHEN lp = rp AND confidence < 0.72 AND NOT lively AND "end" - start <= CASE WHEN phase = 'waiting_or_music' AND confidence < 0.55 THEN 90 WHEN phase = 'gameplay' AND confidence < 0.55 THEN 120 ELSE 60 END THEN lp END AS np
     FROM (SELECT *, lag(phase) OVER w AS lp, lead(phase) OVER w AS rp FROM rs WINDOW w AS (PARTITION BY vod_id ORDER BY run))) a ON r2.vod_id = a.vod_id AND r2.run = a.run""", **PRUNS))
def q_absorb(spark, folder):
    return ph.absorb_microsegments(sample_windows(spark, folder)).select("vod_id", "idx", "phase")


@query("phase_timeline")
def q_phase_timeline(spark, folder):
    segs = ph.phase_timeline(coarse_windows(spark, folder))
    return tl.transitions(segs).withColumns({"reasons": joined("reasons"), "warnings": joined("warnings")})


@query("phase_timeline_durations")
def q_phase_timeline_durations(spark, folder):
    return tl.state_durations(ph.phase_timeline(coarse_windows(spark, folder)))
