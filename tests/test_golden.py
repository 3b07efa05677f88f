"""Expected results of the operators on small inputs."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.config import CANDIDATE, PHASES, PhaseConfig
from tidemark.functions import geometry as g
from tidemark.functions import scalar as sc
from tidemark.functions import text as tx
from tidemark.operators import boxes as bx
from tidemark.operators import candidates as cd
from tidemark.operators import intervals as iv
from tidemark.operators import phases as ph
from tidemark.operators import ranges as rg
from tidemark.operators import timeline as tl
from tidemark.operators import transcripts as tr
from tidemark.operators.terms import distinctive_terms, rank_sentences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,seconds", [("00:00", 0), ("12:34", 754), ("01:02:03", 3723), ("100:00", 6000), ("", None), ("10", None), ("1:2", None), ("12:60", None), ("00:00:60", None), ("words", None)])
def test_timecodes(spark, text, seconds):
    assert one(spark, sc.parse_timecode(F.lit(text))) == seconds


def test_interval_links_and_identities(spark):
    assert one(spark, sc.clip_interval_problem(F.lit(10), F.lit(5), 120)) == "end_not_after_start"
    assert one(spark, sc.clip_interval_problem(F.lit(0), F.lit(121), 120)) == "exceeds_maximum_duration"
    assert one(spark, sc.deep_link(F.lit("https://www.twitch.tv/videos/1"), F.lit(6150.0))) == "https://www.twitch.tv/videos/1?t=1h42m30s"
    assert one(spark, sc.deep_link(F.lit("https://www.youtube.com/watch?v=abc123"), F.lit(6150.0))) == "https://www.youtube.com/watch?v=abc123&t=6150"
    assert one(spark, sc.deep_link(F.lit("https://youtu.be/abc123"), F.lit(65.0))) == "https://youtu.be/abc123?t=65"
    assert one(spark, sc.source_identity(F.lit("https://www.twitch.tv/videos/123456789"))).asDict() == {"platform": "twitch", "vod_id": "123456789"}
    assert one(spark, sc.source_identity(F.lit("https://www.youtube.com/watch?v=dQw4w9WgXcQ"))).platform == "youtube"
    assert one(spark, sc.source_identity(F.lit("https://www.twitch.tv/somebody"))) is None


def test_ranges(spark):
    d = spark.createDataFrame([(1, 4000.0)], "v int, duration double")
    assert [(r.start, r.end) for r in rg.overlapping_chunks(d, ["v"]).orderBy("idx").collect()] == [(0, 1800), (1785, 3585), (3570, 4000)]
    w = rg.tumbling_windows(spark.createDataFrame([(1, 75.0)], "v int, duration double"), ["v"], block=60).orderBy("idx").collect()
    assert [(r.start, r.end, r.block_index) for r in w] == [(0, 30, 0), (30, 60, 0), (60, 75, 1)]
    assert [(r.sample_start, r.sample_end) for r in w][::2] == [(10, 20), (62.5, 72.5)]
    s = spark.createDataFrame([(1, 7.0)], "v int, duration double")
    assert [r.at for r in rg.sample_grid(s, ["v"]).orderBy("idx").collect()] == [0, 2, 4, 6]
    assert [r.at for r in rg.sample_grid(s, ["v"], interval=3.0).orderBy("idx").collect()] == [0, 3, 6]


def test_silence_plan(spark):
    s = spark.createDataFrame([(1, 2.0, 2.8), (1, 5.0, 7.0), (1, 12.0, 16.0)], "clip_id int, start double, end double")
    d = spark.createDataFrame([(1, 20.0), (2, 10.0)], "clip_id int, source_duration double")
    cuts = iv.silence_cuts(s, d)
    assert [(round(r.start, 3), round(r.end, 3)) for r in cuts.orderBy("cut").collect()] == [(5.4, 6.6), (12.2, 15.8)]
    keeps = [(r.clip_id, round(r.source_start, 3), round(r.source_end, 3), round(r.output_start, 3)) for r in iv.keep_list(cuts, d).orderBy("clip_id", "source_start").collect()]
    assert keeps == [(1, 0, 5.4, 0), (1, 6.6, 12.2, 5.4), (1, 15.8, 20, 11.0), (2, 0, 10, 0)]


def test_speech_regions(spark):
    r = spark.createDataFrame([(1, 1.0, 3.0), (1, 4.0, 8.0)], "clip_id int, start double, end double")
    out = iv.speech_region_stats(r, spark.createDataFrame([(1, 10.0)], "clip_id int, source_duration double")).first()
    assert (out.voiced_seconds, out.voice_ratio, out.longest_speech_run, out.longest_silence, out.speech_start_delay) == (6.0, 0.6, 4.0, 2.0, 1.0)


def samples(spark, states):
    phase = {"F": "talking", "S": "gameplay", "N": "waiting_or_music", "U": "unknown"}
    rows = [(1, i, 2.0 * i, s, phase[s], 0.8) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "vod_id int, idx long, frame_timestamp double, layout_id string, phase string, confidence double")


def test_hysteresis(spark):
    out = tl.hysteresis(samples(spark, "FFSFSSS"), confirmation=3).orderBy("idx").collect()
    assert "".join(r.accepted for r in out) == "FFFFSSS"
    assert out[2].hysteresis_reason == "layout_hysteresis_suppressed_transition" and out[4].hysteresis_reason == "layout_transition_confirmed"
    assert {r.accepted for r in tl.hysteresis(samples(spark, "FFFUFF"), confirmation=3).collect()} == {"F"}


def test_layout_segments_and_transitions(spark):
    segs = tl.transitions(tl.layout_segments(samples(spark, "NNNNFFFFFSSSS"))).orderBy("run").collect()
    assert [(r.start, r.end, r.phase) for r in segs] == [(0, 8, "waiting_or_music"), (8, 18, "talking"), (18, 26, "gameplay")]
    assert segs[1].transition_in == "waiting_or_music_to_talking" and segs[2].transition_out is None


def phase_segments(spark, parts):
    rows, at = [], 0.0
    for i, (phase, n) in enumerate(parts):
        rows.append((1, i, at, at + 30.0 * n, phase, 0.7))
        at += 30.0 * n
    return spark.createDataFrame(rows, "vod_id int, run long, start double, end double, phase string, confidence double")


def test_blocks_and_selection(spark):
    blocks = tl.classify_blocks(phase_segments(spark, [("waiting_or_music", 4), ("talking", 22), ("gameplay", 6), ("talking", 24)])).cache()
    found = blocks.orderBy("number").collect()
    assert [r.id for r in found] == ["talking-001", "talking-002"] and found[0].relevance == "primary" and found[0].end_transition == "gameplay_transition"
    assert sum(r.duration_seconds for r in found) == 1380
    assert tl.budgeted_selection(blocks).where("selected").count() == 2
    short = tl.classify_blocks(phase_segments(spark, [("talking", 8)]))
    assert short.first().relevance == "low_priority" and tl.primary_block(short).count() == 0


def scored_windows(spark, phases, seed=0):
    rng = random.Random(seed)
    rows = []
    for i, p in enumerate(phases):
        scores = {q: round(rng.uniform(0.1, 0.4), 3) for q in PHASES}
        scores[p] = 0.8
        rows.append((1, i, 30.0 * i, 30.0 * i + 30, p, 0.8, *[scores[q] for q in PHASES], [], []))
    fields = ", ".join(f"{q} double" for q in PHASES)
    return spark.createDataFrame(rows, f"vod_id int, idx long, start double, end double, raw_phase string, raw_confidence double, {fields}, reasons array<string>, warnings array<string>")


def test_path_in_chunks_equals_whole_path_and_brute_force(spark):
    rng = random.Random(5)
    raw = [rng.choice(PHASES) for _ in range(60)]
    windows = scored_windows(spark, raw, 6)
    whole = [r.phase for r in ph.smooth_phases(windows).orderBy("idx").collect()]
    for rows, fan in ((7, 1024), (3, 2), (1, 3)):
        assert [r.phase for r in ph.smooth_phases(windows, rows=rows, fan=fan).orderBy("idx").collect()] == whole
    penalty, rows = ph._penalty_matrix(PhaseConfig()), windows.orderBy("idx").collect()
    cost, back = None, []
    for r in rows:
        emission = [round((1 - r[p]) * 1_000_000) for p in PHASES]
        if cost is None:
            cost = emission
            continue
        options = [[cost[a] + int(penalty[a][b]) for a in range(4)] for b in range(4)]
        back.append([o.index(min(o)) for o in options])
        cost = [min(o) + e for o, e in zip(options, emission)]
    state = cost.index(min(cost))
    path = [state]
    for b in reversed(back):
        state = b[state]
        path.append(state)
    assert [PHASES[s] for s in reversed(path)] == whole


def test_failed_window_inside_talking(spark):
    windows = scored_windows(spark, ["talking"] * 4 + ["unknown"] + ["talking"] * 4 + ["gameplay"] * 4)
    segs = ph.merge_phase_runs(ph.absorb_microsegments(ph.bridge_unknown_gaps(ph.smooth_phases(windows)))).orderBy("run").collect()
    assert [r.phase for r in segs] == ["talking", "gameplay"] and "smoothed_short_unknown_gap" in segs[0].reasons


def transcript(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "vod_id int, pos long, start double, end double, text string, avg_logprob double, no_speech_probability double")


def test_cleaning_and_chunk_merge(spark):
    out = tr.clean_transcript(transcript(spark, [(2.0 * i, 2.0 * i + 2, " hola  gente ", -0.1, 0.0) for i in range(4)])).collect()
    kept = [r for r in out if r.removed is None]
    assert len(kept) == 2 and kept[0].raw_text == " hola  gente " and kept[0].text == "hola gente"
    rows = [(1, 0, 0.0, 10.0, "uno dos tres", -0.5), (1, 0, 1785.0, 1795.0, "esto se repite igual", -0.5), (1, 1, 1786.0, 1796.0, "Esto se repite igual", -0.2), (1, 1, 1800.0, 1810.0, "algo nuevo", -0.3)]
    chunks = spark.createDataFrame(rows, "vod_id int, chunk_index int, start double, end double, text string, avg_logprob double")
    merged = tr.merge_chunk_transcripts(chunks).orderBy("start").collect()
    assert [(r.start, r.avg_logprob) for r in merged] == [(0.0, -0.5), (1786.0, -0.2), (1800.0, -0.3)]


def test_windows_with_a_segment_that_outlasts_its_followers(spark):
    rng = random.Random(9)
    rows, at = [], 0.0
    for i in range(80):
        length = 150.0 if i % 17 == 5 else rng.uniform(3, 25)
        rows.append((at, at + length, f"t{i}", -0.1, 0.0))
        at += rng.uniform(3, 20)
    windows, current = [], []
    for i, r in enumerate(rows):
        current.append(i)
        if r[1] - rows[current[0]][0] >= 60:
            windows.append(current)
            current = []
    if current:
        if windows and rows[current[-1]][1] - rows[current[0]][0] < 30:
            windows[-1] = windows[-1] + current
        else:
            windows.append(current)
    expected = {i: w for w, members in enumerate(windows) for i in members}
    assert {r.pos: r.w for r in tr.semantic_windows(transcript(spark, rows)).collect()} == expected


def test_captions(spark):
    words = [(1, i, i * 0.3, i * 0.3 + 0.3, w) for i, w in enumerate("una frase bastante larga que necesita varias lineas para verse".split())]
    out = tr.caption_groups(spark.createDataFrame(words, "clip_id int, pos long, start double, end double, word string"), ["clip_id"]).collect()
    assert len(out) >= 2 and all(len(r.text) <= 32 and r.end > r.start for r in out)
    assert " ".join(r.text for r in sorted(out, key=lambda r: r.caption)) == " ".join(w[4] for w in words)


def test_diversity_and_grounding(spark):
    rows = [(1, 1, 90.0, 0.0, 600.0, "uno distinto"), (1, 2, 80.0, 20.0, 620.0, "dos aparte"), (1, 3, 75.0, 2000.0, 2600.0, "tres lejos")]
    c = spark.createDataFrame(rows, "vod_id int, id int, score double, safe_start double, safe_end double, title string")
    assert sorted(r.id for r in cd.diversify(c, ["vod_id"], ["id"]).collect()) == [1, 3]
    text = tx.normalize(F.lit("hoy juega Francia contra Marruecos"))
    check = lambda title: one(spark, cd.title_grounding(tx.title_terms(F.lit(title), "Speaker"), text, tx.lemmas_of(text)))
    assert check("Speaker comenta el partido Francia-Marruecos de Ronaldo").unsupported == ["partido", "Ronaldo"]
    assert check("Speaker comenta Francia-Marruecos").score == 1.0 and check("Speaker habla sobre pues").score == 0.0


def test_terms_and_sentences(spark):
    d = spark.createDataFrame([(1, 1, "La energía solar crece. La energía solar baja los precios de la electricidad en verano. Pues bueno a ver en plan o sea.")], "v int, d int, text string")
    terms = [t.term for t in distinctive_terms(d, ["v", "d"], ["v"]).first().terms]
    assert terms[0] == "energía solar" and not any(t in ("pues", "bueno") for t in terms)
    best = rank_sentences(d.withColumn("t", F.array(F.lit("energía solar"))), ["v", "d"], "text", "t", 1).first().sentences
    assert best == ["La energía solar baja los precios de la electricidad en verano."]
    assert one(spark, tx.filler_ratio(F.lit("también"))) == 0.0  # the list is compared with its accents
    assert one(spark, tx.repeated_text_ratio(F.lit("la misma frase la misma frase la misma frase"))) > 0.2


def test_geometry(spark):
    box = lambda *v: g.rect(*[F.lit(x) for x in v])
    assert one(spark, g.clamp(box(1900, 0, 101, 51), 1920, 1080)).width == 20
    assert one(spark, g.iou(box(0, 0, 10, 10), box(0, 0, 10, 10))) == 1.0
    assert one(spark, g.position(box(0, 0, 100, 100), 1920, 1080)) == "top_left" and one(spark, g.position(box(1800, 0, 100, 100), 1920, 1080)) == "top_right"
    assert tuple(one(spark, g.remapped(box(100, 50, 80, 120), F.lit(2 / 3)))) == (150, 75, 120, 180)
    roi = F.lit(None).cast("struct<x:bigint,y:bigint,width:bigint,height:bigint>")
    best = one(spark, g.content_crop(1920, 1080, 0.9, box(0, 0, 400, 300), roi))
    assert best.crop.x > 0 and best.overlap == 0


def test_short_uncertain_segment_is_bridged(spark):
    box = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"
    rows = [(1, 0, 0.0, 3.0, "small_facecam"), (1, 1, 3.0, 3.7, "uncertain"), (1, 2, 3.7, 7.0, "small_facecam")]
    s = spark.createDataFrame(rows, "clip_id int, scene_id long, start double, end double, layout string").withColumns({
        "confidence": F.lit(0.8), "detection_source": F.lit("automatic"), "facecam_region": g.rect(*[F.lit(v) for v in (10, 10, 100, 100)]), "facecam_position": F.lit("top_left"),
        "output_crop": F.lit(None).cast(box), "content_crop": F.lit(None).cast(box), "duplicate_facecam_excluded": F.lit(True), "reasons": F.array(F.lit("x"))})
    out = bx.stabilize_segments(s, ["clip_id"]).collect()
    assert len(out) == 1 and (out[0].start, out[0].end) == (0.0, 7.0) and "short_uncertain_segment_bridged" in out[0].reasons


def test_layout_decisions(spark):
    def decide(scores, sharpness=50.0):
        rows = [(1, i, f"l{i}", p, s, 0.5) for i, (p, s) in enumerate(scores)]
        df = spark.createDataFrame(rows, "frame int, layout_ord int, layout_id string, phase string, match_score double, minimum_match_score double")
        return bx.match_layouts(df, ["frame"], F.lit(sharpness)).first()

    assert decide([("talking", 0.2), ("gameplay", 0.1)]).phase == "waiting_or_music"
    assert decide([("talking", None), ("gameplay", None)]).reasons == ["frame_decode_failed"]
    assert decide([("talking", 0.9), ("gameplay", 0.88)]).phase == "unknown"
    tie = decide([("talking", 0.9), ("talking", 0.88)])
    assert tie.layout_id == "l0" and "same_phase_layout_tie_resolved" in tie.reasons


def test_pcm_files(spark, tmp_path):
    import struct
    import wave

    from tidemark.sources.pcm import read_pcm_samples

    def save(name, rate, values):
        with wave.open(str(tmp_path / name), "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(2)
            out.setframerate(rate)
            out.writeframes(struct.pack(f"<{len(values)}h", *values))

    save("good.wav", 16000, [0, 16384, -32768] * 300)
    save("bad.wav", 8000, [1, 2, 3])
    rows = read_pcm_samples(spark, str(tmp_path)).collect()
    good = sorted((r for r in rows if r.error is None), key=lambda r: r.frame_index)
    assert [len(r.samples) for r in good] == [400, 400, 100] and good[0].samples[:3] == [0.0, 0.5, -1.0]
    assert len([r for r in rows if r.error]) == 1


def test_stream_state_continues_over_batches(spark, tmp_path):
    """The confirmed state continues over micro-batches."""
    from tidemark.streaming import live as lv

    for number, states in enumerate(("FFS", "SSF", "FFF")):
        rows = [(1, dt.datetime.fromtimestamp(100 * number + i, dt.timezone.utc), s) for i, s in enumerate(states)]
        rows += [(2, dt.datetime.fromtimestamp(9999, dt.timezone.utc), "-")] * (number == 2)  # moves the watermark on
        spark.createDataFrame(rows, "k int, t timestamp, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp, s string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = lv.run_to_table(lv.live_hysteresis(stream, ["k"], "t", "1 hour", "s", 3), "batches").orderBy("start_us").collect()
    assert [(r.from_state, r.to_state, r.start_us) for r in out] == [("F", "S", 2_000_000), ("S", "F", 102_000_000)]


def test_embedding_backend_is_reported_truthfully(spark):
    from tidemark.operators.terms import hash_embedding
    from tidemark.sources.readers import embed_texts

    d = spark.createDataFrame([(1, "hola gente"), (2, "")], "k int, text string")

    def broken():
        raise ImportError("no model")

    rows = embed_texts(d, ["k"], "text", broken, "some-model", hash_embedding(d, ["k"])).orderBy("k").collect()
    assert all(r.fallback_used and r.effective_backend == "hash-fallback" and "no model" in r.fallback_reason for r in rows)
    assert abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-9 and not any(rows[1].embedding)


def test_another_recording_changes_nothing(spark):
    a = samples(spark, "FFSFSSSUUF")
    b = a.withColumn("vod_id", F.lit(2)).withColumn("layout_id", F.lit("N"))
    alone = {(r.idx, r.accepted) for r in tl.hysteresis(a).collect()}
    both = {(r.idx, r.accepted) for r in tl.hysteresis(a.unionByName(b).repartition(7)).where("vod_id = 1").collect()}
    assert alone == both


def face_rows(clip, faces, size=None):
    """Detections of a clip of one scene: (frame, x, y, size)."""
    return [(clip, 0, frame, i, (x, y, side, side), 0.9, 1) for i, (frame, x, y, side) in enumerate(faces)]


def composed(spark, rows, clips, regions=None, default=None):
    box = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"
    d = spark.createDataFrame(rows, f"clip_id int, scene_id long, frame_index int, det_a int, region {box}, confidence double, profile int")
    scenes = spark.createDataFrame([(c, 0, 0.0, 5.0) for c in clips], "clip_id int, scene_id long, start double, end double")
    return bx.composition_plan(scenes, d, ["det_a"], 1920, 1080, regions, default)


def test_composition_classes_and_counts(spark):
    rows = face_rows(1, [(i, 700, 220, 580) for i in range(5)]) + face_rows(2, [(i, 40, 35, 130) for i in range(6)])
    rows += face_rows(3, [x for i in range(5) for x in ((i, 20 + i * 250, 20, 100), (i, 1500 - i * 180, 400, 90))])
    rows += face_rows(5, [(i, 160, 430, 110) for i in range(8)]) + face_rows(6, [(i, 1650, 430, 110) for i in range(8)])
    plan = composed(spark, rows, range(1, 7))
    got = {r.clip_id: r for r in plan.segments.collect()}
    assert {c: r.layout for c, r in got.items()} == {1: "fullscreen_face", 2: "small_facecam", 3: "uncertain", 4: "no_face", 5: "small_facecam", 6: "small_facecam"}
    assert [got[c].facecam_position for c in (2, 5, 6)] == ["top_left", "left_column", "right_column"]
    assert got[5].detection_source == "automatic_side_facecam"
    assert {(r.clip_id, r.code) for r in plan.warnings.collect()} >= {(3, "layout_uncertain"), (4, "face_not_detected")}
    assert plan.problems.collect() == []
    counts = {r.clip_id: r for r in plan.summary.collect()}
    assert (counts[3].faces_detected, counts[3].face_frames_analyzed, counts[3].fallbacks) == (10, 5, 1) and counts[4].faces_detected is None


def test_composition_asks_the_profile_for_the_content_region(spark):
    box = "struct<x:bigint,y:bigint,width:bigint,height:bigint>"
    cam = (0, 0, 300, 300)
    rows = face_rows(1, [(i, 60, 50, 130) for i in range(6)])
    layout = f"profile int, region_ord int, region {box}, region_position string, roi {box}"
    regions = spark.createDataFrame([(1, 0, cam, "top_left", (1000, 0, 900, 1080))], layout)
    bare = spark.createDataFrame([(1, 0, cam, "top_left", None)], layout)
    default = spark.createDataFrame([(1, (400, 100, 800, 900))], f"profile int, default_roi {box}")
    asked, fallback, none = (composed(spark, rows, [1], *x).segments.first() for x in ((regions, default), (bare, default), (bare, None)))
    assert asked.detection_source == fallback.detection_source == "profile_adjusted"
    assert asked.facecam_region.asDict() == dict(zip(("x", "y", "width", "height"), cam))
    assert asked.content_crop.x == 940 and fallback.content_crop.x == 470  # as near to the asked region as the frame's candidates come
    assert none.content_crop.x in (470, 940)


def test_topics_to_selected_candidates(spark):
    first, second = "Bueno chat, GTA VI Rockstar precio lanzamiento historia opinión.", "Cambiando de tema, aeropuerto viaje maleta anécdota historia increíble."
    rows = [(60.0 * i, 60.0 * i + 55, first + f" parte {i}" if i < 6 else second + f" parte {i}", -0.1, 0.02) for i in range(12)]
    rows.insert(3, (175.0, 179.0, "  ", -0.1, 0.0))  # cleaned away
    easy = replace(CANDIDATE, min_score=0.0, min_coherence=0.0)
    selected, rejected = (x.collect() for x in cd.topic_pipeline(transcript(spark, rows), config=easy, minimum=120.0))
    both = selected + rejected
    assert len({r.block for r in both}) >= 2 and all(r.safe_start <= r.exact_start for r in both)
    assert any("aeropuerto" in r.title.lower() for r in both)
    assert not {(r.block, r.piece) for r in selected} & {(r.block, r.piece) for r in rejected}
    assert all(not r.failures for r in selected) and all(r.failures for r in rejected)
    assert sorted(r.picked for r in selected) == list(range(1, len(selected) + 1))
