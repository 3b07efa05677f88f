"""Registered queries over detection boxes, tracks, scenes and layout scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import geometry as g
from tidemark.functions import vectors as vc
from tidemark.operators import boxes as bx
from tidemark.operators.chunked import index_chunk, number_runs, ordered_scan
from tidemark.plans.registry import Registry
from tidemark.plans.views import rects, state_samples, table, vectors, with_views

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
FW, FH = 1920, 1080
ID = ["clip_id", "frame_index", "det_a", "det_b", "det_c"]
KEY = "clip_id, frame_index, det_a, det_b, det_c"


def boxed(spark, folder):
    r = rects(spark, folder)
    return r.withColumn("region", g.rect(F.col("x"), F.col("y"), F.col("width"), F.col("height")))


def parts(column, prefix=""):
    return [column[n].alias(prefix + n) for n in ("x", "y", "width", "height")]


def clamp_sql(x, y, w, h, fw=FW, fh=FH):
    cx, cy = f"greatest(0, least({x}, {fw - 2}))", f"greatest(0, least({y}, {fh - 2}))"
    cw, ch = f"greatest(2, least({w}, {fw} - {cx}))", f"greatest(2, least({h}, {fh} - {cy}))"
    return f"CAST({cx} AS BIGINT) AS x, CAST({cy} AS BIGINT) AS y, CAST({cw} - {cw} % 2 AS BIGINT) AS width, CAST({ch} - {ch} % 2 AS BIGINT) AS height"


def iou_sql(a, b):
    i = f"(greatest(0, least({a[0]}+{a[2]}, {b[0]}+{b[2]}) - greatest({a[0]}, {b[0]})) * greatest(0, least({a[1]}+{a[3]}, {b[1]}+{b[3]}) - greatest({a[1]}, {b[1]})))"
    return i, f"({i} / ({a[2]}*{a[3]} + {b[2]}*{b[3]} - {i}))"


BOX_A = ("x", "y", "width", "height")
ROUND = lambda v: f"CAST(round_even({v}, 0) AS BIGINT)"


@query("clamp_box", with_views("rects", f"SELECT {KEY}, {clamp_sql('x', 'y', 'width', 'height', 801, 601)} FROM rects"))
def q_clamp(spark, folder):
    return boxed(spark, folder).select(*ID, *parts(g.clamp(F.col("region"), 801, 601)))


@query("expand_box", with_views("rects", f"SELECT {KEY}, {clamp_sql('x', 'y', 'width', 'height')} FROM (SELECT {KEY}, {ROUND('x - width * 0.8::DOUBLE')} AS x, {ROUND('y - height * 0.55::DOUBLE')} AS y, {ROUND('width * 2.6::DOUBLE')} AS width, {ROUND('height * 3.15::DOUBLE')} AS height FROM rects)"))
def q_expand(spark, folder):
    return boxed(spark, folder).select(*ID, *parts(g.expand(F.col("region"), FW, FH)))


_I, _IOU = iou_sql(BOX_A, (600, 200, 700, 500))


@query("box_iou", with_views("rects", f"SELECT {KEY}, {_IOU} AS iou, {_I} / 350000.0::DOUBLE AS covered FROM rects"))
def q_iou(spark, folder):
    other = g.rect(*[F.lit(v) for v in (600, 200, 700, 500)])
    return boxed(spark, folder).select(*ID, g.iou(F.col("region"), other).alias("iou"), g.covered_share(F.col("region"), other).alias("covered"))


_POS = """CASE WHEN ac <> 'center' AND cy BETWEEN 0.35 AND 0.65 THEN ac || '_center' WHEN ac <> 'center' AND dn <> 'center' THEN dn || '_' || ac WHEN ac <> 'center' THEN ac ELSE dn END"""
_PLACED = """SELECT *, CASE WHEN cx < 0.35 THEN 'left' WHEN cx > 0.65 THEN 'right' ELSE 'center' END AS ac, CASE WHEN cy < 0.35 THEN 'top' WHEN cy > 0.65 THEN 'bottom' ELSE 'center' END AS dn
    FROM (SELECT *, (x + width / 2) / 1920 AS cx, (y + height / 2) / 1080 AS cy FROM rects)"""


@query("box_position", with_views("rects", f"SELECT {KEY}, {_POS} AS position FROM ({_PLACED})"))
def q_position(spark, folder):
    return boxed(spark, folder).select(*ID, g.position(F.col("region"), FW, FH).alias("position"))


@query("side_column_box", with_views("rects", f"""SELECT {KEY}, {clamp_sql('sx', 'sy', 'sw', 'sh')} FROM (SELECT {KEY}, CASE WHEN starts_with(p, 'left') THEN 0 ELSE 1920 - sw END AS sx, greatest(0, {ROUND('y - height * 0.8::DOUBLE')}) AS sy, sw,
    least(1080 - greatest(0, {ROUND('y - height * 0.8::DOUBLE')}), height * 3) AS sh FROM (SELECT *, {_POS} AS p, least({ROUND('1920 * 0.35::DOUBLE')}, greatest({ROUND('1920 * 0.22::DOUBLE')}, {ROUND('width * 3.6::DOUBLE')})) AS sw FROM ({_PLACED})))"""))
def q_side_column(spark, folder):
    return boxed(spark, folder).select(*ID, *parts(g.side_column(F.col("region"), FW, FH)))


@query("aspect_crop", with_views("rects", f"""SELECT {KEY}, {clamp_sql('ax', '0', 'least(1920, 608)', '1080')} FROM (SELECT {KEY}, {ROUND('x + width / 2 - 608 / 2')} AS ax FROM rects)"""))
def q_aspect(spark, folder):
    return boxed(spark, folder).select(*ID, *parts(g.aspect_crop(FW, FH, 1080 / 1920, g.center(F.col("region"))[0])))


_T = 1080 / (1920 * (1 - 0.38))


@query("content_crop", with_views("rects", f"""SELECT {KEY}, cx AS crop_x, {_I.replace('600', 'cx').replace('200', '0').replace('700', '980').replace('500', '1080')} / (width * height) AS overlap FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEY}, x, y, width, confidence, height ORDER BY round(4 * {_I.replace('600', 'cx').replace('200', '0').replace('700', '980').replace('500', '1080')} / (width * height) + abs(cx + 490 - 960) / 1920, 12), cx) AS rn, count(*) OVER (PARTITION BY {KEY}, x, y, width, confidence, height) AS dup
    FROM rects, (SELECT unnest([0, 470, 940]) AS cx)) WHERE rn <= dup / 3"""))
def q_content_crop(spark, folder):
    best = g.content_crop(FW, FH, _T, F.col("region"), F.lit(None).cast("struct<x:bigint,y:bigint,width:bigint,height:bigint>"))
    return boxed(spark, folder).select(*ID, best["crop"]["x"].alias("crop_x"), best["overlap"].alias("overlap"))


@query("median_box", with_views("rects", f"SELECT clip_id, {', '.join(ROUND(f'median({n})') + f' AS {n}' for n in BOX_A)} FROM rects GROUP BY 1"))
def q_median_box(spark, folder):
    return rects(spark, folder).groupBy("clip_id").agg(*[F.rint(F.median(n)).cast("long").alias(n) for n in BOX_A])


@query("box_remap", with_views("rects", f"SELECT {KEY}, {', '.join(ROUND(f'{n} / (2 / 3.0::DOUBLE)') + f' AS {n}' for n in BOX_A)}, {', '.join(ROUND(f'{n} * 1280 / 1920') + f' AS scaled_{n}' for n in BOX_A)} FROM rects"))
def q_remap(spark, folder):
    r = F.col("region")
    return boxed(spark, folder).select(*ID, *parts(g.remapped(r, F.lit(2 / 3.0))), *parts(g.scaled(r, 1280, 1280, F.lit(1920), F.lit(1920)), "scaled_"))


@query("box_expectation_scores", with_views("rects", f"""SELECT {KEY}, greatest(0, least(1, exp(-4 * sqrt(power(x + width / 2 - 950, 2) + power(y + height / 2 - 450, 2)) / sqrt(700.0 * 700.0 + 500.0 * 500.0)) * CASE WHEN x + width / 2 BETWEEN 600 AND 1300 AND y + height / 2 BETWEEN 200 AND 700 THEN 1 ELSE 0.45::DOUBLE END)) AS position_score,
    CASE WHEN a BETWEEN 0.004 AND 0.01 THEN 1 ELSE greatest(0, 1 - CASE WHEN a < 0.004 THEN 0.004 - a ELSE a - 0.01 END / 0.01) END AS size_score FROM (SELECT *, width * height / 2073600 AS a FROM rects)"""))
def q_expectation(spark, folder):
    expected = g.rect(*[F.lit(v) for v in (600, 200, 700, 500)])
    cx, cy = g.center(F.col("region"))
    return boxed(spark, folder).select(*ID, g.region_score(cx, cy, expected).alias("position_score"), g.size_score(g.area(F.col("region")) / (FW * FH), F.lit(0.004), F.lit(0.01)).alias("size_score"))


_PROFILES = [("left", 0, (0, 100, 500, 500)), ("middle", 1, (600, 200, 700, 500)), ("all", 2, (0, 0, 1600, 900))]
_REGIONS = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {o}, {b[0]}, {b[1]}, {b[2]}, {b[3]})" for n, o, b in _PROFILES) + ") t(pos, ord, rx, ry, rw, rh)"
_RI, _RIOU = iou_sql(("rx", "ry", "rw", "rh"), BOX_A)


def profile_table(spark, folder):
    """One region profile per supplier, all with the same three layouts."""
    layout = lambda n, b: F.struct(F.lit(n).alias("position"), g.rect(*[F.lit(v) for v in b]).alias("facecam_region"),
        F.when(F.lit(n == "middle"), g.rect(F.lit(100), F.lit(100), F.lit(800), F.lit(600))).alias("content_region_of_interest"))
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.struct(F.lit(FW).alias("width"), F.lit(FH).alias("height")).alias("source_resolution"),
        F.array(*[layout(n, b) for n, _, b in _PROFILES]).alias("layouts"))


@query("region_match_join", with_views("rects", f"""SELECT clip_id, det_b AS scene_id, min_by(pos, ord) AS position, min(ord) AS region_ord FROM rects, ({_REGIONS}) WHERE confidence >= 0.40 AND det_b IN (SELECT s_suppkey FROM supplier)
    AND ({_RIOU} > 0.05 OR (x + width / 2 BETWEEN rx AND rx + rw AND y + height / 2 BETWEEN ry AND ry + rh)) GROUP BY 1, 2"""))
def q_region_match(spark, folder):
    d = boxed(spark, folder).withColumns({"scene_id": F.col("det_b"), "profile": F.col("det_b")})
    m = bx.match_regions(d, bx.scaled_regions(profile_table(spark, folder), FW, FH), ["clip_id", "scene_id"])
    return m.select("clip_id", "scene_id", F.col("region_position").alias("position"), F.col("region_ord").cast("long").alias("region_ord"))


@query("roi_lookup", with_views("rects", f"""SELECT r.clip_id, r.frame_index, r.det_a, r.det_b, r.det_c, coalesce(m.pos, 'profile_default') AS matched FROM rects r LEFT JOIN (SELECT x, y, width, height, min_by(pos, ord) AS pos FROM (SELECT DISTINCT x, y, width, height FROM rects), ({_REGIONS}) WHERE {_RIOU} >= 0.5 GROUP BY 1, 2, 3, 4) m
    ON m.x = r.x AND m.y = r.y AND m.width = r.width AND m.height = r.height"""))
def q_roi(spark, folder):
    # The regions of one profile ride along as an array of three; no pair table is built.
    regions = F.array(*[F.struct(F.lit(n).alias("value"), g.rect(*[F.lit(v) for v in b]).alias("region")) for n, _, b in _PROFILES])
    return boxed(spark, folder).select(*ID, bx.lookup_region(regions, F.col("region"), F.lit("profile_default")).alias("matched"))


def tracked(spark, folder):
    """Each order is a clip; three line numbers make a scene."""
    r = boxed(spark, folder).withColumn("scene_id", F.floor(F.col("frame_index") / 4).cast("long"))
    cx, cy = g.center(F.col("region"))
    return r.withColumns({"cx": cx / FW, "cy": cy / FH, "area": g.area(F.col("region")), "area_ratio": g.area(F.col("region")) / (FW * FH)})


SCENE, DET = ["clip_id", "scene_id"], ["det_a", "det_b", "det_c"]


_LINKED = {
    "tl": """SELECT clip_id, frame_index // 4 AS scene_id, list({'f': frame_index, 'a': det_a, 'b': det_b, 'c': det_c, 'cx': (x + width / 2) / 1920, 'cy': (y + height / 2) / 1080, 'area': (width * height)::DOUBLE}
        ORDER BY frame_index, -confidence, -(width * height), det_a, det_b, det_c) AS l FROM rects GROUP BY 1, 2""",
    "tr": """SELECT * FROM (WITH RECURSIVE r(clip_id, scene_id, i, tracks, labels) AS (
        SELECT clip_id, scene_id, 0::BIGINT, list_transform(l[1:0], lambda b: {'cx': b.cx, 'cy': b.cy, 'area': b.area, 'f': b.f}), [0::BIGINT][1:0] FROM tl
        UNION ALL SELECT clip_id, scene_id, i + 1, CASE WHEN n > len(tracks) THEN list_append(tracks, here) ELSE list_transform(tracks, lambda t, k: CASE WHEN k = n THEN here ELSE t END) END, list_append(labels, (n - 1)::BIGINT) FROM (
          SELECT *, {'cx': x.cx, 'cy': x.cy, 'area': x.area, 'f': x.f} AS here, coalesce(list_sort(list_filter(list_transform(tracks, lambda t, k: {'d': sqrt((x.cx - t.cx) ** 2 + (x.cy - t.cy) ** 2), 'k': k::BIGINT,
            'ok': t.f <> x.f AND x.area / greatest(1, t.area) BETWEEN 0.35 AND 2.8}), lambda o: o.ok AND o.d < 0.10))[1].k, len(tracks) + 1) AS n
          FROM (SELECT r.*, tl.l[r.i + 1] AS x FROM r JOIN tl ON tl.clip_id = r.clip_id AND tl.scene_id = r.scene_id WHERE r.i < len(tl.l))))
        SELECT r.clip_id, r.scene_id, tl.l, r.labels FROM r JOIN tl ON tl.clip_id = r.clip_id AND tl.scene_id = r.scene_id WHERE r.i = len(tl.l))""",
    "linked": "SELECT clip_id, scene_id, b.f AS frame_index, b.a AS det_a, b.b AS det_b, b.c AS det_c, track FROM (SELECT clip_id, scene_id, unnest(l) AS b, unnest(labels) AS track FROM tr)",
}


@query("track_linking", with_views("rects", "SELECT * FROM linked", **_LINKED))
def q_track_linking(spark, folder):
    return bx.link_tracks(tracked(spark, folder), SCENE, DET).select(*SCENE, "frame_index", *DET, "track")


@query("track_stats", with_views("rects", """SELECT clip_id, scene_id, track, count(DISTINCT frame_index) AS frames_seen, median(confidence) AS confidence, median(width * height / 2073600) AS face_area,
      round(count(DISTINCT frame_index) / any_value(fc) * 1.2 + median(confidence) * 0.5 + least(median(width * height / 2073600) * 12, 0.5) - 2 * (stddev_pop((x + width / 2) / 1920) + stddev_pop((y + height / 2) / 1080)), 9) AS track_score
    FROM (SELECT r.*, frame_index // 4 AS scene_id, det_b % 2 AS track, dense_rank() OVER (PARTITION BY clip_id, frame_index // 4 ORDER BY frame_index) + dense_rank() OVER (PARTITION BY clip_id, frame_index // 4 ORDER BY frame_index DESC) - 1 AS fc FROM rects r) GROUP BY 1, 2, 3"""))
def q_track_stats(spark, folder):
    d = tracked(spark, folder).withColumn("track", F.col("det_b") % 2)
    frames = d.groupBy(*SCENE).agg(F.count_distinct("frame_index").alias("frame_count"))
    return bx.track_stats(d, SCENE, frames).select(*SCENE, "track", "frames_seen", "confidence", "face_area", "track_score")


def scene_segments(spark, folder):
    d = tracked(spark, folder)
    linked = bx.link_tracks(d.where("confidence >= 0.55"), SCENE, DET, carry=("region", "confidence", "area_ratio")).dropna(subset=[*SCENE, "frame_index", *DET])
    scenes = d.groupBy(*SCENE).agg((F.col("scene_id") * 3.0).alias("start"), (F.col("scene_id") * 3.0 + 3.0).alias("end"))
    return bx.classify_scenes(scenes, bx.best_tracks(bx.track_stats(linked, SCENE, bx.frame_counts(d, SCENE)), SCENE), SCENE, FW, FH)


@query("classify_scene")
def q_classify_scene(spark, folder):
    return scene_segments(spark, folder).select(*SCENE, "layout", "confidence", "detection_source", "facecam_position", F.array_join("reasons", ",").alias("reasons"))


def composition(spark, folder):
    d = tracked(spark, folder).select(*SCENE, "frame_index", *DET, "region", "confidence", F.col("det_b").alias("profile"))
    scenes = d.groupBy(*SCENE).agg((F.col("scene_id") * 3.0).alias("start"), (F.col("scene_id") * 3.0 + 3.0).alias("end"))
    return bx.composition_plan(scenes, d, DET, FW, FH, bx.scaled_regions(profile_table(spark, folder), FW, FH))


@query("composition_plan")
def q_composition(spark, folder):
    return composition(spark, folder).segments.select("clip_id", "scene_id", "start", "end", "layout", "confidence", "detection_source", F.array_join("reasons", ",").alias("reasons"))


@query("composition_summary")
def q_composition_summary(spark, folder):
    """Counts per clip with the number of warnings and of breaches that the whole chain found."""
    plan = composition(spark, folder)
    warned = plan.warnings.groupBy("clip_id").agg(F.count(F.lit(1)).alias("warnings"))
    broken = plan.problems.groupBy("clip_id").agg(F.count(F.lit(1)).alias("problems"))
    rows = plan.summary.join(warned, "clip_id", "left").join(broken, "clip_id", "left")
    return rows.withColumns({"warnings": F.coalesce("warnings", F.lit(0)), "problems": F.coalesce("problems", F.lit(0))})


_SEG = """SELECT clip_id, frame_index, CASE det_a % 4 WHEN 0 THEN 'no_face' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'small_facecam' ELSE 'fullscreen_face' END AS layout,
    CASE WHEN det_b % 3 = 0 THEN 'profile_fallback' ELSE 'automatic' END AS detection_source, det_b % 2 = 0 AS duplicate_facecam_excluded, det_a, det_b, det_c FROM rects"""


def layout_rows(spark, folder):
    a, b = F.col("det_a"), F.col("det_b")
    layout = F.when(a % 4 == 0, "no_face").when(a % 4 == 1, "uncertain").when(a % 4 == 2, "small_facecam").otherwise("fullscreen_face")
    return rects(spark, folder).select(*ID, layout.alias("layout"), F.when(b % 3 == 0, "profile_fallback").otherwise("automatic").alias("detection_source"), (b % 2 == 0).alias("duplicate_facecam_excluded"))


@query("layout_counts", with_views("rects", f"""SELECT clip_id, count(*) AS segments, count(CASE WHEN layout = 'fullscreen_face' THEN 1 END) AS fullscreen_face, count(CASE WHEN layout = 'small_facecam' THEN 1 END) AS small_facecam,
    count(CASE WHEN layout = 'no_face' THEN 1 END) AS no_face, count(CASE WHEN layout = 'uncertain' THEN 1 END) AS uncertain, count(CASE WHEN layout IN ('no_face','uncertain') THEN 1 END) AS fallbacks FROM ({_SEG}) GROUP BY 1"""))
def q_layout_counts(spark, folder):
    return bx.layout_counts(layout_rows(spark, folder), ["clip_id"])


@query("composition_warnings", with_views("rects", f"""SELECT {KEY}, code FROM (SELECT *, unnest([CASE WHEN layout = 'no_face' THEN 'face_not_detected' WHEN layout = 'uncertain' THEN 'layout_uncertain' WHEN detection_source = 'profile_fallback' THEN 'profile_facecam_fallback' END,
    CASE WHEN layout = 'small_facecam' AND NOT duplicate_facecam_excluded THEN 'duplicate_facecam_visible' END]) AS code FROM ({_SEG})) WHERE code IS NOT NULL"""))
def q_composition_warnings(spark, folder):
    return bx.composition_warnings(layout_rows(spark, folder), ID)


@query("detection_counts", with_views("rects", """SELECT clip_id, count(DISTINCT frame_index) AS frames, count(*) AS boxes, count(CASE WHEN confidence >= 0.55 THEN 1 END) AS accepted FROM rects GROUP BY 1"""))
def q_detection_counts(spark, folder):
    per_frame = rects(spark, folder).groupBy("clip_id", "frame_index").agg(F.count(F.lit(1)).alias("b"), F.count_if(F.col("confidence") >= 0.55).alias("a"))
    return per_frame.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("b").alias("boxes"), F.sum("a").alias("accepted"))


@query("frame_difference_stats", with_views("vectors", """SELECT vod_id, count(*) AS frames, coalesce(avg(d), 0) AS motion_score, coalesce(max(d), 0) AS scene_change_score FROM (
    SELECT vod_id, idx, list_avg(list_transform(list_zip(embedding, lag(embedding) OVER (PARTITION BY vod_id ORDER BY idx)), lambda z: abs(z[1] - z[2]))) AS d FROM vectors) GROUP BY 1"""))
def q_frame_difference(spark, folder):
    v = ordered_scan(vectors(spark, folder), ["vod_id"], ["idx"], index_chunk("idx", 4096), lag={"before": F.col("embedding")})
    change = F.aggregate(F.zip_with("embedding", "before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x) / F.size("embedding")
    d = v.withColumn("d", F.when(F.col("before").isNotNull(), change))
    return d.groupBy("vod_id").agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("motion_score"), F.coalesce(F.max("d"), F.lit(0.0)).alias("scene_change_score"))


@query("best_detection_hint", with_views("rects", """SELECT clip_id, coalesce(max(CASE WHEN confidence >= 0.55 THEN width * height END), 0) / 2073600 AS face_area_ratio,
    CASE WHEN max(confidence) < 0.55 THEN 'no_face' WHEN max(CASE WHEN confidence >= 0.55 THEN width * height END) / 2073600 >= 0.08 THEN 'fullscreen_camera_hint' ELSE 'facecam_overlay_hint' END AS layout_hint,
    arg_max(CASE WHEN (y + height / 2) / 1080 < 0.4 THEN 'top' WHEN (y + height / 2) / 1080 > 0.6 THEN 'bottom' ELSE 'center' END || '_' || CASE WHEN (x + width / 2) / 1920 < 0.4 THEN 'left' WHEN (x + width / 2) / 1920 > 0.6 THEN 'right' ELSE 'center' END,
      CASE WHEN confidence >= 0.55 THEN {'a': width * height, 'd': -det_a, 'e': -det_b, 'f': -det_c} END) AS position FROM rects GROUP BY 1"""))
def q_best_detection(spark, folder):
    return bx.detection_hint(boxed(spark, folder), ["clip_id"], [-F.col("det_a"), -F.col("det_b"), -F.col("det_c")], FW, FH)


@query("stabilize_segments")
def q_stabilize(spark, folder):
    segs = bx.finalize_geometry(bx.gate_confidence(scene_segments(spark, folder)), FW, FH)
    out = bx.stabilize_segments(bx.cut_to_files(segs), ["clip_id"])
    return out.select("clip_id", "scene_id", "start", "end", "layout", "confidence", F.array_join("reasons", ",").alias("reasons"))


_CORR = """(list_dot_product(a, b) - list_sum(a) * list_sum(b) / len(a)) / sqrt((list_dot_product(a, a) - list_sum(a) * list_sum(a) / len(a)) * (list_dot_product(b, b) - list_sum(b) * list_sum(b) / len(b)))"""


@query("fingerprint_similarity", with_views("vectors", f"""SELECT vec_id, greatest(0, least(1, ({_CORR} + 1) / 2)) * 0.45 + (1 - bit_count(xor(vec_id * 2654435761 % 4294967296, lead_id * 2654435761 % 4294967296)) / 64.0) * 0.35 + 0.20 * (vec_id % 10) / 10 AS similarity
    FROM (SELECT x.vec_id, y.vec_id AS lead_id, list_transform(x.embedding, lambda v: v + 1) AS a, list_transform(y.embedding, lambda v: v + 1) AS b FROM vectors x JOIN vectors y ON y.vec_id = x.vec_id + 1)"""))
def q_fingerprint_similarity(spark, folder):
    v = vectors(spark, folder).select("vec_id", F.transform("embedding", lambda x: x + 1).alias("hist"), F.array(F.col("vec_id") * 2654435761 % 4294967296).alias("hash"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hist").alias("h2"), F.col("hash").alias("b2"))
    score = bx.fingerprint_similarity(bx.correlation(F.col("hist"), F.col("h2")), bx.hash_agreement(F.col("hash"), F.col("b2"), 64), F.col("vec_id") % 10 / 10)
    return v.join(other, "vec_id").select("vec_id", score.alias("similarity"))


_SCORES = """SELECT o_orderkey AS frame_id, l.ord AS layout_ord, l.id AS layout_id, l.phase AS phase, (o_custkey * (7 + 6 * l.ord) % 101) / 100.0::DOUBLE AS match_score, 0.5::DOUBLE AS minimum_match_score, (o_orderkey % 40)::DOUBLE AS sharpness
    FROM orders, (VALUES (0, 'camera', 'talking'), (1, 'camera_wide', 'talking'), (2, 'overlay', 'gameplay')) l(ord, id, phase)"""


@query("profile_match_decision", f"""WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER w AS rn, lead(match_score) OVER w AS s2, lead(phase) OVER w AS p2 FROM s WINDOW w AS (PARTITION BY frame_id ORDER BY match_score DESC, layout_ord)),
    b AS (SELECT *, match_score - s2 AS m FROM r WHERE rn = 1)
    SELECT frame_id, CASE WHEN sharpness < 12 THEN 'unknown' WHEN match_score < 0.5 THEN 'waiting_unmatched' WHEN m < 0.08::DOUBLE AND p2 <> phase THEN 'unknown' ELSE layout_id END AS layout_id,
      CASE WHEN sharpness < 12 THEN 'unknown' WHEN match_score < 0.5 THEN 'waiting_or_music' WHEN m < 0.08::DOUBLE AND p2 <> phase THEN 'unknown' ELSE phase END AS phase,
      CASE WHEN sharpness < 12 THEN 0 ELSE match_score END AS match_score, CASE WHEN sharpness < 12 THEN 0 ELSE m END AS score_margin,
      CASE WHEN sharpness < 12 THEN 'frame_quality_too_low' WHEN match_score < 0.5 THEN 'no_known_layout_above_threshold,valid_frame_unmatched_is_waiting,rejected_' || layout_id
           WHEN m < 0.08::DOUBLE AND p2 = phase THEN 'same_phase_layout_tie_resolved,known_layout_matched,matched_' || layout_id WHEN m < 0.08::DOUBLE THEN 'layout_scores_ambiguous' ELSE 'known_layout_matched,matched_' || layout_id END AS reasons FROM b""")
def q_profile_match(spark, folder):
    layouts = F.array(*[F.struct(F.lit(o).alias("layout_ord"), F.lit(i).alias("layout_id"), F.lit(p).alias("phase")) for o, i, p in ((0, "camera", "talking"), (1, "camera_wide", "talking"), (2, "overlay", "gameplay"))])
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("frame_id"), "o_custkey", F.explode(layouts).alias("l")).select("frame_id", "o_custkey", "l.*")
    scores = rows.withColumns({"match_score": F.col("o_custkey") * (7 + 6 * F.col("layout_ord")) % 101 / 100.0, "minimum_match_score": F.lit(0.5)})
    m = bx.match_layouts(scores, ["frame_id"], (F.col("frame_id") % 40).cast("double"))
    return m.select("frame_id", "layout_id", "phase", "match_score", "score_margin", F.array_join("reasons", ",").alias("reasons"))
