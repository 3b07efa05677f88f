"""Registered queries: candidates, metrics, reports, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions import text as tx
from tidemark.operators import candidates as cd
from tidemark.operators import metrics as mt
from tidemark.operators import rules as ru
from tidemark.operators import signals as sg
from tidemark.operators import terms as tm
from tidemark.operators import timeline as tl
from tidemark.operators import transcripts as tr
from tidemark.operators.jobs import latest_per_key
from tidemark.plans import text_sql as q
from tidemark.plans.catalog_timeline import BLOCKS, DETAIL, SEGMENTS, blocks_of, detail_segs, layout_segs
from tidemark.plans.catalog_text import documents
from tidemark.plans.registry import Registry
from tidemark.plans.views import segments, state_samples, table, with_views

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

# Label rules that fire on the given texts; the default rules name other subjects.
RULES = [("numbers and tokens", [["token", "key"], ["@", "http"]]), ("les and los", [[r"\bles\b"], [r"\blos\b", "die"]])]


@query("topic_label", """SELECT doc_id, CASE WHEN (contains(t, 'token') OR contains(t, 'key')) AND (contains(t, '@') OR contains(t, 'http')) THEN 'numbers and tokens' WHEN regexp_matches(t, '\\bles\\b') AND (regexp_matches(t, '\\blos\\b') OR contains(t, 'die')) THEN 'les and los'
    WHEN lang = 'en' THEN 'tema sin etiqueta específica' ELSE source END AS label FROM (SELECT *, lower(text) AS t FROM documents)""")
def q_label(spark, folder):
    terms = F.when(F.col("lang") == "en", cd.empty_strings()).otherwise(F.array("source"))
    return documents(spark, folder).select("doc_id", cd.topic_label(F.col("text"), terms, RULES).alias("label"))


@query("candidate_title", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN contains(lower(text), 'en') THEN 'Speaker habla sobre la IA y los ilustradores' ELSE 'Speaker habla sobre la IA y los ilustradores' END WHEN 1 THEN 'Speaker habla sobre los gestores de contenido de los streamers'
    WHEN 2 THEN 'Speaker habla sobre partido Francia-Marruecos' ELSE 'Speaker habla sobre ' || source END AS title FROM documents""")
def q_title(spark, folder):
    names = [name for name, _ in cd.LABEL_RULES]
    label = F.when(F.col("doc_id") % 4 == 0, names[0]).when(F.col("doc_id") % 4 == 1, names[1]).when(F.col("doc_id") % 4 == 2, names[3]).otherwise(F.col("source"))
    return documents(spark, folder).select("doc_id", cd.candidate_title(label, F.col("text"), cd.empty_strings()).alias("title"))


@query("title_grounding", f"""WITH b AS (SELECT item_id, string_split(text, ' ') AS terms FROM benchmark),
    d AS (SELECT doc_id, terms, {q.normalize('d.text')} AS nt FROM documents d JOIN b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
    l AS (SELECT *, list_transform(list_filter(string_split(nt, ' '), lambda p: p <> ''), lambda p: {q.lemma('p')}) AS dl FROM d),
    t AS (SELECT doc_id, nt, dl, unnest(terms) AS term, unnest(range(len(terms))) AS i FROM l), n AS (SELECT *, {q.normalize('term')} AS tn FROM t),
    m AS (SELECT *, list_transform(list_filter(string_split(tn, ' '), lambda p: p <> '' AND {q.content('p')}), lambda p: {q.lemma('p')}) AS ll FROM n),
    g AS (SELECT *, (tn = 'ia' AND contains(nt, 'inteligencia artificial')) OR (tn <> '' AND contains(' ' || nt || ' ', ' ' || tn || ' ')) OR (len(ll) > 0 AND len(list_filter(ll, lambda x: NOT list_contains(dl, x))) = 0) AS ok FROM m)
    SELECT doc_id, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS score, coalesce(string_agg(CASE WHEN NOT ok THEN term END, ',' ORDER BY i), '') AS unsupported FROM g GROUP BY 1""")
def q_title_grounding(spark, folder):
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("slot"), F.split("text", " ").alias("terms"))
    count = table(spark, folder, "benchmark").agg(F.count(F.lit(1))).scalar()
    d = documents(spark, folder).withColumn("slot", F.col("doc_id") % count).join(items, "slot")
    d = d.withColumn("n", tx.normalize(F.col("text"))).withColumn("l", tx.lemmas_of(F.col("n")))
    g = cd.title_grounding(F.col("terms"), F.col("n"), F.col("l"))
    return d.withColumn("g", g).select("doc_id", F.col("g.score").alias("score"), F.array_join("g.unsupported", ",").alias("unsupported"))


@query("extractive_summary")
def q_summary(spark, folder):
    d = documents(spark, folder).withColumn("sentences", F.filter(tx.sentences(F.col("text")), lambda s: F.size(tx.plain_words(s)) >= 6))
    terms = tm.distinctive_terms(documents(spark, folder), ["doc_id"], [], own_corpus=True)
    d = d.join(terms, "doc_id")
    concepts = F.transform("terms", lambda t: t["term"])
    return d.select("doc_id", cd.extractive_summary(F.col("sentences"), concepts).alias("summary"))


@query("duration_fit", """SELECT o_orderkey AS id, CASE WHEN d BETWEEN 480 AND 900 THEN 1 ELSE greatest(0, 1 - abs(d - CASE WHEN d < 480 THEN 480 ELSE 900 END) / CASE WHEN d < 480 THEN 480 ELSE 900 END) END AS fit FROM (SELECT o_orderkey, o_totalprice / 300 AS d FROM orders)""")
def q_duration_fit(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), sc.duration_fit(F.col("o_totalprice") / 300, 480.0, 900.0).alias("fit"))


_PARTS = {"semantic_coherence": 3, "self_containment": 7, "duration_fit": 11, "opening_quality": 13, "closing_quality": 17, "title_specificity": 19, "title_grounding": 23, "keyword_quality": 29, "summary_grounding": 31, "transcript_quality": 37}


def scored(spark, folder):
    o = table(spark, folder, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), "o_custkey", *[(F.col("o_custkey") * m % 101 / 100.0).alias(n) for n, m in _PARTS.items()])
    rows = rows.withColumns({"topic_specificity": F.col("title_specificity"), "unsupported_terms": F.when(F.col("id") % 9 == 0, F.array(F.lit("name"))).otherwise(cd.empty_strings()),
        "keywords": F.when(F.col("id") % 10 == 0, cd.empty_strings()).otherwise(F.array(F.lit("k"))), "summary": F.when(F.col("id") % 13 == 0, "El bloque trata sobre x").otherwise("texto")})
    return cd.candidate_score(rows, {
        "unsupported_title_entity": F.size("unsupported_terms") > 0, "low_keyword_quality": F.col("keyword_quality") < 0.45,
        "topic_label_not_grounded": F.col("topic_specificity") < 0.45, "template_summary": F.col("summary").startswith("El bloque trata sobre")})


_SCORED = {
    "s0": f"SELECT o_orderkey AS id, {', '.join(f'(o_custkey * {m} % 101) / 100.0::DOUBLE AS {n}' for n, m in _PARTS.items())} FROM orders",
    "s1": f"""SELECT *, greatest(0, least(100, round(100 * ({' + '.join(f'{n} * {w}::DOUBLE' for n, w in cd.WEIGHTS.items())}), 9) - CASE WHEN id % 9 = 0 THEN 40 ELSE 0 END - CASE WHEN keyword_quality < 0.45 THEN 20 ELSE 0 END - CASE WHEN title_specificity < 0.45 THEN 30 ELSE 0 END - CASE WHEN id % 13 = 0 THEN 15 ELSE 0 END)) AS raw FROM s0""",
}


@query("candidate_score", "WITH " + ", ".join(f"{n} AS ({b})" for n, b in _SCORED.items()) + """ SELECT id, round(raw, 6) AS score, array_to_string(list_filter([CASE WHEN id % 9 = 0 THEN 'unsupported_title_entity' END, CASE WHEN keyword_quality < 0.45 THEN 'low_keyword_quality' END,
    CASE WHEN title_specificity < 0.45 THEN 'topic_label_not_grounded' END, CASE WHEN id % 13 = 0 THEN 'template_summary' END], lambda x: x IS NOT NULL), ',') AS penalties, true AS one_digit FROM s1""")
def q_candidate_score(spark, folder):
    s = scored(spark, folder)
    raw = sum((F.col(n) * w for n, w in cd.WEIGHTS.items()), F.lit(0.0))
    minus = sum((F.when(F.array_contains("penalties", n), p).otherwise(0) for n, p in cd.PENALTIES.items()), F.lit(0))
    full = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 * raw, 9) - minus))
    return s.select("id", F.round(full, 6).alias("score"), F.array_join("penalties", ",").alias("penalties"), (F.abs(F.col("score") - full) <= 0.0500001).alias("one_digit"))


@query("quality_gate", "WITH " + ", ".join(f"{n} AS ({b})" for n, b in _SCORED.items()) + """ SELECT id, array_to_string(list_filter([CASE WHEN id % 10 = 0 THEN 'insufficient_distinctive_terms' END, CASE WHEN keyword_quality < 0.45 THEN 'stopword_dominated_keywords' END, CASE WHEN title_specificity < 0.45 THEN 'generic_topic' END,
    CASE WHEN id % 9 = 0 THEN 'title_not_grounded' END, CASE WHEN id % 9 = 0 THEN 'unsupported_entity' END, CASE WHEN id % 9 <> 0 AND title_grounding < 0.85 THEN 'title_not_grounded' END,
    CASE WHEN id % 13 = 0 OR summary_grounding < 0.80 THEN 'generic_summary' END, CASE WHEN semantic_coherence < 0.38 THEN 'low_semantic_coherence' END, CASE WHEN raw < 54.95 THEN 'below_minimum_candidate_score' END], lambda x: x IS NOT NULL), ',') AS failures FROM s1""")
def q_quality_gate(spark, folder):
    return scored(spark, folder).select("id", F.array_join(cd.quality_failures(), ",").alias("failures"))


def ranges(spark, folder):
    d = documents(spark, folder)
    start = (F.col("doc_id") * 37 % 2000).cast("double")
    return d.select(F.col("source").alias("vod_id"), F.col("doc_id").alias("id"), start.alias("safe_start"), (start + 100 + F.col("n_chars") % 300).alias("safe_end"),
        (F.col("n_chars") % 1000 / 10).alias("score"), F.array_join(tx.plain_words(F.col("text")), " ").alias("title"))


_RANGES = """SELECT source AS vod_id, doc_id AS id, (doc_id * 37 % 2000)::DOUBLE AS a, (doc_id * 37 % 2000)::DOUBLE + 100 + n_chars % 300 AS b, (n_chars % 1000) / 10 AS score,
    array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' ') AS title FROM documents"""
_SHARE = "greatest(0, least(x.b, y.b) - greatest(x.a, y.a)) / greatest(1, least(x.b - x.a, y.b - y.a))"


@query("diversify_topk", f"""WITH r0 AS ({_RANGES}), r AS (SELECT *, list_distinct(string_split({q.normalize('title')}, ' ')) AS w FROM r0),
    l AS (SELECT vod_id, list({{'id': id, 'a': a, 'b': b, 'w': w}} ORDER BY score DESC, id) AS l FROM r GROUP BY 1),
    k AS (SELECT vod_id, list_reduce(l, lambda acc, x: CASE WHEN len(acc) >= 10 OR len(list_filter(acc, lambda y: {_SHARE} > 0.45 OR len(list_intersect(x.w, y.w)) / greatest(1, len(x.w)) > 0.8)) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0]) AS kept FROM l)
    SELECT vod_id, unnest(kept).id AS id, unnest(range(1, len(kept) + 1)) AS place FROM k""")
def q_diversify(spark, folder):
    return cd.diversify(ranges(spark, folder), ["vod_id"], ["id"]).select("vod_id", "id", F.col("picked").alias("place"))


@query("topk_candidates", f"WITH r AS ({_RANGES}) SELECT vod_id, id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY score DESC, id) AS rn FROM r) WHERE rn <= 10")
def q_topk_candidates(spark, folder):
    from pyspark.sql import Window

    # A rank filter over a window: Spark keeps ten rows per key in every task before the shuffle.
    w = Window.partitionBy("vod_id").orderBy(F.desc("score"), "id")
    ranked = ranges(spark, folder).withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return ranked.select("vod_id", "id", F.col("rank").cast("long").alias("rank"))


@query("pairwise_overlap", f"WITH r0 AS ({_RANGES}), r AS (SELECT * REPLACE (vod_id || '/' || (id // 400) AS vod_id) FROM r0) SELECT x.vod_id, x.id AS id_a, y.id AS id_b, {_SHARE} AS overlap FROM r x JOIN r y ON x.vod_id = y.vod_id AND x.id < y.id AND x.b > y.a AND x.a < y.b")
def q_pairwise(spark, folder):
    # A recording has a few dozen candidates: the pairs grow with the recordings.
    r = ranges(spark, folder)
    return cd.pairwise_overlap(r.withColumn("vod_id", F.concat("vod_id", F.lit("/"), F.floor(F.col("id") / 400).cast("string"))), ["vod_id"])


@query("topic_candidates_end_to_end")
def q_candidates(spark, folder):
    s = segments(spark, folder)
    t = tr.topics(s, minimum=100.0, maximum=300.0)
    rows = cd.score_candidates(t.select("vod_id", "block", "start", "end", "coherence_score"), s)
    return rows.select("vod_id", "id", "exact_start", "exact_end", "title", "summary", F.array_join("keywords", "|").alias("keywords"), "score", F.array_join("failures", ",").alias("failures"))


@query("topic_pipeline")
def q_topic_pipeline(spark, folder):
    selected, rejected = cd.topic_pipeline(segments(spark, folder), minimum=100.0, maximum=300.0)
    columns = ["vod_id", "id", "exact_start", "exact_end", "title", "score", F.array_join("failures", ",").alias("failures")]
    return selected.select(*columns, F.col("picked").cast("int").alias("place")).unionByName(rejected.select(*columns, F.lit(None).cast("int").alias("place")))


@query("output_invariants")
def q_invariants(spark, folder):
    s = segments(spark, folder)
    t = tr.topics(s, minimum=100.0, maximum=300.0)
    rows = cd.score_candidates(t.select("vod_id", "block", "start", "end", "coherence_score"), s)
    return ru.violations(rows, ["vod_id", "id"], {
        "no_filler_keyword": ~F.exists("keywords", lambda k: k.isin(tx.FILLER_PHRASES)), "no_unsupported_term": F.size("unsupported_terms") == 0,
        "grounding": F.col("title_grounding") >= 0.85, "keyword_not_stopword": ~F.exists("keywords", lambda k: tx.normalize(k).isin(tx.STOP_FOLDED))})


# ---- ground truth, metrics, reports


def boundaries(segs):
    """Boundaries of a timeline, from its segments as they are: they are found once for all that looks at them."""
    return tr.cut_lineage(mt.detector_boundaries(segs, blocks_of(segs)))


def notes(found):
    wide = found.groupBy("vod_id").pivot("transition", mt.NOTES).agg(F.max("detector_seconds"))
    shift = F.col("vod_id") % 11 - 5
    moved = {n: F.when((F.col("vod_id") + i) % 3 != 0, F.coalesce(n, F.lit(7.0)) + shift) for i, n in enumerate(mt.NOTES)}
    return wide.withColumns(moved)


_PICK = lambda n, c: f"max(CASE WHEN number = {n} THEN {c} END)"
_BOUND = {
    **BLOCKS,
    "tb": f"""SELECT vod_id, coalesce(max(CASE WHEN is_primary THEN start END), {_PICK(1, 'start')}) AS talking_start, coalesce(max(CASE WHEN is_primary THEN "end" END), {_PICK(1, '"end"')}) AS talking_end, {_PICK(2, 'start')} AS talking_block_2_start,
        {_PICK(2, '"end"')} AS talking_block_2_end, {_PICK(3, 'start')} AS talking_block_3_start, {_PICK(3, '"end"')} AS talking_block_3_end FROM blocks GROUP BY 1""",
    "gb": """SELECT vod_id, min(start) AS gameplay_start, arg_min("end", start) AS gameplay_end FROM segs WHERE phase = 'gameplay' GROUP BY 1""",
    "wb": "SELECT v.vod_id, " + ", ".join(mt.NOTES) + " FROM (SELECT DISTINCT vod_id FROM segs) v LEFT JOIN tb ON v.vod_id = tb.vod_id LEFT JOIN gb ON v.vod_id = gb.vod_id",
    "nt": "SELECT vod_id, " + ", ".join(f"CASE WHEN (vod_id + {i}) % 3 <> 0 THEN coalesce({n}, 7.0) + vod_id % 11 - 5 END AS {n}" for i, n in enumerate(mt.NOTES)) + " FROM wb",
    "cmp": " UNION ALL ".join(f"SELECT n.vod_id, '{n}' AS transition, b.{n} AS detector_seconds, n.{n} AS actual_seconds, b.{n} - n.{n} AS error_seconds, abs(b.{n} - n.{n}) AS absolute_error_seconds FROM nt n JOIN wb b ON n.vod_id = b.vod_id WHERE n.{n} IS NOT NULL" for n in mt.NOTES),
}


@query("ground_truth_compare", with_views("state_samples", "SELECT * FROM cmp", **_BOUND))
def q_compare(spark, folder):
    found = boundaries(layout_segs(spark, folder))
    return mt.compare_notes(found, notes(found))


@query("segment_metrics", with_views("state_samples", """SELECT f.vod_id, e.mae AS mean_absolute_error_seconds, e.mx AS maximum_absolute_error_seconds, detected_phase_count, coalesce(om, 0) AS omitted_phase_count,
    CASE WHEN coalesce(ntalk, 0) > 0 THEN greatest(0, talk - ntalk) ELSE 0 END + CASE WHEN coalesce(ngame, 0) > 0 THEN greatest(0, game - ngame) ELSE 0 END AS false_detection_count, mean_confidence, coalesce(er, 0) AS errors
    FROM (SELECT vod_id, count(*) AS detected_phase_count, count(CASE WHEN phase = 'talking' THEN 1 END) AS talk, count(CASE WHEN phase = 'gameplay' THEN 1 END) AS game, sum(("end" - start) * confidence) / sum("end" - start) AS mean_confidence FROM segs GROUP BY 1) f
    LEFT JOIN (SELECT vod_id, avg(absolute_error_seconds) AS mae, max(absolute_error_seconds) AS mx, count(CASE WHEN detector_seconds IS NULL THEN 1 END) AS om, count(error_seconds) AS er, count(CASE WHEN transition IN ('talking_start','talking_block_2_start','talking_block_3_start') THEN 1 END) AS ntalk,
      count(CASE WHEN transition = 'gameplay_start' THEN 1 END) AS ngame FROM cmp GROUP BY 1) e ON f.vod_id = e.vod_id""", **_BOUND))
def q_metrics(spark, folder):
    segs = layout_segs(spark, folder)
    found = boundaries(segs)
    rows = mt.segment_metrics(segs, mt.compare_notes(found, notes(found)))
    errors = F.coalesce(F.size(F.map_keys("error_by_transition")), F.lit(0)).cast("long")
    return rows.withColumn("errors", errors).drop("error_by_transition")


_CLOCK = lambda c: f"printf('%02d:%02d:%02d', CAST(round_even({c}, 0) AS BIGINT) // 3600, CAST(round_even({c}, 0) AS BIGINT) % 3600 // 60, CAST(round_even({c}, 0) AS BIGINT) % 60)"
_SECONDS = lambda p: f"""sum(CASE WHEN phase = '{p}' THEN "end" - start ELSE 0 END)"""
_LISTED = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN 'none' ELSE replace({c}, ',', ', ') END"
_LINES = lambda section, source, items: f"SELECT vod_id, {section} AS section, CAST(unnest(range(len(l))) AS INTEGER) AS ord, unnest(l) AS line FROM (SELECT vod_id, [{', '.join(items)}] AS l FROM {source})"
_THRESHOLDS = '{\n  "confirmation": 2\n}'
_SECTION = lambda title: ["''", f"'## {title}'", "''"]
_REPORT = {
    **DETAIL, **_BOUND,
    "rcmp": "SELECT * FROM cmp WHERE vod_id % 7 <> 0",
    "dseg": """SELECT s.*, match_score, second_best_score, score_margin, r.labels AS reasons, w.labels AS warnings FROM segs s JOIN d1 USING (vod_id, run)
        LEFT JOIN d2 r ON r.vod_id = s.vod_id AND r.run = s.run AND r.kind = 'r' LEFT JOIN d2 w ON w.vod_id = s.vod_id AND w.run = s.run AND w.kind = 'w'""",
    "met": """SELECT f.vod_id, e.mae, e.mx, detected, coalesce(om, 0) AS om, CASE WHEN coalesce(ntalk, 0) > 0 THEN greatest(0, talk - ntalk) ELSE 0 END + CASE WHEN coalesce(ngame, 0) > 0 THEN greatest(0, game - ngame) ELSE 0 END AS wrong, conf
        FROM (SELECT vod_id, count(*) AS detected, count(CASE WHEN phase = 'talking' THEN 1 END) AS talk, count(CASE WHEN phase = 'gameplay' THEN 1 END) AS game, sum(("end" - start) * confidence) / sum("end" - start) AS conf FROM segs GROUP BY 1) f
        LEFT JOIN (SELECT vod_id, avg(absolute_error_seconds) AS mae, max(absolute_error_seconds) AS mx, count(CASE WHEN detector_seconds IS NULL THEN 1 END) AS om,
          count(CASE WHEN transition IN ('talking_start','talking_block_2_start','talking_block_3_start') THEN 1 END) AS ntalk, count(CASE WHEN transition = 'gameplay_start' THEN 1 END) AS ngame FROM rcmp GROUP BY 1) e ON f.vod_id = e.vod_id""",
    "facts": f"""SELECT s.vod_id, d.duration, {_SECONDS('waiting_or_music')} AS wa, {_SECONDS('talking')} AS ta, {_SECONDS('gameplay')} AS ga, {_SECONDS('unknown')} AS un,
        (SELECT count(*) FROM state_samples x WHERE x.vod_id = s.vod_id) AS samples, (SELECT count(*) FROM blocks b WHERE b.vod_id = s.vod_id) AS blocks, (SELECT max(CASE WHEN is_primary THEN id END) FROM blocks b WHERE b.vod_id = s.vod_id) AS pri
        FROM segs s JOIN dur d ON d.vod_id = s.vod_id GROUP BY s.vod_id, d.duration""",
    "whole": "SELECT f.*, m.* EXCLUDE (vod_id) FROM facts f LEFT JOIN met m ON m.vod_id = f.vod_id",
}
_REPORT_PARTS = [
    _LINES(0, "whole", ["'# Validation report'", "''", "'- Pipeline version: `v1`'", "'- Detection strategy: `layout`'", "'- Requires coarse timeline: `' || CASE WHEN vod_id % 2 = 0 THEN 'True' ELSE 'False' END || '`'", "'- Source: Recording ' || vod_id",
        "'- Layout samples: ' || CASE WHEN vod_id % 5 = 0 THEN 'legacy unavailable' ELSE samples::VARCHAR END", *[f"'- {n}: ' || {_CLOCK(c)}" for n, c in (("Analyzed duration", "duration"), ("Waiting detected", "wa"), ("Talking detected", "ta"), ("Gameplay detected", "ga"), ("Unknown", "un"))],
        "'- Talking blocks: ' || blocks", "'- Primary block: ' || coalesce(pri, 'none')", "'- Warnings: ' || CASE WHEN pri IS NULL THEN 'primary_talking_block_not_found' ELSE 'none' END", "'- Mean confidence: ' || printf('%.3f', conf)", "'- Analysis time: ' || printf('%.2f', vod_id % 7 + 0.5::DOUBLE) || ' seconds'",
        *_SECTION("Thresholds used"), "'```json'", *[f"'{x}'" for x in _THRESHOLDS.split("\n")], "'```'", *_SECTION("Detected segments")]),
    f"""SELECT vod_id, 1, CAST(run AS INTEGER), '- ' || {_CLOCK('start')} || '–' || {_CLOCK('"end"')} || ' ' || phase || ', confidence ' || printf('%.3f', confidence) || '; reasons: ' || {_LISTED('reasons')} || '; warnings: ' || {_LISTED('warnings')} FROM dseg""",
    _LINES(2, "(SELECT * FROM facts WHERE vod_id % 5 <> 0)", _SECTION("Matched layouts")),
    f"""SELECT vod_id, 2, CAST(run AS INTEGER) + 3, '- ' || {_CLOCK('start')} || '–' || {_CLOCK('"end"')} || ' `' || layout_id || '`: match ' || printf('%.3f', match_score) || ', second ' || printf('%.3f', second_best_score) || ', margin ' || printf('%.3f', score_margin) FROM dseg WHERE vod_id % 5 <> 0 AND score_margin IS NOT NULL""",
    _LINES(3, "facts", _SECTION("Manual comparison")), "SELECT vod_id, 3, 3, 'No validation notes supplied.' FROM facts WHERE vod_id NOT IN (SELECT vod_id FROM rcmp)",
    f"""SELECT vod_id, 3, 3 + CAST(list_position([{q.quoted(mt.NOTES)}], transition) - 1 AS INTEGER), '- ' || transition || ': detector ' || CASE WHEN detector_seconds IS NULL THEN 'missing' ELSE {_CLOCK('detector_seconds')} END || '; actual ' || {_CLOCK('greatest(0, actual_seconds)')} || '; error ' ||
        CASE WHEN error_seconds IS NULL THEN 'n/a' ELSE CASE WHEN error_seconds >= 0 THEN '+' ELSE '' END || printf('%.1f', error_seconds) || ' seconds' END FROM rcmp""",
    _LINES(4, "whole", [*_SECTION("Metrics"), "'- Mean absolute error: ' || coalesce(mae::VARCHAR, 'None')", "'- Maximum absolute error: ' || coalesce(mx::VARCHAR, 'None')", "'- Detected phases: ' || detected", "'- Omitted phases: ' || om", "'- False detections: ' || wrong",
        *_SECTION("Validation notes JSON"), "'```json'", "'{\"vod\": ' || vod_id || '}'", "'```'", "''"]),
]


@query("validation_report", with_views("state_samples", " UNION ALL ".join(_REPORT_PARTS), **_REPORT))
def q_report(spark, folder):
    segs = tr.cut_lineage(detail_segs(spark, folder))
    plain = layout_segs(spark, folder)
    found = blocks_of(plain)
    counted = found.groupBy("vod_id").agg(F.count(F.lit(1)).alias("talking_blocks"), F.max(F.when(F.col("is_primary"), F.col("id"))).alias("primary_talking_block_id"))
    samples = state_samples(spark, folder)
    facts = tl.state_durations(segs).join(tl.durations_of(samples), "vod_id").join(samples.groupBy("vod_id").agg(F.count(F.lit(1)).alias("completed_samples")), "vod_id").join(counted, "vod_id", "left")
    v = F.col("vod_id")
    facts = tr.cut_lineage(facts.withColumns({
        "pipeline_version": F.lit("v1"), "strategy": F.lit("layout"), "requires_coarse": v % 2 == 0, "title": F.concat(F.lit("Recording "), v), "completed_samples": F.when(v % 5 != 0, F.col("completed_samples")),
        "analyzed_duration": F.col("duration"), "talking_blocks": F.coalesce("talking_blocks", F.lit(0)), "analysis_seconds": v % 7 + 0.5, "thresholds": F.lit(_THRESHOLDS), "notes": F.concat(F.lit('{"vod": '), v, F.lit("}")),
        "warnings": F.array_compact(F.array(F.when(F.col("primary_talking_block_id").isNull(), "primary_talking_block_not_found"))),
    }))
    bounds = boundaries(plain)
    compared = tr.cut_lineage(mt.compare_notes(bounds, notes(bounds)).where("vod_id % 7 <> 0"))
    return mt.report_lines(facts, segs, compared, mt.segment_metrics(segs, compared), segs.where("vod_id % 5 <> 0 AND score_margin IS NOT NULL"))


@query("ground_truth_notes", """SELECT c_custkey AS job_id, CASE WHEN r.note IS NULL THEN 0 ELSE r.note END AS talking_start, r.note IS NULL AS is_default FROM customer c LEFT JOIN (SELECT o_custkey, arg_max(floor(o_totalprice), {'d': o_orderdate, 'k': o_orderkey}) AS note FROM orders GROUP BY 1) r ON c.c_custkey = r.o_custkey""")
def q_notes(spark, folder):
    saved = table(spark, folder, "orders").select(F.col("o_custkey").alias("job_id"), "o_orderdate", "o_orderkey", F.floor("o_totalprice").cast("double").alias("note"))
    latest = latest_per_key(saved, ["job_id"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("job_id")).join(latest, "job_id", "left").select(
        "job_id", F.coalesce("note", F.lit(0.0)).alias("talking_start"), F.col("note").isNull().alias("is_default"))


# Artifacts that may be exported.
EXPORTS = [
    "metadata.json", "coarse_timeline.json", "phase_timeline.json", "layout_timeline.json", "timeline.png", "summary.md", "validation_report.md",
    "raw_phase_scores.json", "smoothed_windows.json", "transition_graph.json",
]
_NAMES = [*EXPORTS, "cookies.txt", "source.mp4"]


@query("export_whitelisted", f"SELECT o_orderkey AS job_id, [{q.quoted(_NAMES)}][1 + o_custkey % {len(_NAMES)}] AS name FROM orders WHERE o_custkey % {len(_NAMES)} < {len(EXPORTS)} AND o_orderstatus <> 'P'")
def q_export(spark, folder):
    names = F.array(*[F.lit(n) for n in _NAMES])
    manifest = table(spark, folder, "orders").select(F.col("o_orderkey").alias("job_id"), F.get(names, F.col("o_custkey") % len(_NAMES)).alias("name"), (F.col("o_orderstatus") != "P").alias("present"))
    return manifest.where(F.col("present") & F.col("name").isin(EXPORTS)).select("job_id", "name")


@query("assemble_results", with_views("state_samples", """SELECT s.vod_id, s.segments, s.phases, coalesce(b.blocks, 0) AS blocks, CASE WHEN b.p IS NULL THEN 'primary_talking_block_not_found' ELSE '' END AS warnings
    FROM (SELECT vod_id, count(*) AS segments, string_agg(phase, ',' ORDER BY run) AS phases FROM segs GROUP BY 1) s LEFT JOIN (SELECT vod_id, count(*) AS blocks, max(CASE WHEN is_primary THEN id END) AS p FROM blocks GROUP BY 1) b ON s.vod_id = b.vod_id""", **BLOCKS))
def q_assemble(spark, folder):
    from tidemark.sources.writers import assemble_results

    segs = layout_segs(spark, folder)
    nested = assemble_results(segs, blocks_of(segs))
    return nested.select("vod_id", F.size("timeline").cast("long").alias("segments"), F.array_join(F.transform("timeline", lambda s: s["phase"]), ",").alias("phases"),
        F.size("talking_blocks").cast("long").alias("blocks"), F.array_join("warnings", ",").alias("warnings"))


@query("signal_frame_stats", with_views("state_samples", """SELECT f.vod_id, avg(rms) AS rms_mean, var_pop(rms) AS rms_variance, any_value(peak) AS peak_level, quantile_cont(rms, 0.95) - quantile_cont(rms, 0.10) AS dynamic_range, any_value(zcr) AS zero_crossing_rate,
      greatest(0, 1 - least(1, var_pop(rms) / greatest(avg(rms) * avg(rms), 1e-8))) AS energy_continuity FROM f JOIN z ON f.vod_id = z.vod_id GROUP BY 1""",
    s="SELECT vod_id, idx, (value - 50) / 500 AS x FROM state_samples",
    f0="SELECT vod_id, idx // 8 AS f, count(*) AS n, sqrt(avg(x * x) + 1e-12) AS rms FROM s GROUP BY 1, 2",
    f="SELECT * FROM f0 QUALIFY n = 8 OR max(n) OVER (PARTITION BY vod_id) < 8",
    z="""SELECT vod_id, max(abs(x)) AS peak, coalesce(avg(CASE WHEN p IS NULL THEN NULL WHEN (x < 0) <> (p < 0) THEN 1.0 ELSE 0.0 END), 0) AS zcr FROM (SELECT *, lag(x) OVER (PARTITION BY vod_id ORDER BY idx) AS p FROM s) GROUP BY 1"""))
def q_signal(spark, folder):
    s = state_samples(spark, folder).select("vod_id", "idx", ((F.col("value") - 50) / 500).alias("x"))
    return sg.frame_stats(s, ["vod_id"], "idx", "x", frame=8)


@query("spectral_flatness")
def q_flatness(spark, folder):
    s = state_samples(spark, folder).select("vod_id", "idx", ((F.col("value") - 50) / 500).alias("x"))
    return sg.spectral_flatness(s, ["vod_id"], "idx", "x")
