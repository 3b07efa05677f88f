"""Clip candidates from topics: labels, titles, grounding, scores, gates, diversity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CANDIDATE, CandidateConfig
from tidemark.functions import scalar as sc
from tidemark.functions import text as tx
from tidemark.operators import terms as tm
from tidemark.operators.chunked import index_chunk, join_same, ordered_scan, select_rounds
from tidemark.operators.intervals import overlap_join
from tidemark.operators.ranges import split_long_ranges
from tidemark.operators.transcripts import clean_transcript, topics
from tidemark.session import cut_lineage

NO_LABEL = "tema sin etiqueta específica"

# Label rules in order. A rule holds when every group has at least one word in the lower-case text.
LABEL_RULES = [
    ("IA y trabajo de ilustradores", [["inteligencia artificial", r"\bia\b"], ["artista", "ilustrador", "miniatura"]]),
    ("gestores de contenido para streamers", [["gestor"], ["contenido"], ["streamer", "youtuber", "creador"]]),
    ("Francia-Marruecos y el PSG", [["francia"], ["marruecos"], ["psg"]]),
    ("partido Francia-Marruecos", [["francia"], ["marruecos"]]),
]


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def topic_label(text: Column, terms: Column, rules: Sequence = tuple(LABEL_RULES)) -> Column:
    """The first rule that holds, else the best term, else a fixed text."""
    low = F.lower(text)

    def any_of(words: Sequence[str]) -> Column:
        checks = [low.rlike(w) if w.startswith("\\b") else F.contains(low, F.lit(w)) for w in words]
        out = checks[0]
        for c in checks[1:]:
            out = out | c
        return out

    label = None
    for name, groups in rules:
        holds = any_of(groups[0])
        for group in groups[1:]:
            holds = holds & any_of(group)
        label = F.when(holds, name) if label is None else label.when(holds, name)
    fallback = F.when(F.size(terms) > 0, F.get(terms, F.lit(0))).otherwise(NO_LABEL)
    return fallback if label is None else label.otherwise(fallback)


def candidate_title(label: Column, text: Column, representatives: Column, speaker: str = CANDIDATE.speaker) -> Column:
    low = F.lower(text)
    psg = F.array_contains(F.split(tx.normalize(text), " "), "psg") & F.array_contains(F.split(tx.normalize(F.array_join(representatives, " ")), " "), "psg")
    return (
        F.when((label == "IA y trabajo de ilustradores") & F.contains(low, F.lit("miniatura")), f"{speaker} habla sobre la IA y el trabajo de los artistas")
        .when(label == "IA y trabajo de ilustradores", f"{speaker} habla sobre la IA y los ilustradores")
        .when(label == "gestores de contenido para streamers", f"{speaker} habla sobre los gestores de contenido de los streamers")
        .when(label.startswith("Francia-Marruecos") & psg, f"{speaker} comenta el Francia-Marruecos y el PSG")
        .when(label.startswith("Francia-Marruecos"), f"{speaker} comenta el partido Francia-Marruecos")
        .otherwise(F.concat(F.lit(f"{speaker} habla sobre "), label))
    )


def title_grounding(terms: Column, normal_text: Column, text_lemmas: Column) -> Column:
    """Struct (score, evidence, unsupported) of title terms against a text."""
    checked = F.transform(terms, lambda t: F.struct(t.alias("t"), tx.grounded(tx.normalize(t), normal_text, text_lemmas, t).alias("g")))

    def summarise(c: Column) -> Column:
        good = F.filter(c, lambda x: x["g"]["ok"])
        return F.struct(
            F.when(F.size(c) > 0, F.size(good) / F.size(c)).otherwise(0.0).alias("score"),
            F.array_distinct(F.flatten(F.transform(good, lambda x: x["g"]["evidence"]))).alias("evidence"),
            F.transform(F.filter(c, lambda x: ~x["g"]["ok"]), lambda x: x["t"]).alias("unsupported"),
        )

    return tx.bind(checked, summarise)


def extractive_summary(sentences: Column, concepts: Column, keep: int = 2) -> Column:
    """The sentences with most title concepts, in text order. Concepts are prepared once a text, sentences once each."""
    def best_of(terms: Column) -> Column:
        def hits(s: Column) -> Column:
            return tx.bind(tx.normalize(s), lambda n: tx.bind(tx.lemmas_of(n), lambda l: F.size(F.filter(terms, lambda t: tx.holds(t, n, l)))))

        ranked = F.sort_array(F.transform(sentences, lambda s, i: F.struct((-hits(s)).alias("h"), i.alias("i"), s.alias("s"))))
        best = F.sort_array(F.transform(F.slice(ranked, 1, keep), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
        return F.array_join(F.transform(best, lambda x: x["s"]), " ")

    return tx.bind(F.transform(concepts, lambda t: tx.prepared_term(tx.normalize(t))), best_of)


# Weights of the score components and sizes of the penalties.
WEIGHTS = {
    "semantic_coherence": 0.16, "self_containment": 0.10, "duration_fit": 0.10, "opening_quality": 0.07, "closing_quality": 0.07,
    "title_specificity": 0.10, "title_grounding": 0.16, "keyword_quality": 0.11, "summary_grounding": 0.08, "transcript_quality": 0.05,
}
PENALTIES = {
    "unsupported_title_entity": 40, "stopword_dominated_title": 35, "generic_title": 20, "low_keyword_quality": 20,
    "topic_label_not_grounded": 30, "template_summary": 15,
}


def candidate_score(rows: DataFrame, penalties: dict[str, Column]) -> DataFrame:
    """Score from the component columns minus the penalties that apply, within 0 and 100, one digit."""
    applied = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in penalties.items()]))
    minus = sum((F.when(F.coalesce(c, F.lit(False)), PENALTIES[name]).otherwise(0) for name, c in penalties.items()), F.lit(0))
    total = sum((F.col(name) * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 * total, 9) - minus))
    return rows.withColumns({"penalties": applied, "score": F.bround(score, 1)})


def quality_failures(config: CandidateConfig = CANDIDATE) -> Column:
    """Reason codes over the columns of a scored candidate; empty when it passes."""
    unsupported = F.size("unsupported_terms") > 0
    generic = (F.col("summary") == "") | F.col("summary").startswith(f"{config.speaker} comenta") | F.col("summary").startswith("El bloque trata sobre")
    return F.array_distinct(F.array_compact(F.array(
        F.when(F.size("keywords") == 0, "insufficient_distinctive_terms"), F.when(F.col("keyword_quality") < 0.45, "stopword_dominated_keywords"),
        F.when(F.col("topic_specificity") < 0.45, "generic_topic"), F.when(unsupported, "title_not_grounded"), F.when(unsupported, "unsupported_entity"),
        F.when(F.col("title_grounding") < 0.85, "title_not_grounded"), F.when(generic, "generic_summary"), F.when(F.col("summary_grounding") < 0.80, "generic_summary"),
        F.when(F.col("semantic_coherence") < config.min_coherence, "low_semantic_coherence"), F.when(F.col("score") < config.min_score, "below_minimum_candidate_score"),
    )))


def overlap_ratio(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Shared seconds over the shorter length."""
    shared = F.greatest(F.lit(0.0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))
    return shared / F.greatest(F.lit(1.0), F.least(a[1] - a[0], b[1] - b[0]))


def diversify(candidates: DataFrame, keys: Sequence[str], order: Sequence[str], maximum: int = CANDIDATE.max_candidates) -> DataFrame:
    """By falling score, keep candidates that neither overlap a kept one by more than 0.45 nor repeat its title words.

    At most `maximum` are kept, in rounds of the best remaining candidates that fit (see `select_rounds`); no recording is
    collected. Input: `score`,
    `safe_start`, `safe_end`, `title`; `order` breaks ties.
    """
    words = F.array_distinct(F.split(tx.normalize(F.col("title")), " "))
    numbered = cut_lineage(candidates.withColumns({"title_words": words, "__row_id": F.monotonically_increasing_id()}))  # equal rows stay apart
    ranked = numbered.withColumn("__rank_of", F.struct((-F.col("score")).alias("a"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("__row_id").alias("z")))

    def fits(state: Column, row: Column) -> Column:
        span = (row["safe_start"], row["safe_end"])
        return ~F.exists(state["kept"], lambda k: (overlap_ratio(span, (k["a"], k["b"])) > 0.45) | (tx.containment(row["title_words"], k["w"]) > 0.8))

    def take(state: Column, row: Column) -> dict[str, Column]:
        item = F.struct(row["safe_start"].cast("double").alias("a"), row["safe_end"].cast("double").alias("b"), row["title_words"].alias("w"))
        return {"kept": F.array_append(state["kept"], item)}

    kept = {"kept": ("array<struct<a:double,b:double,w:array<string>>>", F.array())}
    picked = select_rounds(ranked, keys, maximum, ["safe_start", "safe_end", "title_words"], kept, fits, take, "__rank_of")
    return picked.where(F.col("picked").isNotNull()).drop("title_words", "__row_id", "__rank_of")


def pairwise_overlap(candidates: DataFrame, keys: Sequence[str], bucket: float = 300.0) -> DataFrame:
    """Overlap of candidate pairs that share time; pairs that do not are never built."""
    from tidemark.operators.intervals import range_join

    a = candidates.select(*keys, F.col("id").alias("id_a"), F.col("safe_start").alias("a0"), F.col("safe_end").alias("a1"))
    b = candidates.select(*keys, F.col("id").alias("id_b"), F.col("safe_start").alias("b0"), F.col("safe_end").alias("b1"))
    pairs = range_join(a, b, keys, ("a0", "a1"), ("b0", "b1"), (F.col("id_a") < F.col("id_b")) & (F.col("a1") > F.col("b0")) & (F.col("a0") < F.col("b1")), bucket)
    return pairs.select(*keys, "id_a", "id_b", overlap_ratio((F.col("a0"), F.col("a1")), (F.col("b0"), F.col("b1"))).alias("overlap"))


def score_candidates(topics: DataFrame, segments: DataFrame, keys: Sequence[str] = ("vod_id",), config: CandidateConfig = CANDIDATE) -> DataFrame:
    """Topics (`block`, `start`, `end`, `coherence_score`) and segments to scored candidates with `failures`.

    A piece is at most the maximum candidate length, so its text is short; all texts of a recording form its corpus.
    """
    by = [*keys, "block", "piece"]
    parent = topics.select(*keys, "block", "coherence_score")
    pieces = split_long_ranges(topics, [*keys, "block"], config.target_max, config.max_seconds).drop("split_reason")
    parts = segments.select(*keys, "pos", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), F.col("text").alias("seg_text"), "avg_logprob", "no_speech_probability")
    inside = cut_lineage(overlap_join(pieces, parts, keys))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "seg_text")))
    clear = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + F.coalesce("avg_logprob", F.lit(-1.0)))) * (1 - F.coalesce("no_speech_probability", F.lit(0.0)))
    gathered = inside.groupBy(*by).agg(
        F.min_by("seg_start", "pos").alias("exact_start"), F.max_by("seg_end", "pos").alias("exact_end"), F.avg(clear).alias("transcript_quality"),
        F.transform(ordered, lambda x: x["seg_text"]).alias("texts"),
    )
    base = cut_lineage(join_same(pieces, gathered, by, "left").select(
        *by, F.coalesce("exact_start", "start").alias("exact_start"), F.coalesce("exact_end", "end").alias("exact_end"),
        F.coalesce("transcript_quality", F.lit(0.0)).alias("transcript_quality"), F.coalesce("texts", empty_strings()).alias("texts"),
    ).withColumn("text", F.array_join("texts", " ")))
    details = tm.distinctive_terms(base, by, list(keys)).withColumnRenamed("terms", "details")
    rows = join_same(base, details, by, "left").withColumn("details", F.coalesce("details", F.expr("cast(array() as array<struct<term:string,score:double,frequency:bigint,document_frequency:bigint,distribution:double>>)")))
    rows = rows.withColumn("terms", F.transform("details", lambda t: t["term"]))
    rows = rows.withColumn("label", topic_label(F.col("text"), F.col("terms")))
    rows = rows.withColumn("asked", F.concat(F.array("label"), tx.title_terms(candidate_title(F.col("label"), F.col("text"), empty_strings(), config.speaker), config.speaker), F.col("terms")))
    rows = cut_lineage(rows)
    best = tm.rank_sentences(rows, by, "text", "asked")
    rows = join_same(rows, best, by, "left").withColumn("sentences", F.coalesce("sentences", empty_strings())).drop("asked")
    rows = rows.withColumns({"title": candidate_title(F.col("label"), F.col("text"), F.col("sentences"), config.speaker), "n": tx.normalize(F.col("text")), "ns": tx.normalize(F.array_join("sentences", " "))})
    rows = rows.withColumns({"concepts": tx.title_terms(F.col("title"), config.speaker), "l": tx.lemmas_of(F.col("n")), "ls": tx.lemmas_of(F.col("ns"))})
    rows = cut_lineage(rows)
    rows = rows.withColumns({"g": title_grounding(F.col("concepts"), F.col("n"), F.col("l")), "gs": title_grounding(F.col("concepts"), F.col("ns"), F.col("ls"))})
    rows = rows.withColumns({
        "title_grounding": F.when(F.col("gs.score") >= 0.30, F.col("g.score")).otherwise(F.col("g.score") * 0.5),
        "grounding_evidence": F.array_distinct(F.concat("g.evidence", "gs.evidence")), "unsupported_terms": F.col("g.unsupported"),
        "summary": extractive_summary(F.col("sentences"), F.col("concepts")), "keyword_quality": tm.keyword_quality(F.col("details"), F.col("n"), F.col("l")),
    })
    rows = cut_lineage(join_same(rows, parent, [*keys, "block"]))
    traced = F.forall(F.slice("sentences", 1, 2), lambda s: F.contains(F.col("text"), s))
    rows = rows.withColumns({
        "semantic_coherence": tm.semantic_coherence(F.col("coherence_score"), F.col("details")),
        "summary_grounding": F.when((F.col("summary") != "") & traced, 1.0).otherwise(0.0),
        "opening_quality": F.when(F.size(tx.plain_words(F.get("texts", F.lit(0)))) >= 5, 0.75).otherwise(0.45),
        "closing_quality": F.when(F.trim(F.get("texts", F.size("texts") - 1)).rlike("[.!?…]$"), 0.75).otherwise(0.4),
        "duration_fit": sc.duration_fit(F.col("exact_end") - F.col("exact_start"), config.target_min, config.target_max),
    })
    label_words = F.split(tx.normalize(F.col("label")), " ")
    numeric = F.forall(label_words, lambda t: t.rlike("^[0-9]+$") | t.isin(tx.NUMBER_WORDS)) & (tx.normalize(F.col("label")) != "")
    own = F.get(F.filter("details", lambda t: tx.normalize(t["term"]) == tx.normalize(F.col("label"))), F.lit(0))
    lasting = F.coalesce((own["frequency"] >= 2) & (own["distribution"] >= 0.5), F.lit(False))
    explicit = F.col("label").isin([name for name, _ in LABEL_RULES])
    specificity = F.when((F.col("label") == NO_LABEL) | numeric, 0.0).when(
        explicit | ((F.size(label_words) >= 2) & lasting), F.least(F.lit(1.0), F.col("keyword_quality") + 0.15)
    ).otherwise(0.4)
    rows = rows.withColumns({"topic_specificity": specificity, "title_specificity": specificity,
        "self_containment": (F.col("opening_quality") + F.col("closing_quality") + F.col("semantic_coherence")) / 3})
    concepts = F.transform("concepts", lambda t: tx.normalize(t))
    rows = cut_lineage(candidate_score(rows, {
        "unsupported_title_entity": F.size("unsupported_terms") > 0,
        "stopword_dominated_title": (F.size("concepts") > 0) & F.forall(concepts, lambda t: t.isin(tx.STOP_FOLDED)),
        "generic_title": (F.col("label") == NO_LABEL) | tx.normalize(F.col("label")).isin(tx.GENERIC_TERMS),
        "low_keyword_quality": F.col("keyword_quality") < 0.45, "topic_label_not_grounded": F.col("topic_specificity") < 0.45,
        "template_summary": F.col("summary").startswith(f"{config.speaker} comenta") | F.col("summary").startswith("El bloque trata sobre"),
    }))
    rows = rows.withColumns({
        "id": F.format_string("candidate-%03d-%d", F.col("block") + 1, F.col("piece") + 1), "keywords": F.slice("terms", 1, 5),
        "safe_start": F.greatest(F.lit(0.0), F.col("exact_start") - config.margin), "safe_end": F.col("exact_end") + config.margin,
        "opening_preview": F.slice("texts", 1, 3), "transcript_preview": F.substring("text", 1, 800),
    })
    return rows.withColumn("failures", quality_failures(config)).drop("n", "ns", "l", "ls", "g", "gs", "details", "terms", "concepts", "texts")


def accepted_and_rejected(scored: DataFrame, keys: Sequence[str] = ("vod_id",), config: CandidateConfig = CANDIDATE) -> tuple[DataFrame, DataFrame]:
    good = scored.where(F.size("failures") == 0)
    return diversify(good, keys, ["block", "piece"], config.max_candidates), scored.where(F.size("failures") > 0)


def topic_pipeline(segments: DataFrame, keys: Sequence[str] = ("vod_id",), config: CandidateConfig = CANDIDATE, **limits: float) -> tuple[DataFrame, DataFrame]:
    """Raw transcript segments to (selected, rejected) candidates.

    Segments are cleaned, those that stay are numbered anew without gaps, topics are cut and scored, and the gate and the
    diverse choice follow. `selected` has the place among a recording's candidates as `picked`; candidates that pass the gate but
    repeat a better one are in neither. `rejected` carries the reasons as `failures`. `limits` go to `topics`.
    """
    cleaned = clean_transcript(segments, keys).where("removed IS NULL").drop("removed", "raw_text")
    order = ordered_scan(cleaned, keys, ["pos"], index_chunk("pos"), row_number="rank")
    heard = cut_lineage(order.withColumn("pos", F.col("rank") - 1).drop("rank"))
    blocks = topics(heard, keys, **limits).select(*keys, "block", "start", "end", "coherence_score")
    return accepted_and_rejected(cut_lineage(score_candidates(cut_lineage(blocks), heard, keys, config)), keys, config)
