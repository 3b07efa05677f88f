"""Registered queries over documents, transcripts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions import text as tx
from tidemark.functions import vectors as vc
from tidemark.operators import terms as tm
from tidemark.operators.chunked import index_chunk, ordered_scan
from tidemark.plans import text_sql as q
from tidemark.plans.registry import Registry
from tidemark.plans.views import segments, table, vectors, with_views

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
SPEAKER = "Speaker"


def documents(spark, folder):
    return table(spark, folder, "documents")


@query("normalize_text", f"SELECT doc_id, {q.normalize('text')} AS normal FROM documents")
def q_normalize(spark, folder):
    return documents(spark, folder).select("doc_id", tx.normalize(F.col("text")).alias("normal"))


@query("tokenize_words", f"""SELECT doc_id, len(regexp_extract_all(text, '{tx.LATIN}')) AS latin, len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{tx.WORD}')) AS words,
    md5(array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{tx.WORD}'), ' ')) AS words_md5 FROM documents""")
def q_tokenize(spark, folder):
    return documents(spark, folder).select(
        "doc_id", F.size(tx.latin_tokens(F.col("text"))).cast("long").alias("latin"), F.size(tx.words(F.col("text"))).cast("long").alias("words"),
        F.md5(F.array_join(tx.words(F.col("text")), " ")).alias("words_md5"))


_TOKENS = f"SELECT {q.fold('tok')} AS f FROM (SELECT unnest(regexp_extract_all(text, '{tx.LATIN}')) AS tok FROM documents)"


@query("basic_lemma", f"SELECT f AS token, {q.lemma('f')} AS lemma, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL")
def q_lemma(spark, folder):
    tokens = documents(spark, folder).select(F.explode(tx.latin_tokens(F.col("text"))).alias("t")).select(tx.fold_token(F.col("t")).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("lemma", tx.lemma(F.col("token")))


@query("is_content_token", f"SELECT f AS token, {q.content('f')} AS content, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL")
def q_content(spark, folder):
    tokens = documents(spark, folder).select(F.explode(tx.latin_tokens(F.col("text"))).alias("t")).select(tx.fold_token(F.col("t")).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("content", tx.is_content(F.col("token")))


@query("filler_ratio", f"""SELECT doc_id, CASE WHEN len(t) = 0 THEN 1.0 ELSE len(list_filter(t, lambda x: {q.fold('x')} IN ({q.quoted(tx.STOPWORDS)}))) / len(t) END AS filler
    FROM (SELECT doc_id, regexp_extract_all(text, '{tx.LATIN}') AS t FROM documents)""")
def q_filler(spark, folder):
    return documents(spark, folder).select("doc_id", tx.filler_ratio(F.col("text")).alias("filler"))


_GROUND = f"""g0 AS (SELECT d.doc_id, b.text AS term, {q.normalize('d.text')} AS nt FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
    g1 AS (SELECT *, {q.normalize('term')} AS tn FROM g0),
    g2 AS (SELECT *, list_transform(list_filter(string_split(tn, ' '), lambda p: p <> '' AND {q.content('p')}), lambda p: {q.lemma('p')}) AS tl,
        list_transform(list_filter(string_split(nt, ' '), lambda p: p <> ''), lambda p: {q.lemma('p')}) AS dl FROM g1)"""


@query("term_grounded", f"""WITH {_GROUND} SELECT doc_id, term, (tn = 'ia' AND contains(nt, 'inteligencia artificial')) OR (tn <> '' AND contains(' ' || nt || ' ', ' ' || tn || ' ')) OR (len(tl) > 0 AND len(list_filter(tl, lambda x: NOT list_contains(dl, x))) = 0) AS ok,
    CASE WHEN tn = 'ia' AND contains(nt, 'inteligencia artificial') THEN 'inteligencia artificial' WHEN tn <> '' AND contains(' ' || nt || ' ', ' ' || tn || ' ') THEN term
         WHEN len(tl) > 0 AND len(list_filter(tl, lambda x: NOT list_contains(dl, x))) = 0 THEN array_to_string(tl, ',') ELSE '' END AS evidence FROM g2""")
def q_grounded(spark, folder):
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("slot"), F.col("text").alias("term"))
    count = table(spark, folder, "benchmark").agg(F.count(F.lit(1))).scalar()
    d = documents(spark, folder).select("doc_id", tx.normalize(F.col("text")).alias("n"))
    # Every document names exactly one item.
    paired = d.withColumn("slot", F.col("doc_id") % count).join(items, "slot").withColumn("l", tx.lemmas_of(F.col("n")))
    g = tx.grounded(tx.normalize(F.col("term")), F.col("n"), F.col("l"), F.col("term"))
    return paired.select("doc_id", "term", g["ok"].alias("ok"), F.array_join(g["evidence"], ",").alias("evidence"))


@query("title_terms", f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(title, '(?i)^{SPEAKER}\\s+(habla|comenta|explica)\\s+(sobre\\s+)?', ''), '{tx.LATIN}'),
      lambda t: {q.content(q.fold('t'))} OR (upper(t) = t AND lower(t) <> t) OR regexp_full_match(t, '[0-9]+')), ',') AS terms
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{SPEAKER} habla sobre ' ELSE 'speaker comenta ' END || text AS title FROM documents)""")
def q_title_terms(spark, folder):
    prefix = F.when(F.col("doc_id") % 2 == 0, f"{SPEAKER} habla sobre ").otherwise("speaker comenta ")
    title = F.concat(prefix, F.col("text"))
    return documents(spark, folder).select("doc_id", F.array_join(tx.title_terms(title, SPEAKER), ",").alias("terms"))


@query("repeated_text_ratio", f"""WITH w AS (SELECT doc_id, unnest(l) AS a, unnest(range(len(l))) AS i, len(l) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '{tx.WORD}') AS l FROM documents)),
    t AS (SELECT doc_id, n, a || ' ' || lead(a) OVER k || ' ' || lead(a, 2) OVER k AS tri FROM w WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT doc_id, CASE WHEN max(n) < 4 THEN 0 ELSE 1 - count(DISTINCT tri) / (max(n) - 2) END AS ratio FROM t GROUP BY 1)
    SELECT d.doc_id, coalesce(ratio, 0) AS ratio FROM documents d LEFT JOIN r USING (doc_id)""")
def q_repeated(spark, folder):
    return documents(spark, folder).select("doc_id", tx.repeated_text_ratio(F.col("text")).alias("ratio"))


_COUNTS = q.terms("documents", "source, doc_id")
_CTE = lambda parts: "WITH " + ", ".join(f"{n} AS ({b})" for n, b in parts.items())


@query("term_counts", _CTE(_COUNTS) + " SELECT doc_id, term, frequency FROM counts")
def q_term_counts(spark, folder):
    return tm.term_counts(documents(spark, folder), ["doc_id"])


@query("document_frequency", _CTE(_COUNTS) + " SELECT source, term, count(*) AS document_frequency FROM counts GROUP BY ALL")
def q_document_frequency(spark, folder):
    return tm.document_frequency(tm.term_counts(documents(spark, folder), ["source", "doc_id"]), ["source"])


_TERMS = q.distinctive("documents", "source, doc_id", "source", 8)


@query("distinctive_terms", _CTE(_TERMS) + """ SELECT doc_id, i AS rank, t.term AS term, t.score AS score, t.frequency AS frequency, t.document_frequency AS document_frequency, t.distribution AS distribution
    FROM (SELECT doc_id, unnest(terms) AS t, unnest(range(len(terms))) AS i FROM chosen)""")
def q_distinctive_terms(spark, folder):
    t = tm.distinctive_terms(documents(spark, folder), ["source", "doc_id"], ["source"])
    return t.select("doc_id", F.posexplode("terms").alias("rank", "t")).select("doc_id", F.col("rank").cast("long").alias("rank"), "t.*")


@query("topk_terms", _CTE(q.distinctive("documents", "source, doc_id", "source", 5)) + """ SELECT doc_id, array_to_string(list_transform(terms, lambda t: t.term), '|') AS terms FROM chosen""")
def q_topk_terms(spark, folder):
    t = tm.distinctive_terms(documents(spark, folder), ["source", "doc_id"], ["source"], maximum=5)
    return t.select("doc_id", F.array_join(F.transform("terms", lambda x: x["term"]), "|").alias("terms"))


def with_terms(spark, folder):
    d = documents(spark, folder).select("source", "doc_id", "text", tx.normalize(F.col("text")).alias("n"))
    t = tm.distinctive_terms(documents(spark, folder), ["source", "doc_id"], ["source"])
    return d.join(t, ["source", "doc_id"]).withColumn("l", tx.lemmas_of(F.col("n")))


@query("keyword_quality", _CTE({**_TERMS,
    "tl": f"SELECT doc_id, unnest(terms) AS t, len(terms) AS n FROM chosen",
    "dn": f"SELECT doc_id, {q.normalize('text')} AS nt FROM documents",
    "dl": f"SELECT doc_id, nt, list_transform(list_filter(string_split(nt, ' '), lambda p: p <> ''), lambda p: {q.lemma('p')}) AS dl FROM dn",
    "k": f"SELECT tl.*, nt, dl, {q.normalize('t.term')} AS tn FROM tl JOIN dl USING (doc_id)",
    "k2": f"SELECT *, list_transform(list_filter(string_split(tn, ' '), lambda p: p <> '' AND {q.content('p')}), lambda p: {q.lemma('p')}) AS ll FROM k"}) + """
    SELECT doc_id, least(1, 0.65::DOUBLE * sum(CASE WHEN (tn <> '' AND contains(' ' || nt || ' ', ' ' || tn || ' ')) OR (len(ll) > 0 AND len(list_filter(ll, lambda x: NOT list_contains(dl, x))) = 0) THEN 1 ELSE 0 END) / any_value(n)
      + 0.35::DOUBLE * sum(least(1, t.distribution * 2)) / any_value(n)) AS quality FROM k2 GROUP BY 1""")
def q_keyword_quality(spark, folder):
    return with_terms(spark, folder).select("doc_id", tm.keyword_quality(F.col("terms"), F.col("n"), F.col("l")).alias("quality"))


@query("semantic_coherence", _CTE(_TERMS) + """ SELECT doc_id, greatest(0, least(1, 0.65::DOUBLE * (doc_id % 10) / 10.0::DOUBLE + 0.35::DOUBLE * len(list_filter(terms[1:5], lambda t: t.distribution >= 0.5)) / greatest(1, len(terms[1:5])))) AS coherence FROM chosen""")
def q_semantic_coherence(spark, folder):
    t = tm.distinctive_terms(documents(spark, folder), ["source", "doc_id"], ["source"])
    return t.select("doc_id", tm.semantic_coherence(F.col("doc_id") % 10 / 10.0, F.col("terms")).alias("coherence"))


@query("transcript_density_quality", with_views("segments", f"""SELECT vod_id, avg(greatest(0, least(1, 1 + avg_logprob)) * (1 - no_speech_probability)) AS quality,
    least(1, sum(len(regexp_extract_all(text, '{tx.WORD}'))) / greatest(1, (max("end") - min(start)) * 1.7::DOUBLE)) AS density FROM segments GROUP BY 1"""))
def q_density(spark, folder):
    s = segments(spark, folder)
    clear = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + F.col("avg_logprob"))) * (1 - F.col("no_speech_probability"))
    spoken = F.sum(F.size(F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0))))
    return s.groupBy("vod_id").agg(F.avg(clear).alias("quality"), F.least(F.lit(1.0), spoken / F.greatest(F.lit(1.0), (F.max("end") - F.min("start")) * 1.7)).alias("density"))


@query("transcript_quality", with_views("segments", f"""SELECT vod_id, words, words / d AS words_per_second, greatest(0, least(1, 0.4::DOUBLE * least(1, greatest(0, 1 + CASE WHEN lp = 0 THEN -1 ELSE lp END)) + 0.3::DOUBLE * (1 - ns) + 0.3::DOUBLE * least(1, words / greatest(1, d * 1.5::DOUBLE)))) AS quality
    FROM (SELECT vod_id, CAST(sum(len(regexp_extract_all(text, '{tx.WORD}'))) AS BIGINT) AS words, avg(avg_logprob) AS lp, avg(no_speech_probability) AS ns, max("end") - min(start) AS d FROM segments GROUP BY 1)"""))
def q_transcript_quality(spark, folder):
    s = segments(spark, folder)
    facts = s.groupBy("vod_id").agg(
        F.sum(F.size(F.regexp_extract_all("text", F.lit(tx.WORD), F.lit(0)))).alias("words"), F.avg("avg_logprob").alias("lp"),
        F.avg("no_speech_probability").alias("ns"), (F.max("end") - F.min("start")).alias("d"))
    # A mean log probability of exactly 0 counts as missing.
    clear = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 + F.coalesce(F.nullif("lp", F.lit(0.0)), F.lit(-1.0))))
    dense = F.least(F.lit(1.0), F.col("words") / F.greatest(F.lit(1.0), F.col("d") * 1.5))
    return facts.select("vod_id", "words", (F.col("words") / F.col("d")).alias("words_per_second"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * clear + 0.3 * (1 - F.col("ns")) + 0.3 * dense)).alias("quality"))


_FEATURES = f"""SELECT doc_id, unnest(w) AS f FROM t UNION ALL SELECT doc_id, unnest(list_transform(list_zip(w[:len(w)-1], w[2:]), lambda z: z[1] || '_' || z[2])) FROM t"""


@query("hash_embedding", f"""WITH t AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{tx.WORD}') AS w FROM documents), f AS ({_FEATURES}),
    v AS (SELECT doc_id, CAST('0x' || substr(md5(f), 1, 15) AS BIGINT) AS v FROM f), s AS (SELECT doc_id, v % 384 AS dim, sum(CASE WHEN v % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w FROM v GROUP BY 1, 2 HAVING sum(CASE WHEN v % 2 = 1 THEN 1 ELSE -1 END) <> 0)
    SELECT doc_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM s""")
def q_hash_embedding(spark, folder):
    return tm.hash_features(documents(spark, folder), ["doc_id"])


_COS = "list_dot_product(a, b) / greatest(1e-9, sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"


@query("cosine_similarity", with_views("vectors", f"""SELECT vec_id, other, {_COS} AS similarity FROM (SELECT x.vec_id, y.vec_id AS other, x.embedding AS a, y.embedding AS b FROM vectors x JOIN vectors y ON y.vec_id = x.vec_id + 1)"""))
def q_cosine(spark, folder):
    v = vectors(spark, folder)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return v.join(other, "vec_id").select("vec_id", "other", vc.cosine(F.col("embedding"), F.col("b")).alias("similarity"))


@query("consecutive_similarity", with_views("vectors", f"""SELECT vod_id, idx, {_COS} AS similarity FROM (SELECT vod_id, idx, lag(embedding) OVER (PARTITION BY vod_id ORDER BY idx) AS a, embedding AS b FROM vectors) WHERE a IS NOT NULL"""))
def q_consecutive(spark, folder):
    v = ordered_scan(vectors(spark, folder), ["vod_id"], ["idx"], index_chunk("idx", 4096), lag={"before": F.col("embedding")})
    return v.where("before IS NOT NULL").select("vod_id", "idx", vc.cosine(F.col("before"), F.col("embedding")).alias("similarity"))


def centroids(v, keys):
    """Mean vector per group: summed by position with map-side combine, so members of a group never meet."""
    sums = v.select(*keys, F.posexplode("embedding").alias("p", "x")).groupBy(*keys, "p").agg(F.avg("x").alias("x"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"])
    return sums.groupBy(*keys).agg(packed.alias("centroid"))


@query("centroid_similarity", with_views("vectors", f"""SELECT vec_id, {_COS} AS similarity FROM (SELECT v.vec_id, v.embedding AS a, c.b FROM vectors v JOIN
    (SELECT vod_id, list(x ORDER BY p) AS b FROM (SELECT vod_id, p, avg(x) AS x FROM (SELECT vod_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS p FROM vectors) GROUP BY 1, 2) GROUP BY 1) c USING (vod_id))"""))
def q_centroid(spark, folder):
    v = vectors(spark, folder)
    return v.join(centroids(v, ["vod_id"]), "vod_id").select("vec_id", vc.cosine(F.col("embedding"), F.col("centroid")).alias("similarity"))


@query("set_jaccard", with_views("segments", f"""SELECT vod_id, pos, len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))) AS jaccard FROM (
    SELECT vod_id, pos, lag(w) OVER (PARTITION BY vod_id ORDER BY pos) AS a, w AS b FROM (SELECT vod_id, pos, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{tx.WORD}')) AS w FROM segments)) WHERE a IS NOT NULL"""))
def q_jaccard(spark, folder):
    s = segments(spark, folder).withColumn("w", F.array_distinct(tx.words(F.col("text"))))
    near = ordered_scan(s, ["vod_id"], ["pos"], index_chunk("pos", 4096), lag={"before": F.col("w")})
    return near.where("before IS NOT NULL").select("vod_id", "pos", tx.jaccard(F.col("before"), F.col("w")).alias("jaccard"))


@query("title_containment", with_views("segments", f"""SELECT vod_id, pos, len(list_intersect(b, a)) / greatest(1, len(b)) AS share, len(list_intersect(b, a)) / greatest(1, len(b)) > 0.8 AS duplicate FROM (
    SELECT vod_id, pos, lag(w) OVER (PARTITION BY vod_id ORDER BY pos) AS a, w AS b FROM (SELECT vod_id, pos, list_distinct(string_split({q.normalize('text')}, ' ')) AS w FROM segments)) WHERE a IS NOT NULL"""))
def q_title_containment(spark, folder):
    s = segments(spark, folder).withColumn("w", F.array_distinct(F.split(tx.normalize(F.col("text")), " ")))
    near = ordered_scan(s, ["vod_id"], ["pos"], index_chunk("pos", 4096), lag={"before": F.col("w")})
    share = tx.containment(F.col("w"), F.col("before"))
    return near.where("before IS NOT NULL").select("vod_id", "pos", share.alias("share"), (share > 0.8).alias("duplicate"))


@query("set_ops", f"""WITH w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{tx.WORD}')) AS word FROM documents),
    b AS (SELECT DISTINCT unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{tx.WORD}')) AS word FROM benchmark), d AS (SELECT DISTINCT word FROM w)
    SELECT 'shared' AS part, count(*) AS n FROM (SELECT word FROM d INTERSECT SELECT word FROM b) UNION ALL SELECT 'documents_only', count(*) FROM (SELECT word FROM d EXCEPT SELECT word FROM b)
    UNION ALL SELECT 'benchmark_only', count(*) FROM (SELECT word FROM b EXCEPT SELECT word FROM d) UNION ALL SELECT 'all', count(*) FROM (SELECT word FROM d UNION SELECT word FROM b)""")
def q_set_ops(spark, folder):
    d = documents(spark, folder).select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    b = table(spark, folder, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(d.intersect(b), "shared").union(count(d.exceptAll(b), "documents_only")).union(count(b.exceptAll(d), "benchmark_only")).union(count(d.union(b).distinct(), "all"))


_SENT = f"""sx AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s0, unnest(range(len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))))) AS pos FROM documents),
    sy AS (SELECT doc_id, pos, trim(s0, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM sx), sz AS (SELECT *, trim(regexp_replace(replace(lower(s), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ') AS k FROM sy WHERE len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 6),
    sd AS (SELECT doc_id, pos, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS rn FROM sz) WHERE rn = 1)"""


@query("split_sentences_rank", f"""WITH {_SENT}, b AS (SELECT d.doc_id, string_split(b.text, ' ') AS terms FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
    n AS (SELECT sd.*, terms, {q.normalize('s')} AS nt, regexp_extract_all(s, '{tx.LATIN}') AS lt FROM sd JOIN b USING (doc_id)),
    m AS (SELECT *, list_transform(list_filter(string_split(nt, ' '), lambda p: p <> ''), lambda p: {q.lemma('p')}) AS dl, CASE WHEN len(lt) = 0 THEN 1.0 ELSE len(list_filter(lt, lambda x: {q.fold('x')} IN ({q.quoted(tx.STOPWORDS)}))) / len(lt) END AS filler FROM n),
    h AS (SELECT doc_id, pos, s, filler, nt, dl, unnest(terms) AS term FROM m), h2 AS (SELECT *, {q.normalize('term')} AS tn FROM h),
    h3 AS (SELECT *, list_transform(list_filter(string_split(tn, ' '), lambda p: p <> '' AND {q.content('p')}), lambda p: {q.lemma('p')}) AS ll FROM h2),
    g AS (SELECT doc_id, pos, any_value(s) AS s, any_value(filler) AS filler, sum(CASE WHEN (tn = 'ia' AND contains(nt, 'inteligencia artificial')) OR (tn <> '' AND contains(' ' || nt || ' ', ' ' || tn || ' ')) OR (len(ll) > 0 AND len(list_filter(ll, lambda x: NOT list_contains(dl, x))) = 0) THEN 1 ELSE 0 END) AS hits FROM h3 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(hits * 2 + 1 - filler, 9) DESC, pos DESC) AS rn FROM g)
    SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY pos)) AS sentences_md5 FROM r WHERE rn <= 6 GROUP BY 1""")
def q_sentences(spark, folder):
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("slot"), F.split("text", " ").alias("terms"))
    count = table(spark, folder, "benchmark").agg(F.count(F.lit(1))).scalar()
    d = documents(spark, folder).withColumn("slot", F.col("doc_id") % count).join(items, "slot")
    r = tm.rank_sentences(d, ["doc_id"], "text", "terms", 6)
    return r.select("doc_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "|")).alias("sentences_md5"))


@query("probe_gate", "SELECT event_id, CASE WHEN value / 500 < 0.20 THEN 'voice_ratio_below_threshold' WHEN value % 7 < 2 THEN 'speech_run_too_short' END AS skip_reason FROM events")
def q_probe_gate(spark, folder):
    return table(spark, folder, "events").select("event_id", sc.probe_gate(F.col("value") / 500, F.col("value") % 7).alias("skip_reason"))


@query("preview_rows", with_views("segments", """SELECT vod_id, md5(string_agg(CASE WHEN pos < 3 THEN text END, '|' ORDER BY pos)) AS opening, md5(string_agg(CASE WHEN n - pos <= 3 THEN text END, '|' ORDER BY pos)) AS closing
    FROM (SELECT *, count(*) OVER (PARTITION BY vod_id) AS n FROM segments) GROUP BY 1"""))
def q_preview(spark, folder):
    s = segments(spark, folder)
    sizes = s.groupBy("vod_id").agg(F.count(F.lit(1)).alias("n"))
    near = s.join(sizes, "vod_id").where("pos < 3 OR n - pos <= 3")
    text_of = lambda cond: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("pos", "text")))), lambda x: x["text"]), "|"))
    return near.groupBy("vod_id").agg(text_of(F.col("pos") < 3).alias("opening"), text_of(F.col("n") - F.col("pos") <= 3).alias("closing"))
