"""Registered queries: transcripts, windows, topics, captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import transcripts as tr
from tidemark.operators.terms import hash_embedding
from tidemark.plans import text_sql as q
from tidemark.plans.registry import Registry
from tidemark.plans.views import segments, table, with_views

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_W = f"regexp_extract_all(replace(lower(t), 'ß', 'ss'), '{tx.WORD}')"


def dirty(spark, folder):
    """Transcripts in which every third turn repeats the text of the turn before the last multiple of three."""
    s = segments(spark, folder)
    base = s.select("vod_id", (F.col("pos") - F.col("pos") % 4).alias("pos"), F.col("text").alias("held"))
    same = base.join(s.where("pos % 4 = 0").select("vod_id", "pos", F.col("text").alias("lead_text")), ["vod_id", "pos"]).select("vod_id", "pos", "lead_text").distinct()
    out = s.withColumn("g", F.col("pos") - F.col("pos") % 4).join(same.withColumnRenamed("pos", "g"), ["vod_id", "g"])
    text = F.when(F.col("vod_id") % 3 == 0, F.col("lead_text")).when(F.col("no_speech_probability") > 0.8, F.array_join(F.split("text", " "), "  ")).otherwise(F.col("text"))
    return out.select("vod_id", "pos", "start", "end", text.alias("text"), "avg_logprob", (F.col("no_speech_probability") * 1.15).alias("no_speech_probability"))


@query("clean_transcript", with_views("segments", """SELECT vod_id, pos, text, CASE WHEN removed IS NULL AND rn > 2 THEN 'repeated_whisper_hallucination_removed' ELSE removed END AS removed FROM (
      SELECT *, CASE WHEN removed IS NULL THEN row_number() OVER (PARTITION BY vod_id, removed IS NULL, isl ORDER BY pos) END AS rn FROM runs)""",
    d0="""SELECT s.vod_id, s.pos, trim(regexp_replace(CASE WHEN s.vod_id % 3 = 0 THEN l.text WHEN s.no_speech_probability > 0.8 THEN array_to_string(string_split(s.text, ' '), '  ') ELSE s.text END, '\\s+', ' ', 'g')) AS text,
        s.no_speech_probability * 1.15::DOUBLE AS ns FROM segments s JOIN segments l ON l.vod_id = s.vod_id AND l.pos = s.pos - s.pos % 4""",
    d1=f"SELECT *, {_W.replace('(t)', '(text)')} AS w FROM d0",
    d2="SELECT *, CASE WHEN text = '' THEN 'empty' WHEN ns > 0.92 AND len(w) < 5 THEN 'high_no_speech_segment_removed' END AS removed, array_to_string(w, ' ') AS c FROM d1",
    d3="SELECT *, CASE WHEN removed IS NULL AND lag(c) OVER (PARTITION BY vod_id, removed IS NULL ORDER BY pos) = c THEN 0 ELSE 1 END AS nb FROM d2",
    runs="SELECT *, sum(nb) OVER (PARTITION BY vod_id, removed IS NULL ORDER BY pos) AS isl FROM d3"))
def q_clean(spark, folder):
    return tr.clean_transcript(dirty(spark, folder)).select("vod_id", "pos", "text", "removed")


_WALK = {
    "nx": """SELECT a.vod_id, a.pos, (SELECT min(b.pos) FROM segments b WHERE b.vod_id = a.vod_id AND b.pos >= a.pos AND b."end" - a.start >= 60) + 1 AS nxt FROM segments a""",
    "st": """SELECT * FROM (WITH RECURSIVE w(vod_id, pos) AS (SELECT DISTINCT vod_id, 0::BIGINT FROM segments UNION ALL
        SELECT w.vod_id, n.nxt FROM w JOIN nx n ON n.vod_id = w.vod_id AND n.pos = w.pos WHERE n.nxt IS NOT NULL AND EXISTS (SELECT 1 FROM segments s WHERE s.vod_id = w.vod_id AND s.pos = n.nxt)) SELECT * FROM w)""",
    "nu": "SELECT s.*, sum(CASE WHEN st.pos IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.vod_id ORDER BY s.pos) - 1 AS w0 FROM segments s LEFT JOIN st ON st.vod_id = s.vod_id AND st.pos = s.pos",
    "sp": """SELECT vod_id, w0, min(start) AS a, max("end") AS b, max(w0) OVER (PARTITION BY vod_id) AS lw FROM nu GROUP BY 1, 2""",
    "win": """SELECT n.vod_id, n.pos, n.text, n.start, n."end", CAST(CASE WHEN n.w0 = p.lw AND p.lw > 0 AND p.b - p.a < 30 THEN n.w0 - 1 ELSE n.w0 END AS BIGINT) AS w FROM nu n JOIN sp p ON p.vod_id = n.vod_id AND p.w0 = n.w0""",
}


@query("semantic_windows", with_views("segments", """SELECT vod_id, w, min(start) AS start, max("end") AS "end", md5(string_agg(text, ' ' ORDER BY pos)) AS text_md5 FROM win GROUP BY 1, 2""", **_WALK))
def q_windows(spark, folder):
    t = tr.window_table(tr.semantic_windows(segments(spark, folder)))
    return t.select("vod_id", "w", "start", "end", F.md5("text").alias("text_md5"))


def chunks(spark, folder):
    """Each transcript cut into chunks of 100 s that overlap by 15 s; the second hearing has another log probability."""
    s = segments(spark, folder)
    first = F.floor(F.col("start") / 85).cast("long")
    again = s.where((F.col("start") % 85 < 15) & (F.col("start") >= 85)).select("vod_id", (first - 1).alias("chunk_index"), "start", "end", "text", (F.col("avg_logprob") - 0.05 + F.col("turn") % 2 * 0.1).alias("avg_logprob"))
    return s.select("vod_id", first.alias("chunk_index"), "start", "end", "text", "avg_logprob").unionByName(again)


@query("merge_chunk_transcripts")
def q_merge_chunks(spark, folder):
    return tr.merge_chunk_transcripts(chunks(spark, folder))


def steps(spark, folder):
    windows = tr.cut_lineage(tr.window_table(tr.semantic_windows(segments(spark, folder), target=20.0, minimum=10.0)))
    windows = tr.cut_lineage(windows.join(hash_embedding(windows, ["vod_id", "w"]), ["vod_id", "w"]))
    return tr.window_steps(windows)


@query("window_steps")
def q_steps(spark, folder):
    return steps(spark, folder)


_FLAGS = """SELECT vod_id, pos AS w, start, "end", lag("end") OVER (PARTITION BY vod_id ORDER BY pos) AS prior_end, CASE WHEN pos > 0 THEN (length(text) % 100) / 100.0::DOUBLE END AS similarity,
    CASE WHEN pos > 0 THEN (length(text) % 7) / 40.0::DOUBLE END AS lexical, length(text) % 11 = 0 AS transition FROM segments"""


@query("topic_boundaries", with_views("segments", """SELECT vod_id, w, block, CASE WHEN opened THEN reason END AS boundary_reason FROM auto""", fl=_FLAGS,
    fl2="SELECT *, coalesce(similarity < 0.6 AND lexical < 0.12, false) AS low FROM fl",
    auto="""SELECT * FROM (WITH RECURSIVE a(vod_id, w, bstart, lows, block, opened, reason) AS (
        SELECT vod_id, w, start, 0, 0::BIGINT, true, 'analysis_range_start' FROM fl2 WHERE w = 0 UNION ALL
        SELECT vod_id, w, CASE WHEN cut THEN start ELSE bstart END, CASE WHEN cut THEN 0 ELSE nl END, block + CASE WHEN cut THEN 1 ELSE 0 END, cut,
          CASE WHEN nl >= 2 THEN 'sustained_semantic_shift' WHEN transition THEN 'explicit_transition' ELSE 'maximum_topic_duration' END
        FROM (SELECT f.*, a.bstart, a.block, CASE WHEN f.low THEN a.lows + 1 ELSE 0 END AS nl,
            f.prior_end - a.bstart >= 40 AND (f.transition OR CASE WHEN f.low THEN a.lows + 1 ELSE 0 END >= 2 OR f.prior_end - a.bstart >= 120) AS cut
          FROM a JOIN fl2 f ON f.vod_id = a.vod_id AND f.w = a.w + 1)) SELECT * FROM a)"""))
def q_boundaries(spark, folder):
    from tidemark.operators.chunked import index_chunk, ordered_scan

    s = ordered_scan(segments(spark, folder), ["vod_id"], ["pos"], index_chunk("pos"), lag={"prior_end": F.col("end")})
    later = lambda value: F.when(F.col("pos") > 0, value)
    n = F.length("text")
    flags = s.select("vod_id", F.col("pos").alias("w"), "start", "end", "prior_end", later(n % 100 / 100.0).alias("similarity"), later(n % 7 / 40.0).alias("lexical"), (n % 11 == 0).alias("transition"))
    return tr.topic_boundaries(flags, minimum=40.0, maximum=120.0, low_similarity=0.6).select("vod_id", "w", "block", "boundary_reason")


@query("topic_profile")
def q_topics(spark, folder):
    t = tr.topics(segments(spark, folder), minimum=100.0, maximum=300.0)
    return t.select("vod_id", "block", "start", "end", "boundary_reason", "coherence_score", F.array_join("keywords", "|").alias("keywords"), "summary")


def words(spark, folder):
    docs = table(spark, folder, "documents")
    split = docs.select("doc_id", F.posexplode(tx.plain_words(F.col("text"))).alias("p", "word"))
    return split.select("doc_id", F.col("p").cast("long").alias("pos"), (F.col("p") * 0.3).alias("start"), (F.col("p") * 0.3 + 0.3).alias("end"), "word")


@query("caption_groups", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS l FROM documents),
    u AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS p FROM w),
    x AS (SELECT doc_id, p, length(word) AS n0, length(word) + 1 + lead(length(word), 1) OVER k AS n1, length(word) + 2 + lead(length(word), 1) OVER k + lead(length(word), 2) OVER k AS n2,
      length(word) + 3 + lead(length(word), 1) OVER k + lead(length(word), 2) OVER k + lead(length(word), 3) OVER k AS n3,
      length(word) + 4 + lead(length(word), 1) OVER k + lead(length(word), 2) OVER k + lead(length(word), 3) OVER k + lead(length(word), 4) OVER k AS n4 FROM u WINDOW k AS (PARTITION BY doc_id ORDER BY p)),
    nx AS (SELECT doc_id, p, p + CASE WHEN coalesce(n4, 99) <= 32 THEN 5 WHEN coalesce(n3, 99) <= 32 THEN 4 WHEN coalesce(n2, 99) <= 32 THEN 3 WHEN coalesce(n1, 99) <= 32 THEN 2 ELSE 1 END AS nxt FROM x),
    st AS (SELECT * FROM (WITH RECURSIVE r(doc_id, p, caption) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT FROM u UNION ALL SELECT r.doc_id, n.nxt, r.caption + 1 FROM r JOIN nx n ON n.doc_id = r.doc_id AND n.p = r.p) SELECT * FROM r))
    SELECT s.doc_id, s.caption, min(u.p) * 0.3::DOUBLE AS start, max(u.p) * 0.3::DOUBLE + 0.3::DOUBLE AS "end", string_agg(u.word, ' ' ORDER BY u.p) AS text
    FROM st s JOIN nx n ON n.doc_id = s.doc_id AND n.p = s.p JOIN u ON u.doc_id = s.doc_id AND u.p >= s.p AND u.p < n.nxt GROUP BY 1, 2""")
def q_captions(spark, folder):
    return tr.caption_groups(words(spark, folder), ["doc_id"])
