"""Registered queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WORDS = r"'[^\x20\x09-\x0D]+'"


@register(
    "op5_substring_dedup",
    rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
    win AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
    low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM win JOIN low USING (g) WHERE doc_id > m),
    cut AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
        sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
            ELSE coalesce((SELECT string_agg(x.word, ' ' ORDER BY x.p) FROM (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p) x WHERE NOT list_contains(ps, x.p)), '') END) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id)
    """,
)
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import repeated_passages

    rows = repeated_passages(_table(spark, folder, "documents"))
    kept = F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).when(F.col("kept").isNotNull(), F.sha2(F.col("kept").cast("binary"), 256)).otherwise(F.lower(F.hex("digest")))
    return rows.select(F.col("id").alias("doc_id"), "n_words", F.col("removed").alias("n_removed"), kept.alias("kept_sha256"))


@register(
    "op8_minhash_near_dedup",
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(w[p : p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM d WHERE len(w) >= 4)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
    edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach(node, low) AS (SELECT x, x FROM edge UNION SELECT e.y, r.low FROM reach r JOIN edge e ON e.x = r.node WHERE r.low < e.y)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(low) AS low FROM reach GROUP BY node) c USING (doc_id)
    """,
)
def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.lsh_forest import near_duplicates

    return near_duplicates(_table(spark, folder, "documents"))


@register("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.compression_quality import score, train

    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    scored = score(docs, train(docs, labels, usable=fold != 2))
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op2_personal_data")
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.pii_boosting import detect, train

    docs = _table(spark, folder, "documents")
    return detect(docs, train(docs))


@register("op3_decontamination")
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.spaced_seeds import overlaps

    return overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@register("op4_sharding")
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.interleave import interleaved_shards

    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    rows = _table(spark, folder, "documents").select("doc_id", "source", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    sharded = interleaved_shards(rows, 24)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.robust_outliers import judged

    return judged(_table(spark, folder, "documents"), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@register(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    last AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
    FROM p LEFT JOIN last USING (payload_digest)
    """,
)
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.common import shared_path
    from tidemark.llm.warc_zstd import read_archives, write_archives

    files = write_archives(_table(spark, folder, "pages"), shared_path(spark, "warc"))
    return read_archives(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@register("op9_token_files")
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.common import shared_path
    from tidemark.llm.token_files import read_tokens, write_tokens

    manifest = write_tokens(_table(spark, folder, "documents"), shared_path(spark, "tokens"), _tokenizer())
    return read_tokens(spark, manifest).withColumnRenamed("id", "doc_id")


@register("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.length_buckets import pack
    from tidemark.llm.token_files import token_counts

    return pack(token_counts(_table(spark, folder, "documents"), _tokenizer()), "n_tokens")


def _merkle_sql(levels: int = 5, tops: int = 3, fan: int = 16) -> str:
    """Levels written out: 16^5 leaves a source, 16^3 sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    row = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    parts = [
        f"l AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree, {row('text')} AS leaf, CASE WHEN ({crc}) % 5 = 0 THEN {row(low)} ELSE {row('text')} END AS shown FROM documents)",
        "a AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM l)",
        "v0 AS (SELECT tree, r, count(*) OVER (PARTITION BY tree) AS c, leaf AS d FROM a)",
    ]

    def climb(v: str, k: int) -> list[str]:
        run = f"PARTITION BY tree, r // {fan} ORDER BY r ROWS BETWEEN"
        return [
            f"w{v}{k} AS (SELECT *, CASE WHEN c = 1 THEN '' ELSE coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lo, CASE WHEN c = 1 THEN '' ELSE coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS hi FROM {v}{k})",
            f"{v}{k + 1} AS (SELECT tree, r // {fan} AS r, (any_value(c) + {fan - 1}) // {fan} AS c, CASE WHEN any_value(c) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY r)) END AS d FROM {v}{k} GROUP BY tree, r // {fan})",
        ]

    def fold(before: str, v: str, k: int, place: str, tree: str) -> str:
        return (
            f"SELECT f.* EXCLUDE (proof, got), proof || lo || hi AS proof, CASE WHEN c = 1 THEN got ELSE sha256(lo || got || hi) END AS got FROM {before} f JOIN w{v}{k} w ON w.tree = {tree} AND w.r = f.{place} // {fan**k}"
        )

    for k in range(levels):
        parts += climb("v", k)
    parts += [f"t AS (SELECT tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS top FROM v{levels})", "u0 AS (SELECT '' AS tree, top AS r, count(*) OVER () AS c, d FROM t)"]
    for k in range(tops):
        parts += climb("u", k)
    parts.append("f0 AS (SELECT doc_id, a.tree, r, leaf, t.d AS subroot, top, '' AS proof, shown AS got FROM a JOIN t ON a.tree = t.name)")
    for k in range(levels):
        parts.append(f"f{k + 1} AS ({fold(f'f{k}', 'v', k, 'r', 'f.tree')})")
    for k in range(tops):
        parts.append(f"f{levels + k + 1} AS ({fold(f'f{levels + k}', 'u', k, 'top', chr(39) * 2)})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, u.d AS root, sha256(proof) AS proof_sha256, got AS folded_root, got = u.d AS verified FROM f{levels + tops}, u{tops} u"


@register("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.merkle_witness import LOWER, UPPER, folded, proof_digest, row_digest, witnesses

    docs = _table(spark, folder, "documents")
    of = lambda text: row_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), F.when(tampered, of(F.translate("text", UPPER, LOWER))).alias("tampered"))
    shown = witnesses(leaves, "source", "doc_id", carried=["tampered"])
    got = shown.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("witness")))
    return got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("witness")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@register(
    "op11_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    ok AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
    link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95),
    edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
    reach(node, low) AS (SELECT x, x FROM edge UNION SELECT e.y, r.low FROM reach r JOIN edge e ON e.x = r.node WHERE r.low < e.y),
    comp AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
    n AS (SELECT x, count(*) AS n FROM edge GROUP BY x)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
    FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN comp ON comp.node = vec_id
    """,
)
def op11_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.rotation_codes import similar_vectors

    return similar_vectors(_table(spark, folder, "embeddings"))


_PIECES = r"'[.,;:!?\x0A-\x0D]'"


def _phrase_sql(least: int = 30, top: int = 2000) -> str:
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, {_PIECES})), '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, size, w[p : p + size - 1] AS g FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)),
    c AS (SELECT lang, size, g, count(*) AS a FROM g GROUP BY ALL),
    total AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE size = 1 GROUP BY lang),
    big AS (SELECT * FROM c WHERE size > 1 AND a >= {least}),
    cut AS (SELECT b.lang, b.size, b.g, b.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * b.a) // (x.a + y.a) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM big) b JOIN c x ON x.lang = b.lang AND x.g = b.g[1:k] JOIN c y ON y.lang = b.lang AND y.g = b.g[k + 1 : b.size]),
    low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    inside AS (SELECT lang, g[p : p + m - 1] AS g, max(a) AS longer FROM (SELECT lang, g, a, m, unnest(range(1, size - m + 2)) AS p FROM (SELECT *, unnest(range(2, size)) AS m FROM big)) GROUP BY ALL),
    kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a),
    named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, score::BIGINT AS score FROM kept)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named JOIN total USING (lang)
    QUALIFY rank <= {top}
    """


@register("op12_collocations", _phrase_sql())
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.phrase_trie import collocations

    return collocations(_table(spark, folder, "documents"))
