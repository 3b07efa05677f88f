"""Documents from raw to packed: quality rules, near-duplicates, benchmark passages, personal data, packing.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table
from tidemark.llm.length_buckets import pack
from tidemark.llm.lsh_forest import Forest, near_duplicates
from tidemark.llm.pii_boosting import redact, train
from tidemark.llm.robust_outliers import judged
from tidemark.llm.spaced_seeds import overlaps
from tidemark.llm.token_files import token_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> list[str]:
    """The columns of `documents`, those that exist; extra ones are left out."""
    return [c for c in COLUMNS if c in docs.columns]


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The columns of `docs` with `row`, a unique number that stays, as the table is written."""
    return shared_table(docs.select(*_columns(docs), F.monotonically_increasing_id().alias("row")), name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outlier of their language and source. Null texts have no words and go; null
    languages and sources are groups like others; rows that repeat are judged alike; an empty table gives no rows."""
    columns = _columns(docs)
    return judged(docs, columns, prefix="q_").where("q_kept").select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words per shingle, similarity 0.8 or more. Each row is judged by a number
    of its own, so rows that share a doc_id are no duplicates unless their texts are. Of a group the row with the smallest
    doc_id stays, of equal ones that with the smallest digest of its text; rows without a doc_id come last. Rows without words
    stay; an empty table gives no rows."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    rows = shared_table(docs.select(*_columns(docs), F.monotonically_increasing_id().alias("row"), digest), "near-rows")
    judged_rows = shared_table(near_duplicates(rows, id_column="row", cfg=Forest(words=5)).select("row", "component_id"), "near-judged")
    groups = judged_rows.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    members = judged_rows.join(groups, "component_id").join(rows.select("row", "doc_id", "digest"), "row")  # texts stay where they are
    members = shared_table(members, "near-members")  # only rows that have a partner
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "digest", "row")).alias("first"))
    gone = shared_table(members.join(first.select("component_id", F.col("first.row").alias("stays")), "component_id").where("row != stays").select("row"), "near-gone")
    return rows.join(gone, "row", "left_anti").select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark. Each row is judged by a number of its own, whatever its doc_id."""
    rows = _numbered(docs, "decontamination-rows")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = overlaps(rows, benchmark, id_column="row").select("row").distinct()
    return rows.join(found, "row", "left_anti").select(*_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selected spans replaced in the text; n_chars follows, null for a null text. Rows that repeat are changed alike, other
    columns and empty texts stay as they are; an empty table gives no rows."""
    columns = _columns(docs)
    clean = redact(docs.select(*columns), train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of similar length: doc_id, n_tokens and the columns that packing adds. A null text is an empty one
    and has its end id only; rows that repeat are packed each; an empty table gives no rows."""
    import public_tokenizers

    return pack(token_counts(docs, str(public_tokenizers.path("byte_bpe_50k.json"))), "n_tokens")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The outlier estimate, the boosted trees and the tokenizer can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
