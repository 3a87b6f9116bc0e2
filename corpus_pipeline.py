"""A training-data pipeline over ``documents``: quality, repeated lines, near copies, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents`` and no others. Null
texts count as empty ones, repeated rows are judged one by one unless a stage
says otherwise, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.bpe import encode_documents
from larkspur.llm.decontam import decontaminate
from larkspur.llm.line_dedup import dedup_lines
from larkspur.llm.quality import keep_quality
from larkspur.llm.set_join import kept_rows, row_key
from larkspur.llm.shared import keep_table, read_table
from larkspur.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines go, and documents of which nothing but blank lines is left by that."""
    kept = dedup_lines(docs.select(COLUMNS)).where("n_removed = 0 or n_removed < n_lines")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that with the smallest id.

    Copies are texts whose five-word shingles have a Jaccard similarity of 0.8
    or more: SimHash finds most of them, each is verified, and the rest is
    completed exactly. Null texts and blank ones are one group. Rows that repeat
    an id are judged by their own text, and where several of a group have its
    smallest id, one row stays. Rows without an id give way to those of their
    group that have one; of a group without any id one row stays.
    """
    kept = kept_rows(near_duplicates(docs, words=5, similarity=0.8)).withColumnsRenamed({"doc_id": "_kept_id", "row_key": "_kept_key"})
    same = docs["doc_id"].eqNullSafe(F.col("_kept_id")) & (row_key(docs["text"]) == F.col("_kept_key"))
    whole = docs.join(kept.hint("shuffle_hash"), same, "left_semi").select(COLUMNS)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    return whole if repeated.isEmpty() else whole.dropDuplicates(["doc_id", "text"])


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded text."""
    made = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]

#: SQL can express neither the classifier nor BPE; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep_table(docs, f"stage-{name}")
    return docs
