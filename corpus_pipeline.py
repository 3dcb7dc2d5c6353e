"""Corpus pipeline: quality rules, exact dedup, near-duplicate join, secret redaction, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.best_fit import pack
from millrace.llm.exact_dedup import deduplicate
from millrace.llm.jaccard_join import without_near_duplicates
from millrace.llm.quality_rules import keep_good
from millrace.llm.secret_scan import redact
from millrace.llm.work import Work, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, with all their columns.

    Null, empty and short texts go; long texts are measured whole; null ids and repeated rows are judged like any
    other; an empty table gives an empty one.
    """
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id, repeated rows once.

    All empty and null texts are equal; a null id is larger than any other; an empty table gives an empty one.
    """
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id.

    Documents without an id or without words stay; an id on rows of several texts loses only rows that are
    near a smaller id; an empty table gives an empty one.
    """
    return without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark, and ``n_chars`` of changed ones counted anew.

    Null and empty texts, null ids and repeated rows stay as they are; an empty table gives an empty one.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its sequence and place.

    Null and empty texts are one piece that holds the end mark; long ones are many pieces; null ids and repeated
    rows are packed like any other; an empty table gives an empty result.
    """
    return pack(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("secret_scans", secrets), ("best_fit_packing", packing)]

#: Tokenisation and the near-duplicate join are not expressible; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote for itself, and its input, goes when its output stands.

    Null or empty texts fail the quality rules; null ids and repeated rows pass through like any other
    until exact dedup leaves equal texts once.  An empty table gives an empty result.  Further columns are kept
    until packing, which ignores them.
    """
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch():
            docs = work.keep(stage(spark, docs, sf_dir), name)
        if hasattr(before, "kept_at"):
            work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
