"""Queries of this subpackage: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.jaccard_join import jaccard_components

    return jaccard_components(_documents(spark, folder))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_documents(spark, folder))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.license_scan import license_scan

    return license_scan(_documents(spark, folder))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.toxicity import learn, score

    docs = _documents(spark, folder)
    return score(docs, learn(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.url_filter import dated_captures, dated_list, listed_at_fetch

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = listed_at_fetch(dated_captures(pages), dated_list(pages))
    return found.withColumns({c: found[c].cast("string") for c in ("fetched_on", "listed_since")})


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.quality_rules import repetition

    return repetition(_documents(spark, folder))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.byte_pairs import round_trips

    return round_trips(_documents(spark, folder))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.sharding import assign_shards

    return assign_shards(_documents(spark, folder))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.best_fit import pack

    return pack(_documents(spark, folder))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.secret_scan import find_secrets

    return find_secrets(_documents(spark, folder))


def op11_cascading_release(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.quarantine import replay

    return replay(spark.read.parquet(f"{folder}/conversations.parquet"))


def op12_language_model(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.pitman_yor import score

    return score(_documents(spark, folder))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    from millrace.llm.lexical_search import build_index, search

    return search(build_index(_documents(spark, folder)), spark.read.parquet(f"{folder}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from millrace.llm import jaccard_join, lexical_search, license_scan, quality_rules, quarantine, url_filter

    return {
        "op1_ngram_jaccard_join": jaccard_join.oracle(),
        "op6_quality_rules": quality_rules.oracle(),
        "op3_license_scan": license_scan.oracle(),
        "op5_url_filter": url_filter.ORACLE,
        "op11_cascading_release": quarantine.oracle(),
        "op13_lexical_search": lexical_search.ORACLE,
        "op2_exact_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
            SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
            FROM t WINDOW g AS (PARTITION BY norm)
        """,
    }
