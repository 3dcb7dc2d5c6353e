"""Jobs over an archive: repair, keyword resolution, labels, vectors and export, and what stands beside a payload."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import authors, keywords, text
from millrace.functions.columns import listed, strings
from millrace.operators import counts, merge, vectors
from millrace.plans.facets import Vocabulary
from millrace.plans.labels import Classifier, LexicalClassifier, classify
from millrace.session import ready
from millrace.sources import archive

_LISTS = ("author_keywords", "extracted_keywords", "keywords")
#: Titles of announcements that are no submissions; an archive gives its own.
UPDATES = r"(?i)^\s*\[\s*\w+\s+update\s*\]"


def is_update(title: Column, pattern: str = UPDATES) -> Column:
    """Announcements that are no submissions."""
    return F.coalesce(title, F.lit("")).rlike(pattern)


def conference_label(years: list[int] | None = None) -> Column:
    """The label of topic area or track, in ``years`` only if there are any."""
    label = text.topic_label(F.col("topic_area"), F.col("track"))
    return label if years is None else F.when(F.col("year").isin(*years), label)


def text_repaired(rows: DataFrame) -> DataFrame:
    """Text fields, author names and lists cleaned; empty elements of lists go."""
    rows = rows.withColumns({c: text.normalize_field(F.col(c)) for c in ("title", "abstract", "topic_area", "track") if c in rows.columns})
    lists = [f.name for f in rows.schema if f.dataType.simpleString() == "array<string>"]
    mark = "\u0001"  # all elements of a list in one go; the mark does not occur in text
    whole = lambda c: F.split(text.normalize_field(F.array_join(listed(F.col(c)), mark, "")), mark)
    rows = rows.withColumns({c: F.filter(F.transform(whole(c), lambda v: F.trim(v)), lambda v: v != "") for c in lists})
    return rows.withColumn("authors", authors.normalize_authors(F.col("authors")))


def repaired(rows: DataFrame, label_years: list[int] | None = None, updates: str = UPDATES) -> DataFrame:
    """Announcements left out; fields, author names and keywords cleaned, the three lists of keywords brought in line."""
    rows = text_repaired(rows.where(~is_update(F.col("title"), updates)))
    own = keywords.reconciled(*[F.col(c) for c in (*_LISTS, "title", "abstract", "authors")], conference_label(label_years))
    rows = rows.withColumn("_own", own).withColumns({c: F.col(f"_own.{c}") for c in _LISTS}).drop("_own")
    return rows.withColumn("row_key", text.row_key(F.col("year"), F.col("id"), F.col("poster_number"), F.col("title")))


def labelled(rows: DataFrame, cache: DataFrame, topics: Vocabulary, classifier: Classifier | None = None, limit: int | None = None, refresh: bool = False, save_to: str | None = None) -> DataFrame:
    """``rows`` with topics: from the cache (row_key, assigned_topics), else from the classifier; without the catch-all.

    With ``save_to`` fresh labels are first added to the cache there, so that no later run asks for
    them again, and the rows take their topics from what was written.
    """
    known = topics.active()
    own = classifier or LexicalClassifier(known)
    fresh = classify(rows, cache, own, known, topics.fallback, limit, refresh).where("not failed").select("row_key", "assigned_topics")
    if save_to is not None:
        archive.append_labels(fresh, save_to, type(own).__name__)
        fresh = archive.read_labels(rows.sparkSession, save_to)
    every = cache.select("row_key", "assigned_topics").join(fresh.select("row_key"), "row_key", "left_anti").unionByName(fresh)
    out = merge.with_labels(rows, every)
    return out.withColumn("assigned_topics", merge.without_catch_all(F.col("assigned_topics"), F.lit(""), strings(), topics.catch_all, topics.fallback))


def with_layout(rows: DataFrame) -> DataFrame:
    """x and y of each row from the vectors of its title, abstract and keywords."""
    body = rows.select("row_key", text.embedding_text(F.col("title"), F.col("abstract"), F.col("keywords")).alias("text"))
    points = vectors.layout(vectors.tfidf(body, "row_key"), "row_key")
    return rows.join(points.select("row_key", F.col("x").alias("umap_x"), F.col("y").alias("umap_y")), "row_key", "left")


def statistics(rows: DataFrame) -> dict[str, DataFrame]:
    """Counts that go with a payload; tables in long form."""
    plain = lambda df: df.select([c for c in df.columns if c != "first_ord"])
    areas = rows.where("topic_area <> ''").groupBy("year", F.lower("topic_area").alias("topic_area")).agg(F.count("*").alias("n"), F.min("row_ord").alias("first_ord"))
    return {
        "overall_top": plain(counts.top(counts.keyword_counts(rows, "keywords"), 100)),
        "by_year": plain(counts.ranked(counts.keyword_counts(rows, "keywords", "year"), "year", k=50)),
        "topics_by_year": plain(counts.ranked(areas, "year", k=30)),
        "cooccurrence": plain(counts.top(counts.cooccurrence(rows, "keywords"), 200)),
        "counts_by_year": counts.year_counts(rows),
    }


def serialised(stats: dict[str, DataFrame]) -> DataFrame:
    """(name, json): each row of each table of statistics as JSON, in one table."""
    parts = [df.select(F.lit(name).alias("name"), F.to_json(F.struct(*df.columns)).alias("json")) for name, df in stats.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_order(rows: DataFrame) -> DataFrame:
    """By year, then poster number or title, then id."""
    return rows.orderBy("year", F.coalesce(F.when(F.col("poster_number") != "", F.col("poster_number")), F.lower("title")), "id")


def exported(rows: DataFrame, out: str) -> None:
    """The explorer's table and all statistics below ``out``; shown keywords are those of ``dashboard_keywords``."""
    shown = keywords.dashboard_keywords(*[F.col(c) for c in _LISTS], F.col("title"), conference_label([]))
    archive.write_explorer(rows.withColumn("keywords", shown).orderBy("year", F.lower("title"), "row_ord"), f"{out}/table")
    for name, table in statistics(rows).items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")


def build(
    spark: SparkSession,
    payload: str,
    out: str,
    topics: Vocabulary,
    cache: DataFrame | None = None,
    classifier: Classifier | None = None,
    limit: int | None = None,
    refresh: bool = False,
    cache_path: str | None = None,
    label_years: list[int] | None = None,
) -> DataFrame:
    """Reads a payload, writes rows, points, the explorer's table and statistics below ``out`` and returns the rows.

    Labels come from ``cache`` and from the cache at ``cache_path``, to which fresh ones are added.
    """
    rows = repaired(archive.read_payload(ready(spark), payload), label_years)
    known = cache if cache is not None else spark.createDataFrame([], "row_key string, assigned_topics array<string>")
    if cache_path is not None:
        stored = archive.read_labels(spark, cache_path)
        known = stored.unionByName(known.select("row_key", "assigned_topics").join(stored.select("row_key"), "row_key", "left_anti"))
    rows = with_layout(labelled(rows, known, topics, classifier, limit, refresh, cache_path)).withColumn("author", authors.first_author(F.col("authors")))
    rows.write.mode("overwrite").parquet(f"{out}/rows")
    rows = spark.read.parquet(f"{out}/rows")
    archive.write_embeddings(rows, f"{out}/embeddings", "tf-idf neighbours")
    exported(rows, out)
    return rows


def repair_only(spark: SparkSession, payload: str, out: str, label_years: list[int] | None = None) -> DataFrame:
    """Cleans a payload and writes it again, with the labels and points that stand below ``out`` and without new ones."""
    rows = repaired(archive.read_payload(ready(spark), payload), label_years)
    old = spark.read.parquet(f"{out}/rows").select("row_key", "assigned_topics", "umap_x", "umap_y")
    rows = rows.join(old, "row_key", "left").withColumn("author", authors.first_author(F.col("authors")))
    rows.write.mode("overwrite").parquet(f"{out}/repaired")
    rows = spark.read.parquet(f"{out}/repaired")
    archive.write_payload(rows.select("row_ord", *[x.split()[0] for x in archive.SUBMISSION.split(", ")]), f"{out}/payload", statistics(rows))
    exported(rows, out)
    return rows


def restore(spark: SparkSession, table: str, snapshots: list[str], out: str, only_empty: bool = True) -> DataFrame:
    """Keywords of an exported table from older snapshots of it, written to ``out``; all rows, or empty ones only."""
    rows = spark.read.csv(table, header=True, multiLine=True, escape='"')
    typed = rows.withColumns({"year": F.expr("try_cast(year AS int)"), "keywords": text.split_list(F.col("keywords"))})
    back = merge.restore_keywords(typed, [archive.read_snapshot(spark, s) for s in snapshots], only_empty)
    back = back.select(*[text.join_list(F.col(c)).alias(c) if c == "keywords" else F.col(c) for c in rows.columns])
    back.write.mode("overwrite").csv(out, header=True, escape='"')
    return back


def main() -> None:
    parser = argparse.ArgumentParser(description=build.__doc__)
    parser.add_argument("payload")
    parser.add_argument("out")
    parser.add_argument("--vocabulary", help="JSON file with a list of topics")
    parser.add_argument("--fallback")
    parser.add_argument("--labels", help="folder of the label cache")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--refresh", action="store_true")
    parser.add_argument("--repair-only", action="store_true")
    parser.add_argument("--restore-from", nargs="*", default=[], help="snapshots of the table, to take keywords from; payload is the table")
    parser.add_argument("--all", action="store_true", help="restore rows that have keywords too")
    asked = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    if asked.restore_from:
        restore(spark, asked.payload, asked.restore_from, asked.out, not asked.all)
    elif asked.repair_only:
        repair_only(spark, asked.payload, asked.out)
    else:
        names = [r["topic"] for r in archive.read_vocabulary(spark, asked.vocabulary).orderBy("topic_id").collect()]
        build(spark, asked.payload, asked.out, Vocabulary(tuple(names), asked.fallback), limit=asked.limit, refresh=asked.refresh, cache_path=asked.labels)


if __name__ == "__main__":
    main()
