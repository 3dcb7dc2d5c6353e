"""Readers and writers of an archive: payloads, vocabularies, snapshots, pages, PDFs."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean_text, join_list, normalize_field, title_key

SUBMISSION = (
    "id string, year int, title string, authors string, abstract string, author_keywords array<string>, extracted_keywords array<string>, "
    "keywords array<string>, topic_area string, track string, poster_number string, source_url string, submission_type string"
)
#: Columns of the table that the explorer loads, lists joined by " | ".
EXPORT = ("id", "year", "title", "author", "keywords", "assigned_topics", "authors", "abstract", "umap_x", "umap_y", "source_url", "poster_number")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Submissions of a JSON payload, nulls as empty values: one object with ``submissions``, or a folder that ``write_payload`` wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(at).isDirectory():
        return spark.read.schema(f"row_ord int, {SUBMISSION}").json(f"{path}/submissions").na.fill("")
    payload = spark.read.schema(f"submissions array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split() for x in SUBMISSION.split(', ')))}>>").json(path, multiLine=True)
    rows = payload.select(F.posexplode("submissions").alias("row_ord", "s")).select("row_ord", "s.*")
    return rows.na.fill("")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).select(F.posexplode("topics").alias("topic_id", "topic"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(year, id, keywords) of an exported table."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select(F.expr("try_cast(year AS int)").alias("year"), "id", F.filter(F.transform(F.split("keywords", r"\|"), lambda k: F.trim(k)), lambda k: k != "").alias("keywords"))


def read_explorer(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of an exported table; coordinates that are no finite numbers are null."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    number = lambda c: F.expr(f"try_cast(nullif(trim({c}), '') AS double)")
    finite = lambda c: F.when(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), number(c))
    lists = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    return rows.select("id", F.coalesce(F.expr("try_cast(year AS int)"), F.lit(0)).alias("year"), "title", "author", lists("keywords").alias("keywords"), lists("assigned_topics").alias("topics"), "authors", "abstract", finite("umap_x").alias("x"), finite("umap_y").alias("y"), "source_url", "poster_number")


def by_title(rows: DataFrame, title: str = "title", ord: str = "row_ord") -> DataFrame:
    """The last row of each normalised title that is not empty."""
    keyed = rows.withColumn("title_key", title_key(F.col(title))).where("title_key <> ''")
    return keyed.withColumn("_last", F.row_number().over(Window.partitionBy("title_key").orderBy(F.desc(ord)))).where("_last = 1").drop("_last")


def export_columns(rows: DataFrame) -> DataFrame:
    """The explorer's table: all strings, two topics at most."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lists = {"keywords": join_list(F.col("keywords")), "assigned_topics": join_list(F.slice("assigned_topics", 1, 2))}
    return rows.select(*[(lists[c] if c in lists else text(c)).alias(c) for c in EXPORT])


def write_explorer(rows: DataFrame, path: str) -> None:
    export_columns(rows).write.mode("overwrite").csv(path, header=True, escape='"')


def payload_metadata(rows: DataFrame, **more: str) -> DataFrame:
    """One row: when it was made, the years that have keywords, sorted, the number of rows, and constants."""
    with_keywords = F.when(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0, F.col("year"))
    made = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.agg(F.array_sort(F.collect_set(with_keywords)).alias("years"), F.count("*").alias("total_count")).select(made.alias("scraped_at"), "years", "total_count", *[F.lit(v).alias(k) for k, v in more.items()])


def write_payload(rows: DataFrame, path: str, stats: dict[str, DataFrame] | None = None, **metadata: str) -> None:
    """A payload as a folder: a line of JSON for each submission, metadata, and statistics in long form.

    One object for all would be one task's work, so ``read_payload`` reads both forms.
    """
    rows.write.mode("overwrite").json(f"{path}/submissions")
    payload_metadata(rows, **metadata).write.mode("overwrite").json(f"{path}/metadata")
    for name, table in (stats or {}).items():
        table.write.mode("overwrite").json(f"{path}/stats/{name}")


def export_stamp(day: Column | None = None) -> Column:
    """A day as in names of exported files."""
    return F.date_format(F.current_date() if day is None else day, "yyyyMMdd")


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """(title_key, title, track, abstract) of a table of pending rows; of equal titles the last."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').select(*[clean_text(F.col(c)).alias(c) for c in ("title", "track", "abstract")])
    return by_title(rows.withColumn("row_ord", F.monotonically_increasing_id())).drop("row_ord")


# -------------------------------------------------------------- labels and points

CACHE = "row_key string, assigned_topics array<string>, model string, assigned_at timestamp"


def append_labels(fresh: DataFrame, path: str, model: str) -> None:
    """New labels (row_key, assigned_topics) added to a cache, with the model and the time; what stands there stays."""
    fresh.select("row_key", "assigned_topics", F.lit(model).alias("model"), F.current_timestamp().alias("assigned_at")).write.mode("append").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(row_key, assigned_topics) of a cache, the last label of each row; a cache that is not there is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "row_key string, assigned_topics array<string>")
    return spark.read.schema(CACHE).parquet(path).groupBy("row_key").agg(F.max_by("assigned_topics", "assigned_at").alias("assigned_topics"))


def embedding_points(rows: DataFrame) -> DataFrame:
    """(id, x, y, year, title, poster_number) of rows with coordinates, titles repaired."""
    placed = rows.where("umap_x is not null and umap_y is not null")
    return placed.select("id", F.col("umap_x").alias("x"), F.col("umap_y").alias("y"), "year", normalize_field(F.col("title")).alias("title"), "poster_number")


def write_embeddings(rows: DataFrame, path: str, method: str) -> None:
    """Points, and their metadata: number, years and method."""
    points = embedding_points(rows)
    points.write.mode("overwrite").json(f"{path}/points")
    points.agg(F.count("*").alias("count"), F.array_sort(F.collect_set("year")).alias("years")).withColumns({"method": F.lit(method), "generated_at": F.current_timestamp().cast("string")}).write.mode("overwrite").json(f"{path}/metadata")


def repair_embeddings(points: DataFrame) -> DataFrame:
    """Points with repaired titles."""
    return points.withColumn("title", normalize_field(F.col("title")))


# ------------------------------------------------------------------ pages, PDFs


def cache_name(url, suffix: str = ".pdf"):
    return F.concat(F.left(F.sha2(url, 256), F.lit(20)), F.lit(suffix))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Files that are PDFs by their first bytes; others are left out."""
    return spark.read.format("binaryFile").load(path).where(F.substring("content", 1, 4) == F.lit(b"%PDF"))


def get(url: str) -> bytes:
    """What an address answers."""
    with urllib.request.urlopen(url, timeout=45) as answer:
        return answer.read()


def post(url: str, form: dict[str, str]) -> bytes:
    """What an address answers to a form."""
    with urllib.request.urlopen(url, data=urllib.parse.urlencode(form).encode(), timeout=120) as answer:
        return answer.read()


def fetched(urls: DataFrame, read: Callable[[str], bytes | str] | None = None, retries: int = 3, wait: float = 1.5, tasks: int = 8) -> DataFrame:
    """(url, body, error): each URL read in a task, again after growing waits; one that fails keeps its row.

    ``body`` is binary, as it came; ``body_text`` reads it as text.  A null URL is an error of its row.
    """
    read = read or get

    def once(url: str | None) -> tuple[bytes | None, str | None]:
        error = None
        for n in range(1, retries + 1):
            try:
                body = read(url)
                return (body.encode() if isinstance(body, str) else bytes(body)), None
            except Exception as e:  # noqa: BLE001 - the error is a value of the row
                error = str(e)
                if n < retries:
                    time.sleep(wait * n)
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [once(url) for url in frame["url"]]
            yield pd.DataFrame({"url": frame["url"], "body": [a for a, _ in answers], "error": [e for _, e in answers]})

    return urls.select("url").repartition(tasks).mapInPandas(run, "url string, body binary, error string")


def body_text(body: Column) -> Column:
    """A body as text; bytes that are no UTF-8 are replaced."""
    return F.make_valid_utf8(body.cast("string"))


def paper_texts(urls: DataFrame, extract: Callable[[bytes], str], read: Callable[[str], bytes | str] | None = None, known: DataFrame | None = None, **how) -> DataFrame:
    """(url, text): what ``extract`` reads out of each PDF; from ``known`` (url, text) where it stands there.

    Bodies that are no PDF, that can't be fetched or read, give an empty text.
    """
    asked = urls.select("url").where("url <> ''").distinct()
    open_ = asked if known is None else asked.join(known.select("url"), "url", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def own(body: bytes | None) -> str:
            try:
                return extract(bytes(body)).encode("utf-8", "replace").decode() if body is not None and bytes(body[:4]) == b"%PDF" else ""
            except Exception:  # noqa: BLE001 - a paper that can't be read has no text
                return ""

        for frame in frames:
            yield pd.DataFrame({"url": frame["url"], "text": [own(b) for b in frame["body"]]})

    fresh = fetched(open_, read, **how).mapInPandas(run, "url string, text string")
    return fresh if known is None else fresh.unionByName(known.join(asked, "url", "left_semi").select("url", "text"))
