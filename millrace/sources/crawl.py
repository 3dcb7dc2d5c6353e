"""Fetching many addresses: hosts apart, at a rate, in waves that are kept, so that a job that was lost goes on where it was."""

from __future__ import annotations

import heapq
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranks import numbered
from millrace.session import ready
from millrace.sources.archive import get

#: Connections to one host at a time, seconds between requests of one connection, addresses of a wave, about.
LANES, PAUSE, WAVE = 2, 0.5, 20_000
PAGES, BODIES = "url string, host string, digest string, error string, tries int", "digest string, body binary"


def host_of(url: Column) -> Column:
    """The host of an address, in small letters; empty where it has none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def lane_of(url: Column, lanes: int = LANES) -> Column:
    """Which of its host's connections an address goes through."""
    return F.pmod(F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long"), F.lit(lanes)).cast("int")


def planned(urls: DataFrame, lanes: int = LANES, pause: float = PAUSE) -> DataFrame:
    """(url, host, lane, turn, due) of each address once: when its connection may ask for it, at the earliest, if all begin at 0.

    A host's addresses are dealt to its lanes by a hash; in a lane they go by address.  Null and empty addresses are left out.
    """
    asked = urls.select("url").where("url <> ''").distinct().select("url", host_of(F.col("url")).alias("host"), lane_of(F.col("url"), lanes).alias("lane"))
    placed = numbered(asked, [F.col(c) for c in ("host", "lane", "url")])
    first = placed.groupBy("host", "lane").agg(F.min("place").alias("first"))
    turn = F.col("place") - F.col("first")
    return placed.join(first, ["host", "lane"]).select("url", "host", "lane", turn.alias("turn"), (turn * pause).alias("due"))


def _asking(read: Callable[[str], bytes | str], retries: int, wait: float, pause: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Addresses of several lanes in one task: the lane whose turn is next is asked; one that fails waits, the others go on."""
        lanes: dict[tuple, deque] = {}
        for frame in frames:
            for url, host, lane in zip(frame["url"], frame["host"], frame["lane"], strict=True):
                lanes.setdefault((host, lane), deque()).append((url, 1))
        began = time.monotonic()
        due = [(0.0, key) for key in sorted(lanes)]
        heapq.heapify(due)
        while due:
            at, key = heapq.heappop(due)
            url, n = lanes[key].popleft()
            time.sleep(max(0.0, began + at - time.monotonic()))
            try:
                body, error = read(url), None
                body = body.encode() if isinstance(body, str) else bytes(body)
            except Exception as e:  # noqa: BLE001 - the error is a value of the row
                body, error = None, f"{type(e).__name__}: {e}"
            again = error is not None and n < retries
            if again:
                lanes[key].append((url, n + 1))
            if lanes[key]:
                heapq.heappush(due, (time.monotonic() - began + pause + (wait * n if again else 0.0), key))
            if not again:
                yield pd.DataFrame({"url": [url], "host": [key[0]], "body": [body], "error": [error], "tries": [n]})

    return run


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All waves below ``path`` that were written to their end; none gives an empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [f.getPath().getParent().toString() for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")) or []]
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(url, host, digest, error, tries): the last known answer of each address; an answer stands before an error."""
    rows = _kept(spark, f"{store}/pages", PAGES)
    best = F.max_by(F.struct("host", "digest", "error", "tries"), F.struct(F.col("digest").isNotNull(), "tries", "digest"))
    return rows.groupBy("url").agg(best.alias("x")).select("url", "x.host", "x.digest", "x.error", "x.tries")


def bodies(spark: SparkSession, store: str) -> DataFrame:
    """(digest, body): each body once, by its SHA-256."""
    return _kept(spark, f"{store}/bodies", BODIES).dropDuplicates(["digest"])


def crawl(urls: DataFrame, store: str, read: Callable[[str], bytes | str] | None = None, retries: int = 3, wait: float = 1.5, lanes: int = LANES, pause: float = PAUSE, wave: int = WAVE, tasks: int | None = None) -> DataFrame:
    """Asks for what ``store`` has no answer to, and gives ``stored`` of all addresses asked for.

    Addresses go in waves by a hash.  In a wave the lanes of hosts are dealt to tasks, each lane to one, so a host is never asked more often than its
    lanes and pause allow, however many addresses it has; a task goes on with other hosts while one waits or fails.  A wave is
    written to its end or not at all: bodies first, by their digest and only those that are new, then the pages.  A job that starts anew asks only for what no finished wave has answered; addresses that
    failed are asked again.  ``tasks``: partitions of a wave, by default those of a shuffle.

    Null and empty addresses are left out; repeated ones are asked for once.  An empty table gives an empty result.
    """
    spark = ready(urls.sparkSession)
    asked = urls.select("url").where("url <> ''").distinct()
    answered = lambda: stored(spark, store).where("digest is not null").select("url")
    waves = max(1, -(-asked.join(answered(), "url", "left_anti").count() // wave))
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in range(waves):
        own = asked.where(F.pmod(F.xxhash64("url"), F.lit(waves)) == n).join(answered(), "url", "left_anti")
        laned = own.select("url", host_of(F.col("url")).alias("host"), lane_of(F.col("url"), lanes).alias("lane"))
        dealt = laned.repartition(tasks, "host", "lane").sortWithinPartitions("host", "lane", "url")
        name = f"{n:06d}-{uuid.uuid4().hex}"
        answers = dealt.mapInPandas(_asking(read or get, retries, wait, pause), "url string, host string, body binary, error string, tries int")
        answers.write.parquet(f"{store}/answers/{name}")  # asked for once, read twice
        kept = spark.read.parquet(f"{store}/answers/{name}").withColumn("digest", F.when(F.col("body").isNotNull(), F.sha2("body", 256)))
        fresh = kept.where("digest is not null").select("digest", "body").dropDuplicates(["digest"]).join(bodies(spark, store).select("digest"), "digest", "left_anti")
        fresh.write.parquet(f"{store}/bodies/{name}")
        kept.select("url", "host", "digest", "error", "tries").write.parquet(f"{store}/pages/{name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/answers/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return stored(spark, store).join(asked, "url", "left_semi")
