"""Ranks within classes of any size, without gathering a class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.work import Work

#: Rows of a bucket; a class is spread over all buckets.
BUCKET_ROWS = 20_000


def with_ranks(work: Work, rows: DataFrame, by: str, uid: str, name: str = "rank") -> DataFrame:
    """``rows`` (a kept table) with a gapless rank from 0 within each value of ``by``.

    Rows are ranked by ``uid``, unique, within hashed buckets; bucket counts, a
    number for each bucket and class, give where each bucket starts.  They grow with the rows
    and are joined by bucket and class, as the rows already lie, never broadcast.
    """
    buckets = max(32, rows.count() // BUCKET_ROWS)
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(uid), F.lit(buckets)).cast("int"))
    own = F.row_number().over(Window.partitionBy("_bucket", by).orderBy(uid)) - 1
    counts = work.keep(placed.groupBy("_bucket", by).count(), "bucket-counts")
    before = F.sum("count").over(Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_bucket", by, F.coalesce(before, F.lit(0)).alias("_start"))
    ranked = placed.withColumn("_own", own).join(starts.hint("merge"), ["_bucket", by])
    return ranked.withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_bucket", "_own", "_start")
