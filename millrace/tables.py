"""Working tables in the shared folder of a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ready

_OPEN: list[list[Work]] = []
#: Spark's own setting by which the shuffle files of a query go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Parts for each core, of rows that are much work.
PARTS_A_CORE = 4


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores: a file of narrow rows is few tasks, however much work a row is.

    For rows of few and short columns, as all of them are shuffled once.
    """
    return rows.repartition(PARTS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


class Work:
    """A folder of Parquet tables under ``spark.checkpoint.dir``.

    Writing a table cuts lineage: a lost executor costs the running stage only.
    Where a session on one machine names no checkpoint folder, one is made and set; on a cluster that
    is an error, as other machines could not see it.  Tables that a result reads lazily
    stay until ``scratch`` ends or their owner drops them.
    """

    def __init__(self, spark: SparkSession, name: str):
        ready(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.path, self.n = spark, f"{base.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex[:12]}", 0
        if _OPEN:
            _OPEN[-1].append(self)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        df = df.select(*[F.col(f"`{c}`") for c in df.columns])
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")  # what is written needs its shuffles no more
        try:
            df.write.parquet(at := f"{self.path}/{self.n:03d}-{name}")
        finally:
            self.spark.conf.set(_CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(at)
        kept.kept_at = at
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in kept:
            self._delete(df.kept_at)

    def close(self) -> None:
        """Delete the whole folder."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Working folders made inside are deleted at the end, on failure too; what reads them must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for work in _OPEN.pop():
            work.close()
