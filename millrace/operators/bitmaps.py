"""Facet views from bitmaps: one bit for each row under each year and topic, by buckets of 32,768 rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from millrace.operators.ranks import numbered
from millrace.plans.facets import FacetQuery
from millrace.tables import Work

#: Bytes of a bitmap, as Spark's bitmap functions make them.
BYTES = 4096


@F.pandas_udf(BinaryType())
def _without(a: pd.Series, b: pd.Series) -> pd.Series:
    """The bits of ``a`` that ``b`` lacks, pair by pair."""
    return pd.Series([(np.frombuffer(x, np.uint8) & ~np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b, strict=True)], dtype=object)


class FacetBitmaps:
    """Years and topics of a table as bitmaps, made once and asked often.

    Rows are numbered by ``keys`` in ranges, so a bucket holds neighbours and a value that lies together has few buckets. Every answer is
    one pass over bitmaps, 4 KB for each value and 32,768 rows, and never over the rows; a value that a third of all rows has takes
    no more than any other.

    Null years and null or empty topics are under no year or topic; a topic that a row names twice is one. Repeated rows are rows of their own
    if ``keys`` tell them apart or not. An empty table gives empty answers.
    """

    def __init__(self, rows: DataFrame, keys: list[str], year: str = "year", topics: str = "topics"):
        self.work = Work(rows.sparkSession, "bitmaps")
        self.rows = self.work.keep(numbered(rows.select(*[F.col(c).alias(f"key{k}") for k, c in enumerate(keys)], F.col(year).cast("string").alias("year"), F.col(topics).alias("topics")), [F.asc_nulls_last(f"key{k}") for k in range(len(keys))]), "rows")
        self.keys = keys
        facet = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        own = F.transform(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))), lambda t: facet("topic", t))
        listed = F.concat(F.array(facet("all", F.lit("")), facet("year", F.col("year"))), own)
        each = self.rows.select((F.col("place") + 1).alias("at"), F.explode(listed).alias("f")).where("f.value is not null")
        self.bits = self.work.keep(self._built(each.select("f.kind", "f.value", "at"), "kind", "value"), "bits")

    @staticmethod
    def _built(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))

    def of(self, kind: str) -> DataFrame:
        return self.bits.where(F.col("kind") == kind).select("value", "bucket", "bits")

    def select(self, query: FacetQuery, places: DataFrame | None = None) -> DataFrame:
        """(bucket, bits) of the rows that match ``query``'s years and topics, and are among ``places`` (of a search, say) where these are given."""
        found = self.of("all").select("bucket", "bits")
        if query.years:
            years = self.of("year").where(F.col("value").isin(*map(str, query.years)))
            found = self._met(found, years.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("other")))
        if query.topics:
            named = set(query.topics)
            some = self.of("topic").where(F.col("value").isin(*named)).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("other"), F.count("*").alias("n"))
            every = some.where(F.col("n") == len(named)).drop("n")
            if query.mode == "include":
                found = self._met(found, every)
            else:
                left = found.join(every, "bucket", "left")
                found = left.where("other is not null").select("bucket", _without("bits", "other").alias("bits")).unionByName(left.where("other is null").drop("other"))
        if places is not None:
            found = self._met(found, self._built(places.select((F.col("place") + 1).alias("at"))).withColumnRenamed("bits", "other"))
        return found

    @staticmethod
    def _met(a: DataFrame, b: DataFrame) -> DataFrame:
        """``a`` (one row for each bucket and what its further columns say) with the bits that ``b`` has too, where ``b`` has the bucket; no bitmap goes to Python."""
        named = [c for c in a.columns if c != "bits"]
        by = [*named, *(c for c in b.columns if c not in ("bucket", "other"))]
        each = a.join(b, "bucket").select(*by, F.explode(F.array("bits", "other")).alias("bits"))
        return each.groupBy(*by).agg(F.bitmap_and_agg("bits").alias("bits"))

    def counts(self, selected: DataFrame, kind: str) -> DataFrame:
        """(value, n): selected rows of each year or topic that has any."""
        met = self._met(self.of(kind), selected.withColumnRenamed("bits", "other"))
        return met.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")

    def pivot(self, selected: DataFrame) -> DataFrame:
        """(year, topic, n): selected rows of each year and topic that has any."""
        years = self._met(self.of("year"), selected.withColumnRenamed("bits", "other")).where(F.bitmap_count("bits") > 0)
        met = self._met(years.withColumnRenamed("value", "year"), self.of("topic").withColumnsRenamed({"value": "topic", "bits": "other"}))
        return met.groupBy(F.col("year").cast("int").alias("year"), "topic").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")

    @staticmethod
    def size(selected: DataFrame) -> Column:
        """An aggregate: how many rows are selected."""
        return F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long")

    def selected_rows(self, selected: DataFrame) -> DataFrame:
        """The keys and years of selected rows."""

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, bits in zip(batch.column("bucket").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little"))
                    yield pa.RecordBatch.from_arrays([pa.array((bucket - 1) * 8 * BYTES + at)], ["place"])

        found = selected.mapInArrow(places, "place long")
        return self.rows.join(found, "place", "left_semi").select(*[F.col(f"key{k}").alias(c) for k, c in enumerate(self.keys)], F.col("year").cast("int").alias("year"))
