"""Connected components and fixed-size bit tables, on working tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.tables import Work, scratch

__all__ = ["BitTable", "Work", "components", "fresh_name", "release", "routed", "scratch", "texts_of", "tidy"]


def release() -> None:
    """Give freed memory back to the system: workers stay alive between tasks and would hold what the largest needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which a worker keeps no more memory than before."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return own


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def components(work: Work, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge list; root is the smallest node of its component.

    Alternating large and small stars: each round is two joins against one
    minimum per node, so a node of any degree is split like any skewed join,
    and nothing is gathered per component.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    e = work.keep(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = work.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        work.drop(e, large)
        e = small
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out.kept_at = e.kept_at
    return out


#: Bits of a bit table at most: 16 MB, whatever the size of the corpus.
MOST_BITS = 1 << 27


class BitTable:
    """A set of 64-bit fingerprints in a table of at most ``MOST_BITS`` bits.

    It may say yes wrongly, never no, so it only decides what is worth moving.
    """

    def __init__(self, keys: DataFrame, column: str):
        count = keys.agg(F.approx_count_distinct(column)).first()[0]
        bits = 1 << 16
        while bits < MOST_BITS and bits < 16 * count:
            bits *= 2
        at = F.col(column).bitwiseAND(F.lit(bits - 1))
        spread = keys.select(F.shiftright(at, 16).cast("int").alias("block"), at.bitwiseAND(F.lit(65535)).cast("int").alias("at")).distinct()

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            block = np.zeros(65536, dtype=bool)
            block[pdf["at"].to_numpy()] = True
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(block).tobytes()]})

        table = np.zeros(bits // 8, dtype=np.uint8)
        for row in spread.groupBy("block").applyInPandas(fill, "block int, bits binary").collect():
            table[row.block * 8192 : (row.block + 1) * 8192] = np.frombuffer(row.bits, dtype=np.uint8)
        self.table, self.mask = table, bits - 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.int64, copy=False) & self.mask
        return (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def fresh_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not use."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def routed(docs: DataFrame, key: F.Column, wanted: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose ``key`` may be among ``wanted``, and the rest, which no join needs to move."""
    table = BitTable(wanted, column)

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(table.has(keys.to_numpy()))

    return docs.where(may(key)), docs.where(~may(key))
