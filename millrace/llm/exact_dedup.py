"""Exact deduplication with counting quotient filters and byte verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.work import BitTable, Work, fresh_name, routed, tidy

#: Rows whose fingerprints one reducer merges, about; each filter sends one message for each reducer.
RANGE_ROWS = 1_000_000
#: Rows of one filter at most, and quotient bits at most.
FILTER_ROWS, MOST_BITS = 2_000_000, 20


class QuotientFilter:
    """A counting quotient filter over 64-bit fingerprints, in its canonical order.

    A fingerprint is a quotient (the top ``q`` bits) and a remainder (the rest).
    Slots hold remainders only, run after run, sorted inside each; ``run`` tells for each
    quotient from ``first`` on how many slots its run has, ``count`` is a counter for each slot.
    As runs are sorted and stored in full, filters of one ``q`` merge without loss.
    """

    def __init__(self, q: int, first: int, run: np.ndarray, remainder: np.ndarray, count: np.ndarray):
        self.q, self.first, self.run, self.remainder, self.count = q, first, run, remainder, count

    @classmethod
    def of(cls, fingerprints: np.ndarray, q: int) -> QuotientFilter:
        value = np.sort(fingerprints.astype(np.uint64, copy=False))
        start = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(value)))
        return cls._from(value[start], count, q, 0, 1 << q)

    @classmethod
    def _from(cls, value: np.ndarray, count: np.ndarray, q: int, first: int, quotients: int) -> QuotientFilter:
        shift = np.uint64(64 - q)
        run = np.bincount((value >> shift).astype(np.int64) - first, minlength=quotients)
        return cls(q, first, run, value & ((np.uint64(1) << shift) - np.uint64(1)), count.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        """Ascending."""
        quotient = np.repeat(np.arange(self.first, self.first + len(self.run), dtype=np.uint64), self.run)
        return (quotient << np.uint64(64 - self.q)) | self.remainder

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both, slot by slot: remainders of ``other`` go to their places in the sorted runs of this, counters of equal ones add up."""
        assert (self.q, self.first, len(self.run)) == (other.q, other.first, len(other.run))
        own, new = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(own, new)
        same = np.zeros(len(new), dtype=bool)
        inside = at < len(own)
        same[inside] = own[at[inside]] == new[inside]
        count = self.count.copy()
        count[at[same]] += other.count[same]
        fresh = ~same
        place = at[fresh] + np.arange(int(fresh.sum()))
        kept = np.ones(len(own) + len(place), dtype=bool)
        kept[place] = False
        value, total = np.empty(len(kept), np.uint64), np.empty(len(kept), np.int64)
        value[kept], total[kept] = own, count
        value[place], total[place] = new[fresh], other.count[fresh]
        return QuotientFilter._from(value, total, self.q, self.first, len(self.run))

    def slices(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        """(range, bytes) for each range of quotients that holds any: run lengths, remainders in as few bytes as they need, counters."""
        width = -(-(64 - self.q) // 8)
        edge = -(-np.arange(ranges + 1) * len(self.run) // ranges)
        slot = np.concatenate(([0], np.cumsum(self.run)))
        for k in range(ranges):
            a, b = slot[edge[k]], slot[edge[k + 1]]
            if a < b:
                run, count = self.run[edge[k] : edge[k + 1]], self.count[a:b]
                run = run.astype("<u2") if run.max() < 1 << 16 else run.astype("<u4")
                count = count.astype("<u1") if count.max() < 1 << 8 else count.astype("<u8")
                head = np.array([self.q, self.first + edge[k], len(run), run.itemsize, b - a, count.itemsize], dtype="<u8")
                remainder = self.remainder[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                yield k, b"".join(x.tobytes() for x in (head, run, remainder, count))

    @classmethod
    def read(cls, data: bytes) -> QuotientFilter:
        q, first, quotients, run_size, slots, count_size = np.frombuffer(data, dtype="<u8", count=6).astype(int).tolist()
        width, at = -(-(64 - q) // 8), 48
        run = np.frombuffer(data, dtype=f"<u{run_size}", count=quotients, offset=at).astype(np.int64)
        at += quotients * run_size
        remainder = np.zeros((slots, 8), dtype=np.uint8)
        remainder[:, :width] = np.frombuffer(data, dtype=np.uint8, count=slots * width, offset=at).reshape(-1, width)
        count = np.frombuffer(data, dtype=f"<u{count_size}", count=slots, offset=at + slots * width).astype(np.int64)
        return cls(q, first, run, remainder.view("<u8").reshape(-1), count)


def _build(q: int, ranges: int, most: int = FILTER_ROWS) -> Callable:
    """One filter for each partition (more only where a partition is larger than ``most`` rows)."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = list(QuotientFilter.of(np.concatenate(held), q).slices(ranges)) if held else []
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
            if sum(map(len, held)) > most:
                yield out(held)
                held = []
        yield out(held)

    return run


def merged(filters: Iterator[QuotientFilter]) -> QuotientFilter:
    """All filters of one range as one; those of like size first, so each slot moves a logarithmic number of times."""
    heap: list[QuotientFilter] = []
    for own in filters:
        while heap and len(heap[-1].count) <= 2 * len(own.count):
            own = heap.pop().merge(own)
        heap.append(own)
    while len(heap) > 1:
        last = heap.pop()
        heap[-1] = heap[-1].merge(last)
    return heap[0]


def _merge(table: pa.Table) -> pa.Table:
    """Fingerprints whose counter is above one after the merge of all filters of a range."""
    whole = merged(QuotientFilter.read(x.as_py()) for x in table.column("slots"))
    often = whole.count > 1
    return pa.table({"fp": whole.fingerprints()[often].view(np.int64), "seen": whole.count[often]})


def normalised(text: F.Column) -> F.Column:
    """Each run of spaces, tabs, line ends, VT and FF becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Each partition counts the fingerprints of its normalised texts in a counting
    quotient filter; filters merge by sorted remainders, a range of quotients
    in each task, as many ranges as rows ask for.  Only texts whose merged counter is above one are moved: they are
    grouped by all their bytes, so fingerprints that collide do not join texts.

    Null text counts as empty, and all empty texts are equal.  A null id is
    larger than any other; in a group of null ids alone keep_id is null and all
    rows are kept.  Rows repeated with one id are rows of one document: each counts in
    group_size and all of those with keep_id are kept (``deduplicate`` leaves one).
    An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Work(spark, "exact")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    # one pass over texts; later joins read the lean table
    lean = work.keep(text.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")), "lean")
    rows = lean.count()
    # as many quotients as a partition has rows, about
    bits = max(4, min(MOST_BITS, (rows // max(1, lean.rdd.getNumPartitions())).bit_length()))
    ranges = max(1, min(1 << bits, -(-rows // RANGE_ROWS)))
    filters = lean.select("fp").mapInArrow(tidy(_build(bits, ranges)), "part int, slots binary")
    often = work.keep(filters.groupBy("part").applyInArrow(_merge, "fp long, seen long"), "often")
    table = BitTable(often, "fp")

    @F.pandas_udf("boolean")
    def may(fp: pd.Series) -> pd.Series:
        return pd.Series(table.has(fp.to_numpy()))

    routed = text.withColumn("fp", F.xxhash64("norm")).where(may("fp"))
    equal = routed.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    equal = work.keep(equal.select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "equal")
    work.drop(often)
    found = lean.join(equal, ["fp", "text_sha256"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one with the smallest id, repeated rows once."""
    work = Work(docs.sparkSession, "dedup")
    verdict = work.keep(exact_duplicates(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"), "verdict")
    # ids whose row goes, or that stand on several rows: only those are looked at again
    asked = verdict.groupBy("doc_id").agg(F.min("kept").alias("all"), F.count("*").alias("rows")).where("not all or rows > 1")
    asked = work.keep(asked.select(F.xxhash64("doc_id").alias("h")), "asked")
    again, rest = routed(docs, F.xxhash64(F.col(id_col).cast("long")), asked, "h")
    own, stay_id, stay_sha = (fresh_name(docs, n) for n in ("own_sha", "stay_id", "stay_sha"))
    again = again.withColumn(own, F.sha2(normalised(F.col(text_col)), 256))
    stay = verdict.where("kept").select(F.col("doc_id").alias(stay_id), F.col("text_sha256").alias(stay_sha))
    stays = F.col(id_col).cast("long").eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_sha))
    return rest.unionByName(again.join(stay, stays, "left_semi").dropDuplicates([id_col, own]).drop(own))
