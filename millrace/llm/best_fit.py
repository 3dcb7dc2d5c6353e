"""Bulk-synchronous best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.vocabulary import ids_of
from millrace.llm.work import Work, texts_of, tidy

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 1024, 2

#: Pieces and gaps of one range of a sweep, about.
LANE = 65_536
#: Lengths of one band differ by this factor at most; longer bands are placed first.
BAND = 2

_PIECE = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"


def _pieces(capacity: int, end: int) -> Callable:
    """A row for each piece.  The same ids as the tokenizers library's: the rank file holds the same vocabulary, added tokens aside, which ids_of() cuts out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                ids = np.array([*ids_of(text.decode("utf-8", "replace")), end], dtype="<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    for column, value in zip(out, (doc, uid, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
                    uid += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "uid", "piece", "start", "length", "ids_crc32"])

    return run


_SWEPT = pa.schema(
    [(c, pa.int32() if c in ("piece", "range") else pa.int64()) for c in ("doc_id", "uid", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "room", "range", "rank")]
)
_SWEPT_DDL = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in _SWEPT)
_PIECES, _ITEM = _SWEPT.names[:6], _SWEPT.names[:-2]


def _filled(names: list[str]) -> list[F.Column]:
    """The columns of a sweep for rows that have only some of them."""
    return [F.col(f.name) if f.name in names else F.lit(None).cast("int" if f.type == pa.int32() else "long").alias(f.name) for f in _SWEPT]


def _states(sweeps: list[tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """Rows as sweeps left them, in one read: of a sweep some of whose rows met others across ranges, those that did not, and the others from their own table."""
    read = sweeps[0][0].sparkSession.read.schema(_SWEPT_DDL).parquet
    whole = [s.kept_at for s, c in sweeps if c is None] + [c.kept_at for _, c in sweeps if c is not None]
    if served := [s.kept_at for s, c in sweeps if c is not None]:
        return read(*whole).unionByName(read(*served).where("rank is null"))
    return read(*whole)


class Take(NamedTuple):
    """``pieces`` pieces of one run, from ``piece_from`` on, go into gaps of another, from ``gap_from`` on, ``each`` into a gap (the last may get fewer)."""

    piece_run: int
    piece_from: int
    gap_run: int
    gap_from: int
    pieces: int
    each: int

    @property
    def gaps(self) -> int:
        return -(-self.pieces // self.each)


def successors(runs: Iterable[tuple[bool, int, int]]) -> Iterator[Take]:
    """What one sweep places.  ``runs`` are (is a gap, size, count), by size, largest first, gaps before pieces of their size.

    Every piece asks for its successor, the smallest gap before it that no longer piece has got.
    Of the pieces of one length that ask for gaps of one room, each gap gets as many as it holds, by
    rank; the others ask for the next larger gap.  No gap is served twice in a sweep.
    """
    free: list[list[int]] = []  # run, room, first, count; the smallest room is the last
    for run, (gap, size, count) in enumerate(runs):
        if gap:
            free.append([run, size, 0, count])
            continue
        done = 0
        while done < count and free:
            at, room, first, left = free[-1]
            take = Take(run, done, at, first, min(count - done, left * (room // size)), room // size)
            yield take
            done += take.pieces
            free[-1][2:] = first + take.gaps, left - take.gaps
            if not free[-1][3]:
                free.pop()


def _swept(capacity: int) -> Callable:
    """One range of a sweep: pieces that find a gap in it are placed, gaps shrink; what is left is ranked within its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, _SWEPT)
        if not table.num_rows:
            return
        numbers = {c: table.column(c).fill_null(0).to_numpy().copy() for c in ("length", "room", "offset", "sequence_id")}
        gap = table.column("length").is_null().to_numpy()
        size = np.where(gap, numbers["room"], numbers["length"])
        first = np.flatnonzero(np.r_[True, (size[1:] != size[:-1]) | (gap[1:] != gap[:-1])])
        count = np.diff(np.r_[first, len(size)])
        left = np.ones(len(size), dtype=bool)
        for take in successors(zip(gap[first].tolist(), size[first].tolist(), count.tolist(), strict=True)):
            rank = np.arange(take.pieces)
            piece = first[take.piece_run] + take.piece_from + rank
            into = first[take.gap_run] + take.gap_from + rank // take.each
            length = int(size[piece[0]])
            numbers["sequence_id"][piece] = numbers["sequence_id"][into]
            numbers["offset"][piece] = capacity - size[into] + rank % take.each * length
            held = np.bincount(rank // take.each) * length
            numbers["room"][into[:: take.each]] -= held
            left[piece] = left[into] = False
        before = np.cumsum(left) - left
        rank = before - np.repeat(before[first], count)
        columns = {
            "sequence_id": pa.array(numbers["sequence_id"], mask=left & ~gap),
            "offset": pa.array(numbers["offset"], mask=left | gap),
            "room": pa.array(numbers["room"], mask=~gap),
            "range": pa.array(np.full(len(size), TaskContext.get().partitionId(), dtype=np.int32)),
            "rank": pa.array(rank, mask=~left),
        }
        for name, column in columns.items():
            table = table.set_column(_SWEPT.get_field_index(name), _SWEPT.field(name), column)
        yield from table.to_batches(max_chunksize=10_000)

    return run


def _carried(swept: DataFrame, runs: list, takes: list[Take], capacity: int) -> DataFrame:
    """What a sweep left in its ranges, after gaps of one range have met pieces of later ones."""
    names = ("t_range", "t_length", "t_from", "t_pieces", "t_each", "g_range", "g_room", "g_from", "g_gaps", "t_number")
    rows, number = [], 0
    for t in takes:
        (_, length, _, piece_range), (_, room, _, gap_range) = runs[t.piece_run], runs[t.gap_run]
        values = (piece_range, length, t.piece_from, t.pieces, t.each, gap_range, room, t.gap_from, t.gaps, number)
        rows.append(dict(zip(names, values, strict=True)))
        number += t.gaps
    plan = swept.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>")))
    left = swept.where("rank is not null")
    asked = left.where("length is not null").join(
        plan.select("t_range", "t_length", "t_from", "t_pieces", "t_each", "t_number"),
        F.expr("range = t_range and length = t_length and rank >= t_from and rank < t_from + t_pieces"),
        "left",
    )
    asked = asked.withColumns({"_turn": F.expr("(rank - t_from) % t_each"), "_gap": F.coalesce(F.col("t_number") + F.expr("(rank - t_from) div t_each"), -1 - F.col("uid"))})
    given = left.where("length is null").join(
        plan.select("g_range", "g_room", "g_from", "g_gaps", "t_length", "t_pieces", "t_each", "t_number"),
        F.expr("range = g_range and room = g_room and rank >= g_from and rank < g_from + g_gaps"),
        "left",
    )
    turn = F.col("rank") - F.col("g_from")
    held = F.coalesce(F.least("t_each", F.col("t_pieces") - turn * F.col("t_each")) * F.col("t_length"), F.lit(0))
    gaps = given.select(*[F.col(c) for c in _ITEM if c != "room"], (F.col("room") - held).alias("room"))
    found = given.where("t_number is not null").select((F.col("t_number") + turn).alias("_gap"), F.col("sequence_id").alias("_sequence"), (capacity - F.col("room")).alias("_at"))
    pieces = asked.join(found, "_gap", "left").withColumns({"sequence_id": F.col("_sequence"), "offset": F.col("_at") + F.col("_turn") * F.col("length")})
    return pieces.select(*_filled(_ITEM)).unionByName(gaps.select(*_filled(_ITEM)))


def needed(pieces: Counter, gaps: Counter, capacity: int) -> int:
    """Sequences that have to be opened for pieces of some lengths, whatever the packing: never more than needed, and one at least where a piece fits no gap."""
    widest = max(gaps, default=0)
    least = min(pieces)
    volume = sum(n * k for n, k in pieces.items()) - sum(r * k for r, k in gaps.items() if r >= least)
    longer = {n: k for n, k in pieces.items() if n > widest}
    by_count = -(-sum(longer.values()) // (capacity // min(longer))) if longer else 0
    wide = sum(k for n, k in pieces.items() if 2 * n > capacity) - sum(k for r, k in gaps.items() if 2 * r > capacity)
    return max(-(-volume // capacity), by_count, wide, 0)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, lane: int = LANE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    A document is its ids and ``end``.  One of more than ``capacity`` tokens is cut
    into pieces of ``capacity``, the first of which may be shorter; full pieces
    fill a sequence each, with negative numbers.  All other pieces are packed by bulk-synchronous best
    fit, longest first: each sweep takes a further band of lengths.  In a sweep the pieces not yet placed and the gaps that
    hold any of them are sorted by size over ranges of about ``lane`` rows, a frequent size over several;
    each range matches its pieces with their successors (``successors``), counts of what is left by range
    and size tell which gaps of a range meet pieces of later ones, and only these move.  Gaps
    shrink, and what found none sweeps again; sequences are opened when the pieces cannot do without (``needed``).
    Sent to the driver are counts by range and size, at most 1,024 sizes and one more for each range and kind.
    The same stages run at every size, and no task holds more than a range.

    Null text counts as empty: one piece that holds ``end`` alone.  A very long text is many
    pieces.  Null ids and repeated rows are packed like any other row.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Work(spark, "pack")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = work.keep(source.mapInArrow(tidy(_pieces(capacity, end)), _PIECE), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full_pieces = pieces.where(F.col("length") == capacity).select(*columns[:-2], (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    waiting = Counter({r["length"]: r["count"] for r in pieces.where(F.col("length") < capacity).groupBy("length").count().collect()})
    rooms, band, opened, lowest = Counter(), Counter(), 0, capacity
    sweeps: list[tuple[DataFrame, DataFrame | None]] = []
    while waiting or band:
        # what the last sweep left, and the next band
        items = []
        if sweeps:
            last = _states(sweeps[-1:])
            items = [last.where(F.col("length").isNotNull() & F.col("sequence_id").isNull()), last.where(F.col("room") >= lowest)]
        if waiting:
            longest = max(waiting)
            new = Counter({n: k for n, k in waiting.items() if n * BAND > longest})
            waiting, band = waiting - new, band + new
            items.append(pieces.where(F.col("length").between(min(new), longest)).select(*_filled(_PIECES)))
        # gaps wait in the table of their sweep until a piece is as short as they are
        least = min(lowest, min(band))
        if sweeps and least < lowest:
            items.append(_states(sweeps).where((F.col("room") >= least) & (F.col("room") < lowest)))
        if more := needed(band, rooms, capacity):
            new_gaps = spark.range(opened, opened + more).withColumnsRenamed({"id": "sequence_id"}).withColumn("room", F.lit(capacity).cast("long"))
            items.append(new_gaps.select(*_filled(["sequence_id", "room"])))
            opened, rooms[capacity] = opened + more, rooms[capacity] + more
        taking = sum(band.values()) + sum(k for r, k in rooms.items() if r >= least)
        order = [F.coalesce("room", "length").desc(), F.col("length").isNotNull(), F.xxhash64(F.coalesce("uid", "sequence_id"))]
        ranged = reduce(DataFrame.unionByName, items).repartitionByRange(max(1, -(-taking // lane)), *order).sortWithinPartitions(*order)
        swept = work.keep(ranged.mapInArrow(tidy(_swept(capacity)), _SWEPT_DDL), "swept")
        # counts of what is left by range and size, and of the gaps that were served by size
        where = F.when(F.col("rank").isNotNull(), F.col("range")).alias("range")
        found = swept.where("room is not null or rank is not null").groupBy(where, F.col("length").isNull().alias("gap"), F.coalesce("room", "length").alias("size")).count().collect()
        left = sorted((r for r in found if r["range"] is not None), key=lambda r: (r["range"], r["gap"], -r["size"]))
        runs = [(r["gap"], r["size"], r["count"], r["range"]) for r in left]
        takes = list(successors(run[:3] for run in runs))
        rooms, band, lowest = Counter({r: k for r, k in rooms.items() if r < least}), Counter(), least
        for r in found:
            (rooms if r["gap"] else band)[r["size"]] += r["count"]
        for t in takes:
            length, room = runs[t.piece_run][1], runs[t.gap_run][1]
            full, rest = divmod(t.pieces, t.each)
            band[length] -= t.pieces
            rooms[room] -= t.gaps
            rooms[room - t.each * length] += full
            rooms[room - rest * length] += rest > 0
        band, rooms = +band, +rooms
        sweeps.append((swept, work.keep(_carried(swept, runs, takes, capacity), "carried") if takes else None))
    if not sweeps:
        return full_pieces
    placed = _states(sweeps).where(F.col("length").isNotNull() & F.col("sequence_id").isNotNull())
    return full_pieces.unionByName(placed.select(*columns))
