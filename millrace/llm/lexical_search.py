"""Ranked lexical search: a hierarchical max tree over ranges of documents for each term, searched best first.

The index is one row for each range of documents (a chunk), written where the documents were read, so
nothing is shuffled to build it.  A search reads it three times: for document frequencies of the terms asked for,
for a floor under each item's k-th score, and for the answers.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.work import Work, texts_of, tidy

#: Documents of a leaf and children of a node; documents and bytes of text of a chunk at most (a longer text is a chunk of its own).
FAN, CHUNK_DOCS, CHUNK_BYTES = 16, 4096, 16 << 20
#: Items, and terms of items, that one search sends to tasks, about; more are searched in blocks.
BLOCK_ITEMS, BLOCK_TERMS = 1000, 200_000
#: Bytes of a text whose words are split at one time.
SLICE = 1 << 20

#: Bytes outside terms become spaces, A-Z become a-z: a byte above 0x7F always belongs to a term.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

_INDEX = "chunk long, ids array<long>, sizes binary, terms binary, counts binary, places binary, tfs binary"


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text."""
    found: Counter = Counter()
    data = text.translate(_TERM)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + SLICE)
        stop = len(data) if stop < 0 else stop
        found.update(data[at:stop].split())
        at = stop
    return found


class _Builder:
    """Postings of the documents of one chunk, by term."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.number: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc: int | None, text: bytes) -> None:
        found, number = term_counts(text), self.number
        self.terms.append(np.fromiter((number.setdefault(t, len(number)) for t in found), dtype=np.int64, count=len(found)))
        tf = np.fromiter(found.values(), dtype=np.int64, count=len(found))
        self.tfs.append(tf)
        self.ids.append(doc)
        self.sizes.append(int(tf.sum()))
        self.bytes += len(text)

    def row(self, chunk: int) -> list:
        none = np.zeros(0, np.int64)
        terms, tfs = np.concatenate([none, *self.terms]), np.concatenate([none, *self.tfs])
        places = np.repeat(np.arange(len(self.ids), dtype=np.uint16), [len(t) for t in self.terms])
        order = np.argsort(terms, kind="stable")
        counts = np.bincount(terms, minlength=len(self.number)).astype("<i4")
        return [chunk, self.ids, np.array(self.sizes, "<i8").tobytes(), b" ".join(self.number), counts.tobytes(), places[order].astype("<u2").tobytes(), tfs[order].astype("<i8" if self.bytes >> 31 else "<i4").tobytes()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, made = TaskContext.get().partitionId() << 32, _Builder()
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
    names = [f.split()[0] for f in _INDEX.split(", ")]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made.row(chunk), kinds, strict=True)], names)

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
            if made.ids and (len(made.ids) == CHUNK_DOCS or made.bytes + len(text) > CHUNK_BYTES):
                yield out()
                chunk, made = chunk + 1, _Builder()
            made.add(doc, text)
    if made.ids:
        yield out()


@dataclass
class Index:
    """Chunks of postings (a working table), the number of documents with a term, and of all their terms."""

    chunks: DataFrame
    documents: int
    length: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of all terms of every row of ``docs``; every text is read once and nothing is shuffled.

    Null and empty texts have no term and are found by nothing.  Repeated rows are documents of their own.  A very long
    text is split into words in slices and is a chunk of its own.  An empty table gives an empty index.  Other columns are ignored.
    """
    work = Work(docs.sparkSession, "lexical")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = work.keep(source.mapInArrow(tidy(_chunks), _INDEX), "index")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.frombuffer(s, "<i8") for s in batch.column("sizes").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int((s > 0).sum()) for s in sizes], pa.int64()), pa.array([int(s.sum()) for s in sizes], pa.int64())], ["documents", "length"])

    found = chunks.select("sizes").mapInArrow(totals, "documents long, length long").agg(F.sum("documents"), F.sum("length")).first()
    return Index(chunks, found[0] or 0, found[1] or 0)


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each posting adds to a score, in 64-bit integers."""
    if 90 * documents * int(n.max(initial=0)) < 1 << 63:
        m = 10 + 90 * n * documents // max(length, 1)
    else:
        m = np.array([10 + 90 * int(x) * documents // max(length, 1) for x in n], dtype=np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Tree:
    """Postings of one chunk for the terms asked for, and for each term the highest impact in each range of its documents.

    ``levels[0]`` has a column for every ``FAN`` documents, each further level one for ``FAN`` of the
    level below, the last one for the whole chunk.  ``least`` holds the smallest id in each range (null ids come last).
    """

    def __init__(self, row: dict, number: dict[bytes, int], weights: np.ndarray, documents: int, length: int):
        self.ids = row["ids"]
        counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        own = [number.get(t, -1) for t in row["terms"].split(b" ")] if len(counts) else []
        term = np.repeat(np.array(own, dtype=np.int64), counts)
        hit = np.flatnonzero(term >= 0)
        place = np.frombuffer(row["places"], "<u2")[hit].astype(np.int64)
        wide = len(row["tfs"]) == 8 * len(term)
        tf = np.frombuffer(row["tfs"], "<i8" if wide else "<i4")[hit].astype(np.int64)
        term = term[hit]
        value = impacts(tf, np.frombuffer(row["sizes"], "<i8")[place], weights[term], documents, length)
        by_doc = np.argsort(place, kind="stable")
        self.place, self.term, self.value = place[by_doc], term[by_doc], value[by_doc]
        groups = -(-len(self.ids) // FAN)
        self.starts = np.searchsorted(self.place, np.arange(groups + 1) * FAN)
        present, at = np.unique(term, return_inverse=True)
        self.row_of = np.full(len(number), -1, dtype=np.int64)
        self.row_of[present] = np.arange(len(present))
        level = np.zeros((len(present), groups), dtype=np.int64)
        np.maximum.at(level, (at, place // FAN), value)
        keys = np.array([(1 << 64) - 1 if i is None else i + (1 << 63) for i in self.ids], dtype=np.uint64)
        least = np.minimum.reduceat(keys, np.arange(0, len(keys), FAN))
        self.levels, self.least = [level], [least]
        while level.shape[1] > 1:
            edge = np.arange(0, level.shape[1], FAN)
            level, least = np.maximum.reduceat(level, edge, axis=1), np.minimum.reduceat(least, edge)
            self.levels.append(level)
            self.least.append(least)

    def search(self, terms: np.ndarray, best: Best, greedy: bool) -> None:
        """Puts documents of this chunk into ``best``, opening the node with the highest summed bound first.

        A node goes unopened only where its bound is below the k-th score, or equal to it with no
        id that would come before the k-th.  ``greedy`` ends as soon as there are k documents.
        """
        rows = self.row_of[terms]
        rows = rows[rows >= 0]
        if not len(rows):
            return
        wanted = np.zeros(len(self.row_of), dtype=bool)
        wanted[terms] = True
        top = len(self.levels) - 1
        heap = [(-int(self.levels[top][rows, 0].sum()), top, 0)]
        while heap:
            bound, level, node = heapq.heappop(heap)
            if best.excludes(-bound):
                return
            if best.excludes(-bound, int(self.least[level][node])):
                continue
            if level:
                lo = node * FAN
                bounds = self.levels[level - 1][rows, lo : lo + FAN].sum(axis=0)
                for k in np.flatnonzero(bounds):
                    heapq.heappush(heap, (-int(bounds[k]), level - 1, lo + int(k)))
                continue
            part = slice(self.starts[node], self.starts[node + 1])
            mine = wanted[self.term[part]]
            score = np.zeros(FAN, dtype=np.int64)
            np.add.at(score, self.place[part][mine] - node * FAN, self.value[part][mine])
            for k in np.flatnonzero(score):
                best.add(int(score[k]), self.ids[node * FAN + int(k)])
            if greedy and best.full():
                return


class Best:
    """The k documents that rank highest so far, above a floor (score, key of an id) that others already reach."""

    def __init__(self, k: int, floor: tuple[int, int] | None = None):
        self.k, self.floor = k, floor
        self.heap: list[tuple[int, int, int | None]] = []

    def full(self) -> bool:
        return len(self.heap) == self.k

    def _worst(self) -> tuple[int, int] | None:
        own = (self.heap[0][0], -self.heap[0][1]) if self.full() else None
        return min((x for x in (own, self.floor) if x), key=lambda x: (-x[0], x[1]), default=None)

    def excludes(self, bound: int, least: int = 0) -> bool:
        """Whether nothing with at most this score and no key below ``least`` can rank before what is there."""
        worst = self._worst()
        return bound <= 0 or bool(worst) and (bound < worst[0] or bound == worst[0] and least > worst[1])

    def add(self, score: int, doc: int | None) -> None:
        key = (1 << 64) if doc is None else doc + (1 << 63)
        if not self.full():
            heapq.heappush(self.heap, (score, -key, doc))
        elif (score, -key) > self.heap[0][:2]:
            heapq.heapreplace(self.heap, (score, -key, doc))


def _searched(items: list[tuple], number: dict[bytes, int], weights: np.ndarray, index: Index, k: int, floors: dict, greedy: bool) -> Callable:
    asked = [(item, np.array(sorted(number[t] for t in terms), dtype=np.int64)) for item, terms in items]
    documents, length = index.documents, index.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, floors.get(item)) for item, _ in asked]
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row, number, weights, documents, length)
                for (_, terms), own in zip(asked, best, strict=True):
                    tree.search(terms, Best(k) if greedy and own.full() else own, greedy)
        rows = [(item, score, doc) for (item, _), own in zip(asked, best, strict=True) for score, _, doc in own.heap]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "score", "doc_id"])

    return run


def _frequencies(number: dict[bytes, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                for term, count in zip(terms.split(b" "), np.frombuffer(counts, "<i4"), strict=False):
                    if (at := number.get(term)) is not None:
                        found[at] += count
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["term", "df"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(item, t) for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch, "text"), strict=True) for t in term_counts(text)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The first k rows of each item, with their rank; each task sends k rows an item at most."""
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return candidates.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for every item, equal scores by ascending id.

    Items are searched in blocks of about ``BLOCK_ITEMS``; a block's terms are what tasks are sent.  Each
    task searches its chunks best first: once until k documents stand for each item, which gives a floor under the k-th score of
    all, and once exactly, opening no range whose summed bounds lie below the floor or its own k-th score.

    Null and empty items, and those of no term, have no row; the texts of rows with one item id are one item, a null id is one of its own.  A
    document without an id ranks after all of its score; documents of one id and score have ranks of their own.
    Empty tables give an empty result.  Other columns are ignored.
    """
    work = Work(items.sparkSession, "search")
    source = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    terms = work.keep(source.mapInArrow(tidy(_terms), "item_id long, term binary").distinct(), "terms")
    size = terms.agg(F.count("*"), F.approx_count_distinct(F.coalesce("item_id", F.lit(-1)))).first()
    blocks = max(1, -(-size[1] // BLOCK_ITEMS), -(-size[0] // BLOCK_TERMS))
    out = None
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()
        asked = [(r.item_id, [bytes(t) for t in r.terms]) for r in rows]
        number = {t: at for at, t in enumerate(sorted({t for _, own in asked for t in own}))}
        df = np.zeros(len(number), dtype=np.int64)
        for row in index.chunks.select("terms", "counts").mapInArrow(tidy(_frequencies(number)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[row.term] = row.df
        weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        schema = "item_id long, score long, doc_id long"
        first = index.chunks.mapInArrow(tidy(_searched(asked, number, weights, index, k, {}, True)), schema)
        floors = {r.item_id: (r.score, (1 << 64) if r.doc_id is None else r.doc_id + (1 << 63)) for r in ranked(first, k).where(F.col("rank") == k).collect()}
        found = ranked(index.chunks.mapInArrow(tidy(_searched(asked, number, weights, index, k, floors, False)), schema), k)
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", "rank", "doc_id", "score")


#: The same as SQL, every document scored; for item ids that are unique.
ORACLE = r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
    total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d),
    tf AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(w) AS term FROM d) GROUP BY uid, term),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
    score AS (
        SELECT q.item_id, uid, CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n_docs) // length)))) AS BIGINT) AS score
        FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN d USING (uid), total GROUP BY q.item_id, uid),
    place AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM score JOIN d USING (uid) WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM place WHERE rank <= 10
"""
