"""Substring search of many needles at once: in one pass over the texts, or by posting lists of trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import normalize_search
from millrace.tables import Work

#: Rows of a block, and the rarest trigrams of a needle whose lists are read; what the others would rule out, the check of hits does.
BLOCK, RAREST = 4096, 4
#: Blocks that a scan is told by number.
MOST_BLOCKS = 1000
#: Characters of a trigram: of letters, digits and space.
SIZE = 37
#: Characters of a text that are looked through at one time.
SLICE = 1 << 20
#: Characters of searches that are looked for in one pass, about, and passes over the texts; more searches are looked up in an index.
ONE_PASS, MOST_PASSES = 2_000_000, 8
#: Hits of a batch that leaves a task, about.
HITS = 1 << 16

_CODE = np.full(256, 0, dtype=np.int64)
_CODE[ord("0") : ord("9") + 1] = np.arange(1, 11)
_CODE[ord("a") : ord("z") + 1] = np.arange(11, 37)


def trigrams(text: str) -> np.ndarray:
    """Numbers of the distinct trigrams of a folded text (small letters, digits and single spaces), ascending."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    found = np.zeros(0, np.int64)
    for lo in range(0, max(len(data) - 2, 0), SLICE):
        code = _CODE[data[lo : lo + SLICE + 2]]
        found = np.union1d(found, (code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:])
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 32
    for batch in batches:
        place = np.arange(at, at + batch.num_rows)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(place // BLOCK), pa.array((place % BLOCK).astype(np.int32)), *batch.columns], ["block", "place", *batch.schema.names])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A list of places for each trigram of each block; rows of a block that lie in several batches give several lists."""
    for batch in batches:
        block, place = (batch.column(c).to_numpy() for c in ("block", "place"))
        for own in np.unique(block):
            rows = np.flatnonzero(block == own)
            found = [trigrams(t or "") for t in batch.column("search_text").take(pa.array(rows)).to_pylist()]
            where = np.repeat(place[rows], [len(f) for f in found]).astype("<u2")
            code = np.concatenate([np.zeros(0, np.int64), *found])
            order = np.argsort(code, kind="stable")
            codes, starts = np.unique(code[order], return_index=True)
            lists = np.split(where[order], starts[1:]) if len(codes) else []
            columns = [pa.array(codes.astype(np.int32)), pa.array(np.full(len(codes), own)), pa.array([len(x) for x in lists], pa.int32()), pa.array([x.tobytes() for x in lists], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["trigram", "block", "rows", "places"])


def needles_of(searches: DataFrame, key_col: str, search_col: str) -> DataFrame:
    """(key, needle) of what each search may be found as: folded, and without spaces; nothing of an empty search."""
    kind = searches.schema[key_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            folded = [normalize_search(s) if isinstance(s, str) else "" for s in frame["search"]]
            yield pd.DataFrame({"key": frame["key"], "needle": [[n, n.replace(" ", "")] if n else [] for n in folded]})

    found = searches.select(F.col(key_col).alias("key"), F.col(search_col).cast("string").alias("search")).mapInPandas(run, f"key {kind}, needle array<string>")
    return found.select("key", F.explode("needle").alias("needle")).distinct()


def _automaton(asked: list[list[str]]) -> tuple[ahocorasick.Automaton, int]:
    """Finds, at the end of each needle, the numbers of those who ask for it; and how long the longest needle is."""
    askers: dict[str, list[int]] = {}
    for k, needles in enumerate(asked):
        for needle in needles:
            askers.setdefault(needle, []).append(k)
    made = ahocorasick.Automaton()
    for needle, numbers in askers.items():
        made.add_word(needle, (needle, numbers))
    made.make_automaton()
    return made, max(map(len, askers), default=0)


def _asking(text: str, automaton: ahocorasick.Automaton, longest: int) -> list[int]:
    """Numbers of those who ask for anything in ``text``, ascending; slices overlap by what a needle may reach over."""
    found = {}
    for lo in range(0, len(text), SLICE):
        found.update(hit for _, hit in automaton.iter(text[lo : lo + SLICE + longest - 1]))
    return sorted({k for numbers in found.values() for k in numbers})


def search_many(rows: DataFrame, searches: DataFrame, id_col: str = "doc_id", text_col: str = "search_text", key_col: str = "item_id", search_col: str = "search") -> DataFrame:
    """(key, id) as ``TrigramIndex(rows).search(searches)`` gives it, for texts that are searched this once.

    An index pays for texts that are searched again and again: it writes and shuffles all of them.  Here the searches are sent to tasks as one
    automaton, and each text passes through it where it is read, long ones in slices; nothing of the texts is written or shuffled, and searches
    add work by what they hit.  Beyond ``ONE_PASS`` characters of searches, keys are dealt by a hash to further passes (the searches of one key
    stay together), beyond ``MOST_PASSES`` of these all are looked up in an index.
    """
    work = Work(rows.sparkSession, "searches")
    needles = work.keep(needles_of(searches, key_col, search_col), "needles")
    passes = -(-(needles.agg(F.sum(F.length("needle"))).first()[0] or 0) // ONE_PASS)
    dealt = F.pmod(F.xxhash64("key"), F.lit(max(passes, 1)))
    parts = [needles.where(dealt == n).groupBy("key").agg(F.collect_list("needle").alias("needles")).toArrow() for n in range(max(passes, 1) if passes <= MOST_PASSES else 0)]
    work.close()
    if not parts:
        return TrigramIndex(rows, id_col, text_col).search(searches, key_col, search_col)
    kinds = ", ".join(f"`{name}` {of.schema[name].dataType.simpleString()}" for of, name in ((searches, key_col), (rows, id_col)))
    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("search_text"))  # a filter here would fold each text twice

    def one_pass(known: pa.Table) -> DataFrame:
        keys, asked = known.column("key").combine_chunks(), known.column("needles").to_pylist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, longest = _automaton(asked)

            def hits(ids: pa.Array, row: list[int], who: list[int]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([keys.take(pa.array(who, pa.int64())), ids.take(pa.array(row, pa.int64()))], [key_col, id_col])

            for batch in batches:
                row, who = [], []
                for n, text in enumerate(batch.column("search_text").to_pylist()):
                    found = _asking(text or "", automaton, longest)
                    row += [n] * len(found)
                    who += found
                    if len(who) >= HITS:
                        yield hits(batch.column("id"), row, who)
                        row, who = [], []
                if who:
                    yield hits(batch.column("id"), row, who)

        return (source if asked else source.limit(0)).mapInArrow(run, kinds)

    return reduce(DataFrame.unionByName, map(one_pass, parts))


class TrigramIndex:
    """Texts by block and place, and for each trigram and block the places whose text has it, sorted by trigram on disk."""

    def __init__(self, rows: DataFrame, id_col: str = "doc_id", text_col: str = "search_text"):
        """``rows``: (id, folded text).  Null texts are empty; long ones are cut into slices; repeated rows and null ids are rows of their own."""
        self.work, self.id_col = Work(rows.sparkSession, "trigrams"), id_col
        kind = rows.schema[id_col].dataType.simpleString()
        source = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("search_text"))
        self.texts = self.work.keep(source.mapInArrow(_blocks, f"block long, place int, id {kind}, search_text string"), "texts")
        lists = self.texts.select("block", "place", "search_text").mapInArrow(_postings, "trigram int, block long, rows int, places binary")
        self.postings = self.work.keep(lists.repartitionByRange("trigram", "block").sortWithinPartitions("trigram", "block"), "postings")
        self.sizes = self.work.keep(self.postings.groupBy("trigram").agg(F.sum("rows").alias("rows")), "sizes")

    def needles(self, searches: DataFrame, key_col: str, search_col: str) -> DataFrame:
        return needles_of(searches, key_col, search_col)

    def candidates(self, needles: DataFrame) -> DataFrame:
        """(needle, block, place) of all rows that have the rarest trigrams of a needle of three characters and more."""

        def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = [trigrams(n) for n in frame["needle"]]
                yield pd.DataFrame({"needle": np.repeat(frame["needle"].to_numpy(), [len(f) for f in found]), "trigram": np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)})

        asked = needles.select("needle").distinct().where(F.length("needle") >= 3).mapInPandas(codes, "needle string, trigram int")
        known = asked.join(self.sizes, "trigram", "left")
        rank = F.row_number().over(Window.partitionBy("needle").orderBy(F.col("rows").asc_nulls_first(), "trigram"))
        # of a trigram that no text has there is no list, and so no candidate of its needle
        rare = self.work.keep(known.withColumn("n", rank).where(F.col("n") <= RAREST).withColumn("lists", F.count("*").over(Window.partitionBy("needle"))).select("needle", "trigram", "lists"), "rare")
        wanted = sorted(r.trigram for r in rare.select("trigram").distinct().collect())  # SIZE^3 at most
        lists = self.postings.where(F.col("trigram").isin(wanted)) if len(wanted) <= 1000 else self.postings
        met = lists.join(rare, "trigram").select("needle", "block", "lists", "trigram", "places")

        def meet(key: tuple, table: pa.Table) -> pa.Table:
            count = np.zeros(BLOCK, dtype=np.int64)
            for places in table.column("places").to_pylist():
                count[np.frombuffer(places, "<u2")] += 1
            hit = np.flatnonzero(count == table.column("lists")[0].as_py())
            return pa.table([pa.array([key[0].as_py()] * len(hit), pa.string()), pa.array([key[1].as_py()] * len(hit), pa.int64()), pa.array(hit.astype(np.int32))], names=["needle", "block", "place"])

        return met.groupBy("needle", "block").applyInArrow(meet, "needle string, block long, place int")

    def search(self, searches: DataFrame, key_col: str = "item_id", search_col: str = "search") -> DataFrame:
        """(key, id): every row whose folded text holds a search, or the search without its spaces, once for each search.

        Only lists of the rarest trigrams of a needle are read, by a filter that the scan of the sorted lists skips by; the texts of
        rows that have them all are then looked into.  Searches of one or two characters, of which there are few, look into all texts.

        Null and empty searches find nothing.  Searches of one key are found under it together; repeated ones count once, a null key is one of its own.  A row that was found stands once for each key, repeated rows
        as often as they are there.  Empty tables give an empty result.
        """
        needles = self.work.keep(self.needles(searches, key_col, search_col), "needles")
        some = self.work.keep(self.candidates(needles), "candidates")
        blocks = [r.block for r in some.select("block").distinct().limit(MOST_BLOCKS + 1).collect()]
        # few blocks are named to the scan, which skips the others; many are met in a join
        texts = self.texts.where(F.col("block").isin(blocks)) if len(blocks) <= MOST_BLOCKS else self.texts
        hits = some.join(texts, ["block", "place"]).where(F.expr("contains(search_text, needle)")).select("needle", "block", "place", "id")
        short = needles.where(F.length("needle") < 3).select("needle").distinct()
        if short.limit(1).count():  # SIZE + SIZE^2 at most
            more = self.texts.join(F.broadcast(short), F.expr("contains(search_text, needle)")).select("needle", "block", "place", "id")
            hits = hits.unionByName(more)
        found = hits.join(needles, "needle").select("key", "block", "place", "id").distinct()
        return found.select(F.col("key").alias(key_col), F.col("id").alias(self.id_col))
