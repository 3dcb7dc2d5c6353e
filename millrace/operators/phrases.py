"""Occurrences of thousands of phrases, by one automaton in one pass over the texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.tables import Work

#: Phrases of one automaton, about; more are looked for in further passes.
AUTOMATON = 100_000


def _automaton(phrases: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        made.add_word(f" {phrase} ", k)
    made.make_automaton()
    return made


def counted(text: str, automaton: ahocorasick.Automaton) -> Counter:
    """How often each phrase stands in a text of words in single spaces, as whole words, overlapping ones too."""
    return Counter(k for _, k in automaton.iter(f" {text} "))


def phrase_hits(rows: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "search_text", phrase_col: str = "phrase", block: int = AUTOMATON) -> DataFrame:
    """(id, phrase, n) for every row of (id, text) and phrase that stands in it as whole words.

    Texts and phrases are words in single spaces (``search_text``).  Phrases are sent to tasks in blocks of about ``block`` by a hash; each
    task builds the automaton of a block once, and a text is passed through it whole, whatever the number of phrases. Nothing of the texts is shuffled.

    Null and empty texts and phrases give no row; repeated phrases count once; a row that is there twice has its rows twice; null ids are
    reported like any other.  Empty tables give an empty result.  Other columns are ignored.
    """
    work = Work(rows.sparkSession, "phrases")
    kind = rows.schema[id_col].dataType.simpleString()
    known = work.keep(phrases.select(F.trim(phrase_col).alias("phrase")).where("phrase <> ''").distinct(), "phrases")
    blocks = max(1, -(-known.count() // block))
    source, out = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''"), None
    for n in range(blocks):
        own = sorted(r.phrase for r in known.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == n).collect())

        def run(batches: Iterator[pa.RecordBatch], own: list[str] = own) -> Iterator[pa.RecordBatch]:
            automaton, names = _automaton(own) if own else None, pa.array(own, pa.string())
            for batch in batches:
                if automaton is None or not batch.num_rows:
                    continue
                found = [counted(t, automaton) for t in batch.column("text").to_pylist()]
                row = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
                code = np.array([k for f in found for k in f], dtype=np.int64)
                times = np.array([c for f in found for c in f.values()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), names.take(pa.array(code)), pa.array(times)], [id_col, phrase_col, "n"])

        found = source.mapInArrow(run, f"`{id_col}` {kind}, `{phrase_col}` string, n long")
        out = found if out is None else out.unionByName(found)
    return out


def phrases_of(texts: DataFrame, sizes: tuple[int, ...] = (2,), text_col: str = "search_text", phrase_col: str = "phrase") -> DataFrame:
    """Distinct runs of so many words of texts of words in single spaces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = {" ".join(w[k : k + n]) for t in frame["text"] for w in [t.split()] for n in sizes for k in range(len(w) - n + 1)}
            yield pd.DataFrame({phrase_col: sorted(found)}, dtype="object")

    return texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, f"`{phrase_col}` string").distinct()
