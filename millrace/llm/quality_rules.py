"""Quality rules on repetition: characters inside duplicated n-grams and lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as sh
from millrace.llm.work import texts_of, tidy
from millrace.session import ready

#: n-gram length -> largest share of word characters inside n-grams that occur twice or more.
MOST_REPEATED = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.25, 9: 0.24, 10: 0.23}
#: Largest share of characters in lines equal to an earlier line.
MOST_LINES = 0.30
#: Words in a window of the base rule.
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a code point.
_POINT = (np.arange(256) & 0xC0) != 0x80


def repeated_words(hashes: np.ndarray, n: int) -> np.ndarray:
    """For each word: whether it lies in an n-word window that occurs twice or more."""
    inside = np.zeros(len(hashes), dtype=bool)
    windows = sh.window_hashes(hashes, n)
    if len(windows) < 2:
        return inside
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(windows) + 1, dtype=np.int32)
    hit = np.zeros(len(windows), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    # a window that starts at k covers k .. k + n - 1: a running count of starts over the last n places
    np.cumsum(hit, out=twice[1:])
    ends = np.minimum(np.arange(1, len(hashes) + 1), len(windows))
    starts = np.minimum(np.maximum(np.arange(1, len(hashes) + 1) - n, 0), len(windows))
    return twice[ends] > twice[starts]


def _duplicate_lines(text: bytes) -> tuple[int, int, int]:
    """(lines that repeat an earlier one, their characters, characters of all lines with a word)."""
    count = chars = total = 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if not line.strip(b" \t\r\x0b\x0c"):
            continue
        size = len(line) if line.isascii() else len(line.decode("utf-8", "replace"))
        total += size
        if line in seen:
            count += 1
            chars += size
        else:
            seen.add(line)
    return count, chars, total


def _measure(lengths: dict[int, float], lines: float) -> Callable:
    sizes = sorted({WINDOW, *lengths})
    kinds = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            out = np.zeros((5, len(texts)), dtype=np.int64)
            kept, share, worst = np.ones(len(texts), dtype=bool), np.zeros(len(texts)), np.zeros(len(texts))
            for lo, hi in sh.batches(texts):
                data = np.frombuffer(b"\n".join(texts[lo:hi]), dtype=np.uint8)
                starts, ends = sh.word_spans(data)
                hashes = sh.span_hashes(data, starts, ends)
                chars = sh.counts_before(_POINT, data, ends) - sh.counts_before(_POINT, data, starts)
                edge = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
                symbols = sh.counts_before(_SYMBOL, data, np.minimum(edge, len(data)))
                cut = np.searchsorted(starts, edge)
                for k in range(lo, hi):
                    a, b = cut[k - lo], cut[k - lo + 1]
                    own, size = hashes[a:b], chars[a:b]
                    total = int(size.sum())
                    again, line_chars, all_chars = _duplicate_lines(texts[k])
                    out[:4, k] = b - a, total, symbols[k - lo + 1] - symbols[k - lo], again
                    for n in sizes:
                        inside = repeated_words(own, n)
                        if not inside.any():  # a longer n-gram that repeats would hold one of these
                            break
                        if n == WINDOW:
                            out[4, k] = inside.sum()
                        if n in lengths:
                            covered = size[inside].sum() / total
                            share[k] = max(share[k], covered)
                            kept[k] &= covered <= lengths[n]
                    worst[k] = line_chars / all_chars if all_chars else 0.0
                    kept[k] &= worst[k] <= lines
            failed = (out[0] < 20) | (100 * out[4] > 30 * out[0])
            columns = [batch.column("doc_id"), *map(pa.array, out), pa.array(failed), pa.array(kept & ~failed), pa.array(share), pa.array(worst)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *kinds, "base_failed", "kept", "dup_ngram_share", "dup_line_share"])

    return run


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: dict[int, float] | None = None, lines: float = MOST_LINES) -> DataFrame:
    """Counts, shares and verdict of every row of ``docs``; a text is read once and nothing is shuffled.

    ``kept`` is false where the base rule fails (under 20 words, or over 30 % of
    the words in 8-word windows that occur twice), or where for one n-gram length
    the characters inside n-grams that occur twice or more, each character once,
    exceed that length's share of all word characters, or where duplicated
    lines exceed theirs.

    Null or empty text has no words and fails the base rule.  A very long text is measured
    whole, beside a few numbers for each of its words.  Null ids and
    repeated rows are reported like any other.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    ready(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(
        tidy(_measure(MOST_REPEATED if lengths is None else lengths, lines)),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_ngram_share double, dup_line_share double",
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass without a shuffle.

    Null, empty and short texts go.  Null ids and repeated rows are judged like any other; an
    empty table gives an empty one; columns keep their names, whatever they are.
    """
    ready(docs.sparkSession)
    columns, schema = docs.columns, docs.schema
    measure = _measure(MOST_REPEATED, MOST_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col)], ["doc_id", "text"])
            (measured,) = measure(iter([source]))
            yield batch.filter(measured.column("kept"))

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(tidy(run), schema)


def oracle(lengths: dict[int, float] | None = None, lines: float = MOST_LINES) -> str:
    """The same as SQL, by the words themselves; for tables whose ids are unique."""
    limits = MOST_REPEATED if lengths is None else lengths
    values = ", ".join(f"({n}, CAST({limits.get(n, 1)} AS DOUBLE))" for n in sorted({WINDOW, *limits}))
    listed = ", ".join(map(str, sorted(limits)))
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        b AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
        line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        once AS (SELECT doc_id, line, count(*) AS c, length(line) AS size FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
        dup AS (SELECT doc_id, sum(c - 1) AS n, sum((c - 1) * size) / sum(c * size) AS share FROM once GROUP BY doc_id),
        lens(n, most) AS (VALUES {values}),
        place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
        win AS (SELECT doc_id, n, most, p, length(w[p]) AS size, CASE WHEN p + n - 1 <= len(w) THEN array_to_string(w[p : p + n - 1], ' ') END AS gram FROM place, lens),
        hit AS (SELECT doc_id, n, most, p, size, CAST(gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, n, gram) > 1 AS INTEGER) AS hit FROM win),
        cover AS (
            SELECT doc_id, n, most, size,
                   CASE n {" ".join(f"WHEN {n} THEN max(hit) OVER (PARTITION BY doc_id, n ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sorted({WINDOW, *limits}))} END AS inside
            FROM hit),
        by_n AS (SELECT doc_id, n, most, sum(inside) AS words, sum(size * inside) / sum(size) AS share FROM cover GROUP BY doc_id, n, most),
        rep AS (
            SELECT doc_id, max(words) FILTER (n = {WINDOW}) AS words, max(share) FILTER (n IN ({listed})) AS share, bool_or(share > most) FILTER (n IN ({listed})) AS over
            FROM by_n GROUP BY doc_id),
        total AS (
            SELECT b.*, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.words, 0) AS BIGINT) AS n_repeat_words,
                   coalesce(rep.share, 0.0) AS dup_ngram_share, coalesce(dup.share, 0.0) AS dup_line_share, coalesce(rep.over, FALSE) AS over
            FROM b LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR over OR dup_line_share > CAST({lines} AS DOUBLE)) AS kept, dup_ngram_share, dup_line_share
        FROM total
    """
