"""TF-IDF as relations, nearest neighbours, a seeded two-dimensional layout, nearest points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.tables import Work

STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "for", "with", "are", "this", "from", "on", "as", "an", "by", "it", "at", "or", "be")
#: Most terms of the vocabulary, fewest documents and largest share of documents of a term.
MOST_TERMS, FEWEST_DOCS, MOST_SHARE = 8000, 2, 0.95


def vectorizer_stop_words(words: tuple[str, ...] = STOP_WORDS, metadata: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Words of a language and of page furniture, each once and sorted."""
    return tuple(sorted({*words, *metadata}))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; null text has none."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _counted(stop_words: tuple[str, ...]) -> Callable:
    """Distinct terms of each row with their number: words of two characters and more without stop words, and pairs of neighbours among them."""
    stops = pa.array(stop_words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows = batch.column("words"), batch.num_rows
            flat = lists.flatten().dictionary_encode()
            names = flat.dictionary
            kept = pc.and_(pc.greater_equal(pc.utf8_length(names), 2), pc.invert(pc.is_in(names, stops))).to_numpy(zero_copy_only=False).astype(bool)
            code = flat.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            use = kept[code] if len(code) else np.zeros(0, bool)
            code, row = code[use], row[use]
            beside = np.flatnonzero(row[1:] == row[:-1])
            pair, which = np.unique(code[beside] * max(1, len(names)) + code[beside + 1], return_inverse=True)
            first, second = (names.take(pa.array(part)) for part in (pair // max(1, len(names)), pair % max(1, len(names))))
            both = pa.concat_arrays([names.cast(pa.string()), pc.binary_join_element_wise(first.cast(pa.string()), second.cast(pa.string()), " ")])
            key, count = np.unique(np.concatenate((row * len(both) + code, row[beside] * len(both) + len(names) + which)), return_counts=True)
            edge = pa.array(np.searchsorted(key, np.arange(rows + 1) * len(both)).astype(np.int32))
            own = [pa.ListArray.from_arrays(edge, values) for values in (both.take(pa.array(key % max(1, len(both)))), pa.array(count.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], [batch.schema.names[0], "terms", "counts"])

    return run


#: Sums of uses kept while terms are counted: as many, in blocks of so many.
SUMS, SUM_BLOCK = 1 << 20, 1 << 16


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, sums) of a task: uses of all terms that a hash puts together."""
    sums = np.zeros(SUMS, np.int64)
    for batch in batches:
        sums += np.bincount(batch.column("at").flatten().to_numpy(), batch.column("counts").flatten().to_numpy(), minlength=SUMS).astype(np.int64)
    blocks = [k for k in range(SUMS // SUM_BLOCK) if sums[k * SUM_BLOCK : (k + 1) * SUM_BLOCK].any()]
    for k in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sums[k * SUM_BLOCK : (k + 1) * SUM_BLOCK].tobytes()])], ["block", "sums"])


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SUM_BLOCK, np.int64)
    for batch in batches:
        for sums in batch.column("sums"):
            total += np.frombuffer(sums.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()])], ["block", "sums"])


def _frequencies(wanted: np.ndarray) -> Callable:
    """(term, rows, uses) summed over each batch, of terms whose sum is ``wanted``; a term stands once in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = wanted[batch.column("at").flatten().to_numpy()]
            flat = batch.column("terms").flatten().filter(pa.array(use)).dictionary_encode()
            code, size = flat.indices.to_numpy(), len(flat.dictionary)
            uses = np.bincount(code, batch.column("counts").flatten().to_numpy()[use], minlength=size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([flat.dictionary.cast(pa.string()), pa.array(np.bincount(code, minlength=size)), pa.array(uses)], ["term", "df", "cf"])

    return run


def _vocabulary(counts: DataFrame, total: int, most: int, fewest: int, share: float) -> pd.DataFrame:
    """(term, df) of the ``most`` terms of highest corpus frequency.

    No term has more uses than its sum, so terms whose sum stays below a floor need not be shuffled.  The floor is a guess
    from the sums; where fewer than ``most`` terms reach it, it is lowered, to 0 at last, so the result is exact.
    """
    own = counts.select("terms", "counts", F.transform("terms", lambda t: F.xxhash64(t).bitwiseAND(F.lit(SUMS - 1)).cast("int")).alias("at"))
    sums = np.zeros(SUMS, np.int64)
    for row in own.select("at", "counts").mapInArrow(_uses, "block long, sums binary").groupBy("block").applyInArrow(_added, "block long, sums binary").toLocalIterator():
        sums[row.block * SUM_BLOCK : (row.block + 1) * SUM_BLOCK] = np.frombuffer(row.sums, np.int64)
    floor = int(max(0, 0.9 * (np.sort(sums)[-min(most, SUMS)] - 2 * np.median(sums))))
    while True:
        about = own.mapInArrow(_frequencies(sums >= max(floor, 1)), "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        found = about.where((F.col("cf") >= floor) & (F.col("df") >= fewest) & (F.col("df") <= share * total)).orderBy(F.desc("cf"), "term").limit(most).select("term", "df").toPandas()
        if len(found) >= most or not floor:
            return found
        floor = floor // 4 if floor > 8 else 0


def _weighed(names: list[str], idf: np.ndarray, lists_only: bool = False) -> Callable:
    """A row for each term of the vocabulary in each row, or (``lists_only``) one with all of them."""
    vocabulary = pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            flat = lists.flatten()
            at = pc.fill_null(pc.index_in(flat, vocabulary), -1).to_numpy()
            known = np.flatnonzero(at >= 0)
            at, row = at[known], row[known]
            raw = (1 + np.log(batch.column("counts").flatten().to_numpy()[known])) * idf[at]
            norm = np.sqrt(np.bincount(row, raw * raw, minlength=batch.num_rows))
            if lists_only:
                edge = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                both = [pa.ListArray.from_arrays(edge, values) for values in (vocabulary.take(pa.array(at)), pa.array(raw / norm[row]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *both], [batch.schema.names[0], "terms", "weights"])
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), vocabulary.take(pa.array(at)), pa.array(raw / norm[row])], [batch.schema.names[0], "term", "weight"])

    return run


def _tfidf(docs: DataFrame, id_col: str, text_col: str, most: int, fewest: int, share: float, stop_words: tuple[str, ...], lists_only: bool) -> DataFrame:
    work = Work(docs.sparkSession, "tfidf")
    kind = docs.schema[id_col].dataType.simpleString()
    counts = work.keep(docs.select(id_col, words(F.col(text_col)).alias("words")).mapInArrow(_counted(stop_words), f"`{id_col}` {kind}, terms array<string>, counts array<int>"), "counts")
    total = counts.count()
    vocabulary = _vocabulary(counts, total, most, fewest, share)
    idf = np.log((1 + total) / (1 + vocabulary["df"].to_numpy(dtype=float))) + 1
    schema = "terms array<string>, weights array<double>" if lists_only else "term string, weight double"
    out = counts.mapInArrow(_weighed(vocabulary["term"].tolist(), idf, lists_only), f"`{id_col}` {kind}, {schema}")
    out.kept_at = counts.kept_at
    return out


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TERMS, fewest: int = FEWEST_DOCS, share: float = MOST_SHARE, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, term, weight): 1 + ln(tf) times ln((1 + n) / (1 + df)) + 1, each row to length 1.

    Texts are read once: each row's terms are counted inside it and written below the working folder;
    only (term, rows, uses) of terms that may be in the vocabulary is shuffled.  The vocabulary holds the ``most`` terms of highest
    corpus frequency among those of medium document frequency, so it is small enough to be sent to
    all tasks, and weights and lengths come from one row each.

    Null and empty texts have no terms and no rows in the result, but count as documents.  Very long texts are counted
    whole.  Null ids and repeated rows are rows of their own.  An empty table gives an empty result.
    """
    return _tfidf(docs, id_col, text_col, most, fewest, share, stop_words, False)


def tfidf_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TERMS, fewest: int = FEWEST_DOCS, share: float = MOST_SHARE, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, terms, weights): ``tfidf`` as one row for each row of ``docs``, whose lists are empty where it has no terms; it reads a working table (``kept_at``)."""
    return _tfidf(docs, id_col, text_col, most, fewest, share, stop_words, True)


# ------------------------------------------------------------------ neighbours

#: Dimensions of the dense form, rows of a cell that are compared with each other, and cells that a row looks into.
DENSE, CELL, PROBES = 64, 2000, 3
NEIGHBOURS = 15


def dense(vectors: DataFrame, id_col: str = "doc_id", size: int = DENSE, seed: int = 42) -> DataFrame:
    """(id, v): a seeded projection of sparse rows to ``size`` numbers, to length 1; cosines stay about the same.

    Each term has a sign in each dimension, so a row is a sum of a few numbers for each term, combined before the shuffle.
    """
    sign = lambda d: F.when(F.xxhash64("term", F.lit(seed + d)) < 0, -F.col("weight")).otherwise(F.col("weight"))
    summed = vectors.groupBy(id_col).agg(*[F.sum(sign(d)).alias(f"d{d}") for d in range(size)])
    length = F.sqrt(sum((F.col(f"d{d}") * F.col(f"d{d}") for d in range(size)), F.lit(0.0)))
    return summed.select(id_col, F.array(*[F.coalesce(F.try_divide(F.col(f"d{d}"), length), F.lit(0.0)) for d in range(size)]).alias("v"))


def neighbours(points: DataFrame, id_col: str = "doc_id", k: int = NEIGHBOURS, cell: int = CELL, probes: int = PROBES, seed: int = 42) -> DataFrame:
    """(id, other, similarity): for each row of (id, v) the ``k`` others of highest cosine, ties by id.

    Rows are dealt to the cells of sampled pivots; a row is compared in the cells of its ``probes`` nearest pivots, at
    home in the first.  There are about as many pivots as rows divided by ``cell``, 4096 at most; a cell
    that is larger is dealt again by a hash, so tasks stay bounded.  With one cell, that is up to ``cell`` rows, the result is
    exact; tests measure the recall beyond.  Ids must be unique; an empty table gives an empty result.
    """
    total = points.count()
    want = max(1, min(4096, -(-total // cell)))
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    pivots = np.array([r["v"] for r in points.orderBy(order).limit(want).select("v").collect()], dtype=np.float64).reshape(-1, len(points.first()["v"]) if total else 1)
    probes = min(probes, max(1, len(pivots)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch.column("v").to_numpy(zero_copy_only=False))
                near = np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :probes]
                take = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(probes) == 0, batch.num_rows)), batch.column(0).take(take), batch.column("v").take(take)], ["cell", "home", "id", "v"])

    def nearest_in(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        v = np.stack(table.column("v").to_numpy())
        own, at = [], []
        for lo in range(0, len(v), 1000):
            cosine = v[lo : lo + 1000] @ v.T
            cosine[np.arange(len(cosine)), lo + np.arange(len(cosine))] = -2
            few = np.argsort(-cosine, axis=1, kind="stable")[:, : min(k, len(v) - 1)]
            own.append(np.repeat(lo + np.arange(len(cosine)), few.shape[1]))
            at.append(few.ravel())
        own, at = np.concatenate(own), np.concatenate(at)
        return pa.table({"id": table.column("id").take(pa.array(own)), "other": table.column("id").take(pa.array(at)), "similarity": pa.array((v[own] * v[at]).sum(axis=1))})

    kind = points.schema[id_col].dataType.simpleString()
    placed = points.select(F.col(id_col).alias("id"), "v").mapInArrow(dealt, f"cell int, home boolean, id {kind}, v array<double>")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / (4 * cell * probes)).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    found = placed.groupBy("cell", "part").applyInArrow(nearest_in, f"id {kind}, other {kind}, similarity double").dropDuplicates(["id", "other"])
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "other"))), 1, k).alias("n"))
    return best.select(F.col("id").alias(id_col), F.explode("n").alias("n")).select(id_col, "n.other", (-F.col("n.far")).alias("similarity"))


#: Rounds of the layout, and how close linked points come.
ROUNDS, CLOSE = 6, 0.12


def layout(vectors: DataFrame, id_col: str = "doc_id", seed: int = 42, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(id, x, y): a seeded layout in which neighbours lie close.

    Points begin at the first two principal axes of the dense form (a sum over all rows), spread
    to standard deviation 10, and move for some rounds toward the mean of their neighbours, by similarity, keeping
    a share of their own place; after each round the spread is restored, so the whole does not collapse.
    Rows of equal vectors meet; rows without terms are not in the result.
    """
    work = Work(vectors.sparkSession, "layout")
    points = work.keep(dense(vectors, id_col, seed=seed), "dense")
    total = points.count()
    if total < 3:
        return points.select(id_col, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    size = DENSE

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, mean = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch.column("v").to_numpy(zero_copy_only=False))
                square += v.T @ v
                mean += v.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([square.ravel().tolist()]), pa.array([mean.tolist()])], ["square", "mean"])

    parts = points.select("v").repartition(32, F.xxhash64("v")).mapInArrow(moments, "square array<double>, mean array<double>").collect()
    mean = sum(np.array(r["mean"]) for r in parts) / total
    spread = sum(np.array(r["square"]).reshape(size, size) for r in parts) / total - np.outer(mean, mean)
    axes = np.linalg.eigh(spread)[1][:, -1:-3:-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1, 1)
    dot = lambda a: sum((F.get("v", F.lit(d)) * float(a[d]) for d in range(size)), F.lit(0.0))
    start = points.select(id_col, dot(axes[:, 0]).alias("x"), dot(axes[:, 1]).alias("y"))
    links = work.keep(neighbours(points, id_col, k, seed=seed).where("similarity > 0").select(F.col(id_col).alias("id"), "other", "similarity"), "neighbours")

    def spread_out(df: DataFrame) -> DataFrame:
        row = df.agg(*[f(c) for c in ("x", "y") for f in (F.avg, F.stddev_pop)]).first()
        scaled = [((F.col(c) - row[2 * j]) / (row[2 * j + 1] or 1.0) * 10).alias(c) for j, c in enumerate(("x", "y"))]
        return work.keep(df.select(id_col, *scaled), "placed")

    now = spread_out(start)
    for _ in range(rounds):
        other = now.select(F.col(id_col).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        pulled = links.join(other, "other").groupBy("id").agg(*[(F.sum(F.col(f"o{c}") * F.col("similarity")) / F.sum("similarity")).alias(f"o{c}") for c in ("x", "y")])
        moved = now.join(pulled, F.col(id_col) == F.col("id"), "left")
        now = spread_out(moved.select(id_col, *[(F.col(c) * CLOSE + F.coalesce(f"o{c}", c) * (1 - CLOSE)).alias(c) for c in ("x", "y")]))
    return now


def nearest(points: DataFrame, x: float, y: float, radius: float, ties: str) -> DataFrame:
    """The nearest point within ``radius``; of equally near ones the first by ``ties``.  None within gives an empty result."""
    d = F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
    return points.withColumn("distance", d).where(F.col("distance") <= radius).orderBy("distance", ties).limit(1)
