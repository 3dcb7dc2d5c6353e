"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as sh
from millrace.llm.work import texts_of
from millrace.session import ready

#: Buckets of hashed terms, and bytes of a word's prefixes that are terms beside the word.
BUCKETS, PREFIXES = 1 << 20, (3, 4, 5, 6, 7, 8, 9)
#: Labelled documents that are learnt from, at most (about: those of smallest hashed id, whatever the number of labels).
MOST_LABELLED = 12_000
#: Sampled ids that are sent to all tasks, at most; a larger sample is joined by a shuffle.
MOST_SENT = 100_000
#: Terms with weights: those that differ most between the classes, and those that do so in pairs.  Length of their factors.
TERMS, PAIRED, FACTORS = 768, 256, 8
#: Most frequent terms whose pairs are looked at, beside the pairs of terms that tell alone; least gain of a pair, and how far it must exceed that of its terms.
FREQUENT, PAIR_GAIN, PAIR_MORE = 1024, 6.0, 1.25
#: A label is predicted from this score on.
THRESHOLD = 0.7

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BITS = np.uint64(64 - 20)


def _parts(text: bytes) -> Iterator[tuple[int, int]]:
    """Where a text is cut between words into parts of a chunk at most; a longer word is in a part of its own size."""
    at = 0
    while at < len(text):
        stop = min(at + sh.CHUNK, len(text))
        if stop < len(text):
            breaks = np.flatnonzero(~_WORD[np.frombuffer(text, dtype=np.uint8, count=stop - at, offset=at)])
            if len(breaks):
                stop = at + int(breaks[-1]) + 1
            else:  # no break in a whole chunk: on to the next one
                while stop < len(text):
                    more = np.flatnonzero(~_WORD[np.frombuffer(text, dtype=np.uint8, count=min(sh.CHUNK, len(text) - stop), offset=stop)])
                    stop += int(more[0]) + 1 if len(more) else min(sh.CHUNK, len(text) - stop)
                    if len(more):
                        break
        yield at, stop
        at = stop


def hashed_terms(texts: list[bytes], keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Distinct buckets of each text's words and their prefixes, ASCII letters lower-cased.

    With ``keep`` (bucket -> term or -1), the distinct terms instead.
    """
    for lo, hi in sh.batches(texts, sh.CHUNK):
        parts = list(_parts(texts[lo])) if hi == lo + 1 and len(texts[lo]) > sh.CHUNK else []
        if len(parts) > 1:  # a long text: its parts are folded into one set of buckets
            seen = np.zeros(BUCKETS, dtype=bool)
            for a, b in parts:
                for found in hashed_terms([texts[lo][a:b]], keep):
                    seen[found] = True
            yield np.flatnonzero(seen).astype(np.int32)
            continue
        data = _LOWER[np.frombuffer(b"\n".join(texts[lo:hi]), dtype=np.uint8)]
        edge = np.diff(np.concatenate(([False], _WORD[data], [False])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cut = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]]))
        terms, places, hashes = [], [], sh.hasher(data)
        for n in (0, *PREFIXES):
            here = np.arange(len(starts)) if not n else np.flatnonzero(ends - starts >= n)
            a = starts[here]
            value = hashes(a, ends[here] if not n else a + n)
            bucket = (sh.mix(value + np.uint64(bool(n))) >> _BITS).astype(np.int64)
            if keep is not None:
                bucket = keep[bucket]
                known = bucket >= 0
                bucket, here = bucket[known], here[known]
            terms.append(bucket)
            places.append(here)
        term, place = np.concatenate(terms), np.concatenate(places)
        doc = np.searchsorted(cut, place, side="right") - 1
        pairs = np.unique(doc * BUCKETS + term)
        stop = np.searchsorted(pairs, np.arange(hi - lo + 1) * BUCKETS)
        for k in range(hi - lo):
            yield (pairs[stop[k] : stop[k + 1]] % BUCKETS).astype(np.int32)


def gain(yes: np.ndarray, no: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """How far shares of toxic and other documents lie apart, in standard errors; none for what under four documents hold."""
    both = (yes + no) / (n1 + n0)
    out = np.abs(yes / n1 - no / n0) / np.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-9)
    out[yes + no < 4] = 0
    return out


def distinct(ranked: np.ndarray, flat: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of ``ranked`` terms that stand in the same documents, by a sum of hashed documents, the first."""
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[ranked] = np.arange(len(ranked))
    known = place[flat] >= 0
    stands = np.zeros(len(ranked), dtype=np.uint64)
    np.add.at(stands, place[flat[known]], sh.mix(doc[known].astype(np.uint64) + np.uint64(1)))
    _, once = np.unique(stands, return_index=True)
    return ranked[np.sort(once)]


def paired(terms: np.ndarray, chosen: np.ndarray, alone: np.ndarray, flat: np.ndarray, doc: np.ndarray, labels: np.ndarray, most: int = PAIRED) -> np.ndarray:
    """Terms beside ``chosen`` that tell only together with another of ``terms``, best pairs first.

    Of a pair both counts of documents are taken, toxic and other, from products of
    incidence matrices in blocks of documents, so any two of ``terms`` are looked at.
    """
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[terms] = np.arange(len(terms))
    known = place[flat] >= 0
    column, row = place[flat[known]], doc[known]
    count = np.zeros((2, len(terms), len(terms)), dtype=np.float32)
    for lo in range(0, len(labels), 2048):
        a, b = np.searchsorted(row, [lo, lo + 2048])
        x = np.zeros((2048, len(terms)), dtype=np.float32)
        x[row[a:b] - lo, column[a:b]] = 1
        y = np.zeros(2048, dtype=bool)
        y[: len(labels[lo : lo + 2048])] = labels[lo : lo + 2048] == 1
        for k, part in enumerate((x[y], x[~y])):
            count[k] += part.T @ part
    own, used = alone[terms], np.isin(terms, chosen)
    first, second, value = [], [], []
    for i in range(len(terms) - 1):
        z = gain(count[0, i, i + 1 :].astype(float), count[1, i, i + 1 :].astype(float), labels.sum(), len(labels) - labels.sum())
        j = np.flatnonzero((z >= PAIR_GAIN) & (z > PAIR_MORE * np.maximum(own[i], own[i + 1 :])) & ~(used[i] & used[i + 1 :]))
        first += [i] * len(j)
        second += (j + i + 1).tolist()
        value += z[j].tolist()
    out: dict[int, None] = {}
    for k in np.argsort(-np.array(value), kind="stable").tolist():
        if len(out) + 2 > most:
            break
        out.update(dict.fromkeys(t for t in (first[k], second[k]) if not used[t]))
    return terms[np.array(list(out), dtype=np.int64)]


class FactorizationMachine:
    """b + sum of w_i + sum over pairs of <v_i, v_j>, for sets of terms, through a logistic."""

    def __init__(self, terms: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor
        self.keep = np.full(BUCKETS, -1, dtype=np.int32)
        self.keep[terms] = np.arange(len(terms), dtype=np.int32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, own in enumerate(hashed_terms(texts, self.keep)):
            v = self.factor[own]
            total = v.sum(axis=0)
            out[k] = self.bias + self.weight[own].sum() + 0.5 * ((total * total).sum() - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    @classmethod
    def learnt(cls, sets: list[np.ndarray], labels: np.ndarray, terms: int = TERMS, factors: int = FACTORS, steps: int = 400) -> FactorizationMachine:
        """Adam on the whole sample; the rarer class weighs more.  Without both classes, the prior."""
        labels = labels.astype(np.float64)
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        prior = float(np.log(share / (1 - share)))
        if not 0 < labels.sum() < len(labels):
            return cls(np.zeros(0, dtype=np.int64), prior, np.zeros(0), np.zeros((0, factors)))
        flat = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        yes = np.bincount(flat[labels[doc] == 1], minlength=BUCKETS).astype(np.float64)
        no = np.bincount(flat[labels[doc] == 0], minlength=BUCKETS).astype(np.float64)
        n1, n0 = labels.sum(), len(labels) - labels.sum()
        alone = gain(yes, no, n1, n0)
        told = np.where(alone < 3, 0, alone)
        best = np.argsort(-told, kind="stable")[: int((told > 0).sum())]
        chosen = distinct(best, flat, doc)[:terms]
        often = np.argsort(-np.where(yes + no > 0.6 * len(labels), 0, yes + no), kind="stable")[: FREQUENT * 2]
        often = distinct(often[(yes + no)[often] >= 4], flat, doc)[:FREQUENT]
        chosen = np.concatenate((chosen, paired(np.union1d(chosen, often), chosen, alone, flat, doc, labels)))
        keep = np.full(BUCKETS, -1, dtype=np.int64)
        keep[chosen] = np.arange(len(chosen))
        x = np.zeros((len(sets), len(chosen)), dtype=np.float32)
        hit = keep[flat] >= 0
        x[doc[hit], keep[flat[hit]]] = 1
        rng = np.random.default_rng(7)
        value = {"b": np.array([prior]), "w": np.zeros(len(chosen)), "v": rng.normal(0, 0.05, (len(chosen), factors))}
        mean = {k: np.zeros_like(a) for k, a in value.items()}
        square = {k: np.zeros_like(a) for k, a in value.items()}
        each = np.where(labels == 1, min(4.0, n0 / n1), 1.0)
        each /= each.sum()
        for step in range(1, steps + 1):
            v = value["v"].astype(np.float32)
            total = x @ v
            raw = value["b"][0] + x @ value["w"].astype(np.float32) + 0.5 * ((total * total).sum(axis=1) - x @ (v * v).sum(axis=1))
            off = (each * (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels)).astype(np.float32)
            pull = x.T @ off
            grad = {"b": np.array([off.sum()]), "w": pull + 2e-4 * value["w"], "v": x.T @ (off[:, None] * total) - pull[:, None] * v + 2e-4 * value["v"]}
            for k, g in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                value[k] = value[k] - 0.03 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        return cls(chosen, float(value["b"][0]), value["w"], value["v"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> FactorizationMachine:
    """The machine learnt from labelled rows that are not held out: ``most`` of them, by hashed id.

    Rows without a label, with a null label, null text or null id are not learnt from.  Of
    several labels of one id the largest counts; repeated documents count each.  Without
    rows of both labels the machine gives every text the prior.
    """
    ready(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    # a share in 2**63, as it may be far below one in a million
    share = most * (2**63 - 1) // max(known.count(), most)
    known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 1) <= F.lit(share))
    if most <= MOST_SENT:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(known, "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in hashed_terms(texts_of(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(sets, pa.binary())], ["doc_id", "label", "terms"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        own = FactorizationMachine.learnt([np.frombuffer(t, dtype=np.int32) for t in pdf["terms"]], pdf["label"].to_numpy())
        return pd.DataFrame({"bias": [own.bias], "terms": [np.flatnonzero(own.keep >= 0)[np.argsort(own.keep[own.keep >= 0])].astype(np.int64).tobytes()], "weight": [own.weight.tobytes()], "factor": [own.factor.tobytes()]})

    hashed = rows.select("doc_id", "label", "text").mapInArrow(terms, "doc_id long, label int, terms binary")
    fitted = hashed.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "bias double, terms binary, weight binary, factor binary").first()
    if fitted is None:
        return FactorizationMachine.learnt([], np.zeros(0))
    weight = np.frombuffer(fitted["weight"])
    return FactorizationMachine(np.frombuffer(fitted["terms"], dtype=np.int64), fitted["bias"], weight, np.frombuffer(fitted["factor"]).reshape(len(weight), -1))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, without a shuffle.

    Null and empty texts get the score of no terms.  Null ids and repeated rows are scored like
    any other; an empty table gives an empty result; other columns are ignored.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = machine.scores(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
