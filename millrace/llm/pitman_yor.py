"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a Chinese restaurant of its own; all of these restaurants share one parent, the restaurant
of single words, whose base is uniform over the known words and one unknown.  A customer is an occurrence of a word after its context; the first of
a table is sent to the parent as well.  A state of the sampler is the number of tables of each word in each restaurant, with the
sizes of tables summed out; a Gibbs sweep draws each of these from its distribution given all others of the last sweep.
A word that followed its context once sits at one table, whatever is drawn, so only repeated pairs are sampled.

Restaurants are cut by a hash of (context, word), so no context is too large for a task; words are cut by a hash of their own.  In a
sweep pair buckets draw tables and tell word buckets what they sent to the parent, word buckets draw the parent's tables and answer with what
the next sweep needs.  Words are known by 64 bits of a hash, contexts and words of a pair by 48 bits each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as sh
from millrace.llm.work import Work, release, texts_of, tidy

#: Bytes of text of a batch, and tokens of a bucket, about.
BATCH, BUCKET = 16 << 20, 2_000_000
#: Strength of the contexts' restaurants and of their parent; sweeps before the samples, and samples that are averaged.
THETA, THETA_ROOT = 1.0, 1.0
BURN, SAMPLES = 2, 3
#: Customers of a word in a restaurant up to which its tables are drawn exactly; above, one of PARTICLES seatings is drawn by weight.
EXACT, PARTICLES = 64, 8
#: Cells of a table of weights.
CELLS = 1 << 20
#: The end of a text, as a word and as the context of the first word.
END = np.uint64(0x5851F42D4C957F2D)

CORE, REFS, ASK, WORD, REPLY, STATS = range(6)
_ARRAYS = "abcdefg"
_MESSAGE = "kind int, key long, other long, " + ", ".join(f"{c} binary" for c in _ARRAYS) + ", n array<double>"
_TYPES = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("other", pa.int64()), *[(c, pa.binary()) for c in _ARRAYS], ("n", pa.list_(pa.float64()))])


def packed(values: np.ndarray) -> bytes:
    """An array as compressed planes of bytes, with its type."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return values.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[3:]), dtype=np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _short(values: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits where they fit."""
    return values.astype("<i4" if int(values.max(initial=0)) < 1 << 31 else "<i8")


def _table(rows: list[tuple]) -> pa.Table:
    """Messages: (kind, key, other, arrays, numbers)."""
    columns: list[list] = [[] for _ in _TYPES]
    for kind, key, other, arrays, numbers in rows:
        filled = [packed(a) for a in arrays] + [None] * (len(_ARRAYS) - len(arrays))
        for column, value in zip(columns, [kind, key, other, *filled, numbers], strict=True):
            column.append(value)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _TYPES, strict=True)], schema=_TYPES)


def _sent(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield from _table([row]).to_batches()


# --- batches of documents ---------------------------------------------------------------------------------------------

_BATCHES = "batch long, ids array<long>, held binary, sizes binary, words binary, tokens binary"


def _sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, each with its end, and the number of tokens of each text."""
    data = b"\n".join(texts).lower()
    edge = np.cumsum([0] + [len(t) + 1 for t in texts])
    hashes, counts, at = [np.zeros(0, np.uint64)], np.zeros(len(texts), dtype=np.int64), 0
    while at < len(data):  # in slices that end at white space, as starts and ends of words take more than their hashes
        stop = min((p for p in (data.find(c, at + BATCH // 2) for c in (b" ", b"\n")) if p >= 0), default=len(data))
        part = np.frombuffer(data, dtype=np.uint8, count=stop - at, offset=at)
        starts, ends = sh.word_spans(part)
        hashes.append(sh.span_hashes(part, starts, ends))
        counts += np.diff(np.searchsorted(starts + at, edge))
        at = max(stop, at + 1)
    words = np.concatenate(hashes)
    out = np.full(len(words) + len(texts), END, dtype=np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = words
    return out, counts + 1


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch = TaskContext.get().partitionId() << 32
    ids: list = []
    held: list = []
    texts: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        hashes, sizes = _sequence(texts)
        texts.clear()
        words, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words have small numbers
        number = np.empty(len(order), dtype="<u4")
        number[order] = np.arange(len(order))
        row = [batch, ids, packed(np.array(held, dtype="|u1")), packed(_short(sizes)), packed(words[order]), packed(number[at])]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [f.split()[0] for f in _BATCHES.split(", ")])

    for rows in batches:
        for doc, kept, text in zip(rows.column("doc_id").to_pylist(), rows.column("held").to_pylist(), texts_of(rows, "text"), strict=True):
            if texts and size + len(text) > BATCH:
                yield out()
                batch, ids, held, size = batch + 1, [], [], 0
            ids.append(doc)
            held.append(kept)
            texts.append(text)
            size += len(text) + 1
    if texts:
        yield out()


class _Batch:
    """Tokens of a batch as numbers of its words; ``train`` marks tokens that are learned from."""

    def __init__(self, row: dict):
        self.batch, self.ids = row["batch"], row["ids"]
        self.held, self.sizes = unpacked(row["held"]).astype(bool), unpacked(row["sizes"]).astype(np.int64)
        self.words, self.tokens = unpacked(row["words"]), unpacked(row["tokens"]).astype(np.int64)
        self.train = np.repeat(~self.held, self.sizes)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (context, word), which of them each token is, and how often each occurs in what is learned from."""
        end = int(np.flatnonzero(self.words == END)[0])
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = end
        keys, at = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        return keys // len(self.words), keys % len(self.words), at, np.bincount(at[self.train], minlength=len(keys))


def _name(words: np.ndarray) -> np.ndarray:
    """The 48 bits by which pairs know a word."""
    return words >> np.uint64(16)


def _pair_bucket(u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    return (sh.mix(u * np.uint64(0x9E3779B97F4A7C15) + w) >> np.uint64(20)) % np.uint64(buckets)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    values, starts = np.unique(bucket[order], return_index=True)
    for value, at in zip(values, np.split(order, starts[1:]), strict=True):
        yield int(value), at


def _low48(values: np.ndarray) -> np.ndarray:
    """48-bit numbers as 16 and 32 bits: fewer planes."""
    return np.concatenate([(values >> np.uint64(32)).astype("<u2").view("|u1"), (values & np.uint64(0xFFFFFFFF)).astype("<u4").view("|u1")])


def _from48(data: np.ndarray) -> np.ndarray:
    n = len(data) // 6
    return (data[: 2 * n].copy().view("<u2").astype(np.uint64) << np.uint64(32)) | data[2 * n :].copy().view("<u4").astype(np.uint64)


def _word_messages(buckets: int) -> Callable:
    """The words of each batch and how often each occurs in what is learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Batch(row)
                counts = own.word_counts()
                yield from _sent((ASK, k, own.batch, [own.words[at], _short(counts[at])], None) for k, at in _by_bucket(_name(own.words) % np.uint64(buckets)))

    return run


def _pair_messages(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _Batch(row)
                u, w, _, counts = own.pairs()
                u, w = _name(own.words)[u], _name(own.words)[w]
                yield from _sent((ASK, k, own.batch, [_low48(u[at]), _low48(w[at]), _short(counts[at])], None) for k, at in _by_bucket(_pair_bucket(u, w, buckets)))

    return run


# --- seatings ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def _log_seatings(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t): the weight of all ways to seat c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        stay = out[c, 1 : c + 1] + np.log(c - discount * t)
        out[c + 1, 1] = stay[0]
        out[c + 1, 2 : c + 1] = np.logaddexp(out[c, 1:c], stay[1:])
        out[c + 1, c + 1] = out[c, c]
    return out


def tables(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """A draw of the number of tables of a word, given its customers, the other tables of its restaurant and the parent's probability of it.

    Exact up to ``EXACT`` customers: the weight of t tables is S(c, t) times the parent's probability to the t times the
    chances of t new tables.  Beyond, seatings of the customers one by one (in steps of a sixteenth once there are many)
    are drawn ``PARTICLES`` times and one is taken by its weight.
    """
    out = np.ones(len(customers), dtype=np.int64)
    log_parent = np.log(parent)
    for c, at in _by_bucket(np.where((customers >= 2) & (customers <= EXACT), customers, 0)):
        if not c:
            continue
        for lo in range(0, len(at), CELLS // c):
            part = at[lo : lo + CELLS // c]
            new = np.log(strength + discount * (others[part, None] + np.arange(c)))
            weight = _log_seatings(discount)[c, 1 : c + 1] + np.cumsum(new + log_parent[part, None], axis=1)
            out[part] = 1 + np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)
    many = np.flatnonzero(customers > EXACT)
    many = many[np.argsort(customers[many], kind="stable")]
    for lo in range(0, len(many), CELLS // PARTICLES):
        part = many[lo : lo + CELLS // PARTICLES]
        c, t, weight, seated = customers[part], np.ones((len(part), PARTICLES)), np.zeros((len(part), PARTICLES)), 1
        first = 0
        while first < len(part):
            step = max(1, seated // 16) if seated >= EXACT else 1
            own = slice(first, None)
            steps = np.minimum(step, c[own] - seated)[:, None]
            new = (strength + discount * (others[part[own], None] + t[own])) * parent[part[own], None]
            all_ways = np.maximum(seated - discount * t[own], 0) + new
            opened = rng.binomial(steps, np.minimum(new / all_ways, 1))
            weight[own] += steps * np.log(all_ways)
            t[own] += opened
            seated += step
            first = int(np.searchsorted(c, seated, side="right"))
        out[part] = t[np.arange(len(part)), np.argmax(weight + rng.gumbel(size=weight.shape), axis=1)]
    return out


# --- buckets ----------------------------------------------------------------------------------------------------------


def _rows(table: pa.Table, kind: int) -> list[dict]:
    found = table.filter(pc.equal(table.column("kind"), kind)).to_pylist()
    return sorted(found, key=lambda r: (r["other"] is not None, r["other"]))


def _asks(bucket: int, words: np.ndarray, u: np.ndarray, w: np.ndarray, excess: np.ndarray, buckets: int) -> list[tuple]:
    """What a pair bucket tells word buckets: customers that were not sent to the parent, by word and by context."""
    as_word, as_context = (np.bincount(x, weights=excess, minlength=len(words)).astype(np.int64) for x in (w, u))
    return [(ASK, k, bucket, [words[at], _short(as_word[at]), _short(as_context[at])], None) for k, at in _by_bucket(words % np.uint64(buckets))]


def _merged(word_buckets: int) -> Callable:
    """Counts of the pairs of a bucket; what is repeated is kept, with where each batch has it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, rows = key[0].as_py(), _rows(table, ASK)
        del table
        counts = [unpacked(r["c"]) for r in rows]
        edge = np.cumsum([0] + [len(c) for c in counts])
        u, w = (np.concatenate([_from48(unpacked(r[x])) for r in rows]) for x in "ab")
        local = np.concatenate(counts).astype(np.int64)
        same = sh.mix(u * np.uint64(0xD6E8FEB86659FD93) + w * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(same, kind="stable")
        begins = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
        of = np.empty(len(order), dtype=np.int64)
        of[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        total = np.add.reduceat(local[order], begins)
        asked = (total[of] >= 2) | (total[of] == 1) & (local == 0)
        slot = np.full(len(begins), -1, dtype=np.int64)
        held = np.unique(of[asked])
        slot[held] = np.arange(len(held))
        first = order[begins[held]]
        names, at = np.unique(np.concatenate([u[first], w[first]]), return_inverse=True)
        iu, iw = at[: len(first)], at[len(first) :]
        c, ones = total[held], np.ones(len(held), dtype="<i4")
        out = [(CORE, bucket, None, [names, _short(iu), _short(iw), _short(c), ones, ones * 0, np.zeros(len(names), "<i4")], None)]
        for k, row in enumerate(rows):
            mine = np.flatnonzero(asked[edge[k] : edge[k + 1]])
            if len(mine):
                out.append((REFS, bucket, row["other"], [_short(np.diff(mine, prepend=0)), _short(slot[of[edge[k] + mine]])], None))
        out += _asks(bucket, names, iu, iw, c - 1, word_buckets)
        out.append((STATS, bucket, None, [], [float((c - 1).sum()), float((total == 1).sum()), float((total == 2).sum())]))
        return _table(out)

    return run


def _counted(key: tuple, table: pa.Table) -> pa.Table:
    """Words of a bucket that are learned from, and how often they occur."""
    rows = _rows(table, ASK)
    words, at = np.unique(np.concatenate([unpacked(r["a"]) for r in rows]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([unpacked(r["b"]) for r in rows])).astype(np.int64)
    words, counts = words[counts > 0], counts[counts > 0]
    none = np.zeros(len(words), dtype="<f8")
    out = [(WORD, key[0].as_py(), None, [words, _short(counts), _short(counts), np.ones(len(words), "<i4"), none, none], None)]
    return _table([*out, (STATS, key[0].as_py(), None, [], [float(counts.sum()), float(len(words))])])


class Model(dict):
    """Numbers that all buckets share: tokens, words, excess, root_tables, discount, root_discount, strengths and the seed."""

    def root(self, customers: np.ndarray, seated: np.ndarray) -> np.ndarray:
        """The parent's probability of words with so many customers at so many tables."""
        own = THETA_ROOT + self["root_discount"] * self["root_tables"]
        return (np.maximum(customers - self["root_discount"] * seated, 0) + own / (self["words"] + 1)) / (THETA_ROOT + self["tokens"] - self["excess"])


def _words_swept(last: Model, now: Model, sweep: int) -> Callable:
    """Word buckets: what contexts sent to the parent, the parent's tables, and answers.

    ``last`` are the shared numbers of the sweep before, with which its sample is added where it is one of those averaged.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (row,), rows = _rows(table, WORD), _rows(table, ASK)
        words, counts, customers, seated, rate, backoff = (unpacked(row[c]) for c in "abcdef")
        if sweep - 1 > BURN:
            rate = rate + last.root(customers, seated) / SAMPLES
        names, counts = _name(words), counts.astype(np.int64)
        as_word, as_context = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        asked = [np.searchsorted(names, unpacked(r["a"])) for r in rows]
        for at, r in zip(asked, rows, strict=True):
            as_word[at] += unpacked(r["b"])
            as_context[at] += unpacked(r["c"])
        customers, inner = counts - as_word, counts - as_context
        if sweep > BURN:
            backoff = backoff + (THETA + now["discount"] * inner) / (THETA + counts) / SAMPLES
        if sweep:
            rng = np.random.default_rng([now["seed"], 1, key[0].as_py(), sweep])
            seated = tables(customers, np.maximum(now["root_tables"] - seated, 0), np.full(len(words), 1 / (now["words"] + 1)), now["root_discount"], THETA_ROOT, rng)
        out = [(WORD, key[0].as_py(), None, [words, _short(counts), _short(customers), _short(seated), rate, backoff], None)]
        out += [(REPLY, r["other"], key[0].as_py(), [_short(x[at]) for x in (customers, seated, inner, counts)], None) for at, r in zip(asked, rows, strict=True)]
        out.append((STATS, key[0].as_py(), None, [], [float(seated.sum()), float((customers == 1).sum()), float((customers == 2).sum())]))
        return _table(out)

    return run


def _pairs_swept(now: Model, sweep: int, word_buckets: int) -> Callable:
    """Pair buckets: a draw of the tables of each repeated pair, by the parent of the last sweep."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket, (row,) = key[0].as_py(), _rows(table, CORE)
        names, u, w, c, t, sums, _ = (unpacked(row[x]) for x in _ARRAYS)
        customers, seated, inner, counts = (np.zeros(len(names), dtype=np.int64) for _ in range(4))
        of = names % np.uint64(word_buckets)
        for r in _rows(table, REPLY):
            mine = of == r["other"]
            for into, x in zip((customers, seated, inner, counts), "abcd", strict=True):
                into[mine] = unpacked(r[x])
        rng = np.random.default_rng([now["seed"], 2, bucket, sweep])
        t = tables(c.astype(np.int64), np.maximum(inner[u] - t, 0), now.root(customers, seated)[w], now["discount"], THETA, rng)
        if sweep > BURN:
            sums = sums + t
        out = [(CORE, bucket, None, [names, u, w, c, _short(t), _short(sums), _short(counts)], None), *_asks(bucket, names, u, w, c - t, word_buckets)]
        return _table([*out, (STATS, bucket, None, [], [float((c - t).sum())])])

    return run


def _pair_answers(now: Model) -> Callable:
    """To each batch: the averaged share of its repeated pairs in their contexts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (row,) = _rows(table, CORE)
        _, u, _, c, _, sums, counts = (unpacked(row[x]) for x in _ARRAYS)
        share = ((c - now["discount"] * sums / SAMPLES) / (THETA + counts[u])).astype("<f4")
        return _table([(REFS, r["other"], key[0].as_py(), [unpacked(r["a"]), share[unpacked(r["b"])]], None) for r in _rows(table, REFS)])

    return run


def _word_answers(now: Model) -> Callable:
    """To each batch: counts, backoff and parent's probability of its words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (row,) = _rows(table, WORD)
        words, counts, customers, seated, rate, backoff = (unpacked(row[c]) for c in "abcdef")
        rate, backoff = (rate + now.root(customers, seated) / SAMPLES).astype("<f4"), backoff.astype("<f4")
        out = []
        for r in _rows(table, ASK):
            asked = unpacked(r["a"])
            at = np.minimum(np.searchsorted(words, asked), max(len(words) - 1, 0))
            known = words[at] == asked if len(words) else np.zeros(len(asked), dtype=bool)
            mine = [np.where(known, x[at], 0).astype(x.dtype) if len(words) else np.zeros(len(asked), x.dtype) for x in (counts, rate, backoff)]
            out.append((WORD, r["other"], key[0].as_py(), mine, None))
        return _table(out)

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(now: Model, word_buckets: int, pair_buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = table.to_pylist()
        own = _Batch(row)
        del table, row
        counts, rate, backoff = np.zeros(len(own.words), np.int64), np.zeros(len(own.words)), np.ones(len(own.words))
        of = dict(_by_bucket(_name(own.words) % np.uint64(word_buckets)))
        for r in _rows(answers, WORD):
            for into, x in zip((counts, rate, backoff), "abc", strict=True):
                into[of[r["other"]]] = unpacked(r[x])
        unknown = counts == 0
        rate[unknown], backoff[unknown] = now["unknown"], 1.0
        u, w, at, local = own.pairs()
        share = np.where(local > 0, (1 - now["discount"]) / (THETA + counts[u]), 0.0)  # of what is not repeated
        of = dict(_by_bucket(_pair_bucket(_name(own.words)[u], _name(own.words)[w], pair_buckets)))
        for r in _rows(answers, REFS):
            share[of[r["other"]][np.cumsum(unpacked(r["a"]))]] = unpacked(r["b"])
        log = np.log10(share + backoff[u] * rate[w])[at]
        base = np.log10((counts + 1) / (now["tokens"] + (now["words"] + 1)))[own.tokens]
        begins = np.cumsum(own.sizes) - own.sizes
        columns = [pa.array(own.ids, pa.int64()), pa.array(own.held), pa.array(own.sizes), pa.array(np.add.reduceat((counts > 0)[own.tokens].astype(np.int64), begins))]
        columns += [pa.array(np.full(len(own.sizes), int(now["tokens"]))), pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(log, begins))]
        return pa.table(columns, names=[f.split()[0] for f in _SCORES.split(", ")])

    return run


def _released(run: Callable) -> Callable:
    """``run`` of one group, or of two that meet; afterwards the worker holds no more memory than its result needs."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            release()

    def two(key: tuple, table: pa.Table, other: pa.Table) -> pa.Table:
        try:
            return run(key, table, other)
        finally:
            release()

    return two if run.__code__.co_argcount == 3 else one


def _discount(once: float, twice: float) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Tokens, known tokens, the base score and the model's log10 probability of every row of ``docs``.

    Documents whose CRC-32 of the id as text is 2 modulo 7 are held out; all others are learned from, whole.  A document's tokens go into batches
    as they were read; distinct words and pairs of a batch meet in buckets, and what scoring needs of them comes back to the batch.

    Null and empty texts are their end alone.  A null id counts as the empty text in the checksum.  Repeated rows are learned from and scored each.  A very long
    text is a batch of its own, hashed in slices.  Without anything to learn from the model is uniform over one unknown word.  An empty table gives an empty result.  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    work = Work(spark, "pitman")
    doc_id = F.col(id_col).cast("long")
    held = F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2
    source = docs.select(doc_id.alias("doc_id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    batches = work.keep(source.mapInArrow(tidy(_batched), _BATCHES), "batches")
    sizes = batches.select("sizes").mapInArrow(lambda rows: (pa.RecordBatch.from_arrays([pa.array([int(unpacked(s).sum()) for s in r.column(0).to_pylist()], pa.int64())], ["n"]) for r in rows), "n long")
    buckets = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // BUCKET))  # by the tokens alone: buckets send each other messages
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def step(rows: DataFrame, run: Callable, name: str) -> DataFrame:
        return work.keep(rows.repartition(parts, "key").groupBy("key").applyInArrow(_released(run), _MESSAGE), name)

    def stats(table: DataFrame, n: int) -> list[float]:
        found = table.where(F.col("kind") == STATS).agg(*[F.sum(F.col("n")[k]) for k in range(n)]).first()
        return [x or 0.0 for x in found]

    def of(table: DataFrame, *kinds: int) -> DataFrame:
        return table.where(F.col("kind").isin(*kinds))

    asks = batches.mapInArrow(tidy(_word_messages(buckets)), _MESSAGE)
    words = step(asks, _counted, "words")
    model = Model(seed=seed, discount=0.5, root_discount=0.5)
    model["tokens"], model["words"] = stats(words, 2)
    merged = step(batches.mapInArrow(tidy(_pair_messages(buckets)), _MESSAGE), _merged(buckets), "pairs")
    model["excess"], once, twice = stats(merged, 3)
    model["discount"], model["root_tables"] = _discount(once, twice), model["words"]
    pairs, unknown, last = merged, 0.0, model
    for sweep in range(BURN + SAMPLES + 1):
        if sweep:
            now = Model(model)
            swept = step(of(pairs, CORE).unionByName(of(words, REPLY)), _pairs_swept(now, sweep, buckets), "pairs")
            if pairs is not merged:
                work.drop(pairs)
            pairs, model = swept, Model(now)
            (model["excess"],) = stats(pairs, 1)
        swept = step(of(words, WORD).unionByName(of(pairs, ASK)), _words_swept(last, Model(model), sweep), "words")
        work.drop(words)
        words, model = swept, Model(model)
        model["root_tables"], once, twice = stats(words, 3)
        if not sweep:
            model["root_discount"] = _discount(once, twice)
        if sweep > BURN:
            unknown += float(model.root(np.zeros(1), np.zeros(1))[0]) / SAMPLES
        last = Model(model)
    model["unknown"] = unknown
    answers = step(of(merged, REFS).unionByName(of(pairs, CORE)), _pair_answers(model), "shares")
    work.drop(merged)
    more = step(of(words, WORD).unionByName(batches.mapInArrow(tidy(_word_messages(buckets)), _MESSAGE)), _word_answers(model), "rates")
    both = answers.unionByName(more).groupBy(F.col("key").alias("batch"))
    return batches.groupBy("batch").cogroup(both).applyInArrow(_released(_scored(model, buckets, buckets)), _SCORES)
