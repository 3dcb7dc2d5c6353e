"""Word and shingle fingerprints of many texts at once, in numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A word's
fingerprint is a polynomial in its bytes modulo 2**64, taken from prefix sums,
so the whole buffer costs a fixed number of vector operations and no Python
loop runs over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of text that are held as 64-bit lanes at one time.
CHUNK = 1 << 18

_U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, CHUNK + 1)
_DOWN = _powers(pow(_BASE, -1, 2**64), CHUNK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word of ``data`` (uint8), in bounded memory beside them."""
    starts, ends, before = [], [], True
    for lo in range(0, len(data), CHUNK):
        space = _SPACE[data[lo : lo + CHUNK]]
        edge = np.flatnonzero(space != np.append(before, space[:-1])) + lo
        opens = ~space[edge - lo]
        starts.append(edge[opens])
        ends.append(edge[~opens])
        before = bool(space[-1])
    if not before:
        ends.append(np.array([len(data)]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


def counts_before(table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of ``data`` before each position of ``at`` (ascending) are marked in ``table``, in bounded memory."""
    out, base = np.zeros(len(at), dtype=np.int64), 0
    for lo in range(0, len(data) + 1, CHUNK):
        run = np.concatenate(([0], np.cumsum(table[data[lo : lo + CHUNK]], dtype=np.int32)))
        a, b = np.searchsorted(at, [lo, lo + CHUNK])
        out[a:b] = base + run[at[a:b] - lo]
        base += int(run[-1])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of ``data[s:e]`` for sorted, disjoint spans, in bounded memory."""
    out = np.zeros(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        first = int(starts[k])
        stop = int(np.searchsorted(ends, first + CHUNK, side="right"))
        if stop <= k:  # one span longer than a chunk: fold its chunks together
            h = 0
            for at in range(first, int(ends[k]), CHUNK):
                part = data[at : min(at + CHUNK, int(ends[k]))]
                h = (h * int(_UP[len(part)]) * _BASE + int(np.sum(_BYTE[part] * _UP[: len(part)]))) % 2**64
            out[k] = h
            k += 1
            continue
        part = data[first : int(ends[stop - 1])]
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=run[1:])
        s, e = starts[k:stop] - first, ends[k:stop] - first
        out[k:stop] = (run[e] - run[s]) * _DOWN[s]
        k = stop
    return mix(out ^ ((ends - starts).astype(np.uint64) * _U64(_BASE)))


def hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``span_hashes`` of ``data`` for any spans, also ones that overlap; running sums are taken once where they fit a chunk."""
    if len(data) > CHUNK:
        return lambda starts, ends: span_hashes(data, starts, ends)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=run[1:])
    return lambda starts, ends: mix(((run[ends] - run[starts]) * _DOWN[starts]) ^ ((ends - starts).astype(np.uint64) * _U64(_BASE)))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of each run of ``n`` word fingerprints (``len(words) - n + 1`` of them).

    A rolling hash: differences of running sums of a polynomial in the words, so a window costs the same whatever its length.
    """
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(m, dtype=np.uint64)
    step = max(1, CHUNK - n)
    for lo in range(0, m, step):
        size = min(step, m - lo)
        part = words[lo : lo + size + n - 1]
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * _UP[: len(part)], out=run[1:])
        out[lo : lo + size] = (run[n:] - run[:-n]) * _DOWN[:size]
    return mix(out + _U64(n))


def batches(texts: list[bytes], size: int = 2 * CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` bytes each; a longer text is a range of its own."""
    lo = total = 0
    for k, t in enumerate(texts):
        if k > lo and total + len(t) > size:
            yield lo, k
            lo, total = k, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def shingle_sets(texts: list[bytes], n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, ASCII letters lower-cased.

    A text of fewer than ``n`` words gives its whole word sequence as one
    shingle; a text without words gives the empty set.
    """
    for lo, hi in batches(texts):
        joined = _LOWER[np.frombuffer(b"\n".join(texts[lo:hi]), dtype=np.uint8)]
        starts, ends = word_spans(joined)
        words = span_hashes(joined, starts, ends)
        edge = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        cut = np.searchsorted(starts, edge)
        every = window_hashes(words, n)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(every[a : b - n + 1])
            elif b > a:
                yield window_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)
