"""Exact similarity join on word-shingle sets under the Jaccard distance.

The Jaccard distance is a metric.  Equal sets form one class and are compared once;
the classes are joined in two steps.

*Clouds.*  Unrelated texts lie at distance exactly 1 from each other and from any
document pivot, so Voronoi cells of a whole corpus would hold all of it in every
window.  Sets that may link are therefore first gathered by what they share: a
set of n shingles stands under its ``n - ceil(t * n) + 1`` first shingles in one common
order (rare ones first), and two sets within the radius meet under one of them.
Among those that meet, parity sketches give a lower bound of the symmetric difference
(a metric too); pairs that pass are joined into clouds, which hold whole components.

Where very many sets of one message stand under a shingle, leaders absorb sets of nearly
their sketch before anything is sent, and the region compares leaders only, with a
bound widened by the triangle inequality by what leaders may have absorbed.

*Voronoi regions.*  Every cloud, of two members or of thousands, is cut into regions of document
pivots, with windows of twice the radius and an outer region, recursively, until cells are small (``voronoi``);
both ends of each link meet in the home region of each, where they are compared exactly.
Clouds too large for one task are cut the same way as tables first.  A region that
windows do not thin, as its members all lie near each other, is compared in bounded blocks.

Links are counted with class sizes and never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as sh
from millrace.llm import voronoi as vo
from millrace.llm.work import BitTable, Work, components, fresh_name, release, routed, texts_of, tidy

#: Documents and prefix rows that a mapper packs into one message.
PACK_DOCS, PACK_ROWS = 60_000, 400_000
#: Shingles counted at one time, and in how many sets of those one must stand to count as common.
COUNTED, LEAST = 1_000_000, 4
#: Shingles that most documents contain, placed last in the common order.  Any
#: order gives the same links; this bounds the table that is sent to tasks.
MOST_COMMON = 500_000
#: Sets under one shingle in one message beyond which leaders absorb others; leaders that one message tries.
HOT, TRIES = 64, 2000
#: Share of its leader's size by which an absorbed set's may differ.
SLACK = 0.05
#: Bytes of packed rows for one reducer, about.
REDUCER_BYTES = 6 << 20
#: Members of a region that are compared as one; a larger one is compared by bands of sizes.
REGION = 4096
#: Members and shingles of a cloud that one task joins.
LEAF, LEAF_SHINGLES = 4096, 2_000_000
#: Pivots of a cut between tasks at most, and the share of a cloud that its largest region may keep.
PIVOTS, THIN = 64, 0.9


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sketches(s: np.ndarray) -> tuple[bytes, bytes]:
    """Parity of the number of members in each of several buckets (low bits of the fingerprint).

    One bit and more for each member tells sets within the radius from unrelated ones; two and more
    also do so for leaders, which are held against a wider bound.
    """
    bits = max(256, 1 << (len(s) - 1).bit_length())
    odd = (np.bincount((s & np.uint64(2 * bits - 1)).astype(np.int64), minlength=2 * bits) & 1).astype(bool)
    return tuple(np.packbits(x, bitorder="little").tobytes() for x in (odd[:bits] ^ odd[bits:], odd))


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


# ---------------------------------------------------------------- candidates


def _common(percent: int, n: int, most: int = COUNTED, least: int = LEAST) -> Callable:
    """Shingles that several sets contain, and the number of prefix rows."""

    def counted(flat: np.ndarray, rows: int) -> pa.RecordBatch:
        flat.sort()
        start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(flat)))
        often = count >= least
        columns = [np.append(flat[start[often]].view(np.int64), 0), np.append(count[often], rows), np.append(np.zeros(often.sum(), bool), True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "count", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, seen, size, rows = np.empty(most, dtype=np.uint64), set(), 0, 0
        for batch in batches:
            for s in sh.shingle_sets(texts_of(batch, "text"), n):
                key = _digest(s)
                if len(s) and key not in seen:
                    if size and size + len(s) > most:
                        yield counted(buffer[:size], rows)
                        seen, size, rows = set(), 0, 0
                    seen.add(key)
                    rows += _prefix(len(s), percent)
                    for at in range(0, len(s), most):
                        if size and at:
                            yield counted(buffer[:size], rows)
                            size, rows = 0, 0
                        piece = s[at : at + most]
                        buffer[size : size + len(piece)] = piece
                        size += len(piece)
        yield counted(buffer[:size], rows)

    return run


def _often(counts: DataFrame, most: int) -> np.ndarray:
    """The shingles of largest counts, most frequent last: all above the count beyond which there are at most ``most``."""
    step = F.floor(F.log2("count") * 8).cast("int")
    left, least = most, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= row["n"]
        if left < 0:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, dtype=np.uint64)
    few = counts.where(step >= least).select("shingle", "count").toPandas().sort_values(["count", "shingle"])
    return few["shingle"].to_numpy(dtype=np.int64).copy().view(np.uint64)


def leaders(groups: list[np.ndarray], sizes: np.ndarray, sketches: list[bytes], percent: int, most: int, tries: int = TRIES) -> np.ndarray:
    """For each set the one that stands for it in ``groups``: itself, or a leader that has absorbed it.

    A leader L absorbs sets of its sketch length with ``H <= c |L|`` and a size within
    SLACK of its own, H being the distance of sketches and ``c = (1 - t) / (1 + t)``.  Leaders are not
    absorbed.  Sets x, y within the radius have ``H(x, y) <= c (|x| + |y|)``, so their leaders have
    ``H <= c (2 + SLACK) (|L1| + |L2|)``, which is what ``_near`` holds them against.
    """
    lo, hi = 100 - percent, 100 + percent
    stands, leads, dull = np.arange(len(sizes)), np.zeros(len(sizes), dtype=bool), np.zeros(len(sizes), dtype=bool)
    length = np.array([len(x) for x in sketches])
    for group in sorted(groups, key=len, reverse=True):
        own = np.unique(stands[group])
        if len(own) <= most:
            continue
        for width in np.unique(length[own]).tolist():
            here = own[length[own] == width]
            lines = np.frombuffer(b"".join([sketches[k] for k in here.tolist()]), dtype=np.uint64).reshape(len(here), -1)
            free = ~leads[here]
            for at in np.lexsort((sizes[here], ~leads[here])).tolist():
                k = here[at]
                if dull[k] or stands[k] != k:
                    continue
                if not tries or not free.any():
                    break
                tries -= 1
                near = free & (np.abs(sizes[here] - sizes[k]) <= SLACK * sizes[k])
                near[near] = np.bitwise_count(lines[near] ^ lines[at]).sum(axis=1, dtype=np.int64) * hi <= sizes[k] * lo
                near[at] = False
                if near.any():
                    stands[here[near]] = k
                    leads[k] = True
                    free &= ~near
                    free[at] = False
                else:
                    dull[k] = not leads[k]
    return stands


def _packed(percent: int, n: int, common: np.ndarray, parts: int, most: int) -> Callable:
    """Document rows, messages of prefix rows for each reducer, and who absorbed whom."""
    order = np.argsort(common)
    sorted_common = common[order]

    def prefix(s: np.ndarray) -> np.ndarray:
        want = _prefix(len(s), percent)
        if not len(sorted_common):
            return s[:want]
        often = sorted_common[np.minimum(np.searchsorted(sorted_common, s), len(sorted_common) - 1)] == s
        rare = s[~often]
        if len(rare) >= want:
            return rare[:want]
        rest = s[often]
        rank = order[np.searchsorted(sorted_common, rest)]
        return np.concatenate((rare, rest[np.argsort(rank)[: want - len(rare)]]))

    class Message:
        """Documents from ``first`` on, and the prefixes of those whose set is new among them."""

        def __init__(self, base: int, first: int):
            self.base, self.first, self.docs, self.held, self.at, self.wide, self.rows = base, first, [], [], [], [], 0

        def add(self, doc: tuple, s: np.ndarray | None, wide: bytes | None) -> None:
            if s is not None:
                self.held.append(prefix(s))
                self.at.append(len(self.docs))
                self.wide.append(wide)
                self.rows += len(self.held[-1])
            self.docs.append(doc)

        def batches(self) -> Iterator[pa.RecordBatch]:
            wide: list[bytes | None] = [None] * len(self.docs)
            if self.held:
                yield from self._prefixes(wide)
            if self.docs:
                ids, h, sizes, keys, sketches = zip(*self.docs, strict=True)
                yield _rows(uid=self.base + self.first + np.arange(len(self.docs)), doc_id=ids, h=h, n=sizes, key=keys, sketch=sketches, wide=wide)

        def _prefixes(self, wide: list[bytes | None]) -> Iterator[pa.RecordBatch]:
            value = sh.mix(np.concatenate(self.held)) & ~np.uint64(0xFFFF)
            who = np.repeat(np.arange(len(self.held)), [len(x) for x in self.held])
            by = np.argsort(value, kind="stable")
            value, who = value[by], who[by]
            start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            count = np.diff(np.append(start, len(value)))
            hot = np.repeat(count > most, count)
            at = np.array(self.at, dtype=np.uint64)
            if hot.any():
                sizes = np.array([self.docs[k][2] for k in self.at])
                for k in np.unique(who[hot]).tolist():  # leaders are held against a wider bound, so they take wider sketches along
                    wide[self.at[k]] = self.wide[k]
                groups = [who[a : a + c] for a, c in zip(start[count > most].tolist(), count[count > most].tolist(), strict=True)]
                stands = leaders(groups, sizes, self.wide, percent, most)
                gone = np.flatnonzero(stands != np.arange(len(stands)))
                if len(gone):
                    gone = gone[np.argsort(stands[gone], kind="stable")]
                    edge = np.flatnonzero(np.append(True, stands[gone][1:] != stands[gone][:-1]))
                    stars = [np.append(at[stands[g[0]]], at[g]).astype(np.int64) + self.first for g in np.split(gone, edge[1:])]
                    yield _rows(star=[g + self.base for g in stars])
                hot_value, hot_who = value[hot], stands[who[hot]]
                by = np.lexsort((hot_who, hot_value))
                hot_value, hot_who = hot_value[by], hot_who[by]
                once = np.append(True, (hot_value[1:] != hot_value[:-1]) | (hot_who[1:] != hot_who[:-1]))
                value = np.concatenate((value[~hot], hot_value[once]))
                who = np.concatenate((who[~hot], hot_who[once]))
                hot = np.arange(len(value)) >= (~hot).sum()
            packed = value | at[who]
            for kind in (False, True):
                own = packed[hot == kind]
                if len(own):
                    part = ((own >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
                    by = np.argsort(part, kind="stable")
                    part, own = part[by], own[by]
                    start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                    yield _rows(part=part[start], message=[x.tobytes() for x in np.split(own, start[1:])], uid=np.full(len(start), self.base + self.first), hot=np.full(len(start), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        nth, message = 0, Message(base, 0)
        for batch in batches:
            seen = set()
            texts, ids, names = texts_of(batch, "text"), batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            for k, s in enumerate(sh.shingle_sets(texts, n)):
                size = len(s)
                if len(message.docs) >= PACK_DOCS or message.rows > PACK_ROWS:
                    yield from message.batches()
                    message = Message(base, nth)
                if not size:
                    message.add((ids[k], names[k], 0, None, None), None, None)
                else:
                    key = _digest(s)
                    sketch, wide = _sketches(s)
                    # a smaller set links with equal sets alone
                    new = 100 * size >= percent * (size + 1) and key not in seen
                    if new:
                        seen.add(key)
                    message.add((ids[k], names[k], size, key, sketch), s if new else None, wide)
                nth += 1
        yield from message.batches()

    return run


_FIELDS = [("part", pa.int64()), ("message", pa.binary()), ("hot", pa.bool_()), ("star", pa.list_(pa.int64())), ("uid", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary()), ("wide", pa.binary())]
_ROW = pa.schema(_FIELDS)
_PACKED = "part long, message binary, hot boolean, star array<long>, uid long, doc_id long, h long, n long, key binary, sketch binary, wide binary"


def _rows(**columns) -> pa.RecordBatch:
    size = max(len(v) for v in columns.values())
    return pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if f.name not in columns else (c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type)) for f in _ROW], schema=_ROW)


#: How members of a region are compared: as sets, as leaders, or not (a star of an absorbing leader).
PLAIN, LEADERS, STAR = 0, 1, 2


def _regions(most: int) -> Callable:
    """Members of each region with two or more, equal member lists once (as far as one reducer sees them)."""

    def run(table: pa.Table) -> pa.Table:
        size = sum(len(m) // 8 for m in (x.as_py() for x in table.column("message")))
        packed, who, hot = np.empty(size, np.uint64), np.empty(size, np.int64), np.empty(size, bool)
        done = 0
        for message, first, kind in zip(table.column("message"), table.column("uid"), table.column("hot"), strict=True):
            rows = np.frombuffer(message.as_py(), dtype=np.uint64)
            own = slice(done, done := done + len(rows))
            packed[own], who[own], hot[own] = rows >> np.uint64(16), (rows & np.uint64(0xFFFF)).astype(np.int64) + first.as_py(), kind.as_py()
        by = np.lexsort((who, packed))
        packed, who, hot = packed[by], who[by], hot[by]
        start = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if size else np.zeros(0, np.int64)
        count = np.diff(np.append(start, size))
        kind = ((count > most) | (np.add.reduceat(hot, start, dtype=np.int64) > 0)).astype(np.int64) if size else count
        # a list is named by two sums of hashed members; only lists that agree in both are one
        names = [np.add.reduceat(sh.mix(who.view(np.uint64) + np.uint64(salt)), start) if size else np.zeros(0, np.uint64) for salt in (1, 1 << 62)]
        names[0] = sh.mix(names[0] + kind.view(np.uint64))
        many = np.flatnonzero(count > 1)
        many = many[np.lexsort((names[1][many], names[0][many]))]
        new = np.append(True, (names[0][many][1:] != names[0][many][:-1]) | (names[1][many][1:] != names[1][many][:-1])) if len(many) else np.zeros(0, bool)
        many = many[new]
        edge = np.concatenate(([0], np.cumsum(count[many])))
        at = np.repeat(start[many] - edge[:-1], count[many]) + np.arange(edge[-1])
        members = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(who[at]))
        del packed, who, hot, by, at
        release()
        return pa.table({"region": pa.array(names[0][many].view(np.int64)), "other": pa.array(names[1][many].view(np.int64)), "kind": pa.array(kind[many].astype(np.int32)), "members": members})

    return run


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``by``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(by).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
        if held and keys[0] != held[-1].column(by)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    for table in _runs(batches, by):
        keys = table.column(by).to_numpy()
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(keys)], strict=True):
            yield table.slice(a, b - a)


def _fold(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def _near(sizes: np.ndarray, sketches: list[bytes], percent: int, kind: int = PLAIN) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j > i) that may be within the radius (or, of leaders, that may have absorbed such): by size, then by folded sketch.  ``sizes`` ascend."""
    lo, hi = 100 - percent, 100 + percent
    ratio = float(percent)
    if kind == LEADERS:
        lo, ratio = lo * (2 + SLACK), percent * (1 - SLACK) / (1 + SLACK) - 1e-9
    last = np.searchsorted(sizes * ratio, sizes * 100, side="right")  # ratio * larger <= 100 * smaller
    bits = [8 * len(x) for x in sketches]
    if len(sizes) <= 48:
        ints = [int.from_bytes(x, "little") for x in sketches]
        size = sizes.tolist()
        for i in range(len(size)):
            own, found = ints[i], []
            for j in range(i + 1, int(last[i])):
                other = ints[j] if bits[j] == bits[i] else _fold(ints[j], bits[j], bits[i])
                if (own ^ other).bit_count() * hi <= (size[i] + size[j]) * lo:
                    found.append(j)
            if found:
                yield i, np.array(found)
        return
    widths = sorted(set(bits))
    where = {w: [k for k, b in enumerate(bits) if b == w] for w in widths}  # runs, as bits grow with the size
    for w in widths:
        own = where[w]
        first, stop = own[0], int(last[own[-1]])
        words = np.array([np.frombuffer(sketches[k] if bits[k] == w else _fold(int.from_bytes(sketches[k], "little"), bits[k], w).to_bytes(w // 8, "little"), dtype=np.uint64) for k in range(first, stop)])
        for i in own:
            a, b = i + 1 - first, int(last[i]) - first
            if a < b:
                differ = np.bitwise_count(words[a:b] ^ words[i - first]).sum(axis=1, dtype=np.int64)
                found = np.flatnonzero(differ * hi <= (sizes[i + 1 : int(last[i])] + sizes[i]) * lo)
                if len(found):
                    yield i, found + i + 1


def _bands(regions: DataFrame, percent: int) -> DataFrame:
    """Regions of leaders by bands of sizes: a member stands in its band and the next, so those of like sizes meet."""
    step = float(np.log(1.001 * 100 / percent * (1 + SLACK) / (1 - SLACK)))
    band = F.floor(F.log("n") / F.lit(step)).cast("int")
    plain = regions.where(F.col("kind") != LEADERS)
    hot = regions.where(F.col("kind") == LEADERS).withColumn("band", F.explode(F.array(band, band + 1)))
    return plain.unionByName(hot.withColumn("region", F.xxhash64("region", "band")).drop("band"))


def _clouds(percent: int) -> Callable:
    def out(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches, "region"):
            node, at = np.unique(group.column("node").to_numpy(), return_index=True)
            kind = group.column("kind")[0].as_py()
            if len(node) < 2:
                continue
            if kind == STAR:
                a += [int(node[0])] * (len(node) - 1)
                b += node[1:].tolist()
            else:
                sizes = group.column("n").to_numpy()[at]
                by = np.argsort(sizes, kind="stable")
                rank = node[by]
                sketch = group.column("sketch").take(pa.array(at[by])).to_pylist()
                forest = vo.Forest(len(rank))
                for i, found in _near(sizes[by], sketch, percent, kind):
                    joined = forest.join(i, found)
                    a += [int(rank[i])] * len(joined)
                    b += rank[joined].tolist()
            if len(a) > 50_000:
                yield out(a, b)
                a, b = [], []
        yield out(a, b)

    return run


# ------------------------------------------------------------ Voronoi regions


def _fetch(n: int, table: BitTable) -> Callable:
    """Sets of the documents that may stand for a class in a cloud."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            asked = np.flatnonzero(table.has(h))
            few = batch.take(pa.array(asked))
            keys, sets, names, size = [], [], [], 0
            for name, s in zip(h[asked].tolist(), sh.shingle_sets(texts_of(few, "text"), n), strict=True):
                if len(s):
                    keys.append(_digest(s))
                    sets.append(s.tobytes())
                    names.append(name)
                    size += len(sets[-1])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["h", "key", "set"])
                        keys, sets, names, size = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["h", "key", "set"])

    return run


_LINKS = "a long, b long, component long, links long"
_NONE = np.iinfo(np.int64).max


def _join(percent: int, cell: int) -> Callable:
    """Links of each cloud by Voronoi regions.

    Of a whole cloud: (a, component, links) for each member with links, the component named by its
    smallest document.  Of a part of a cut one: (a, b) edges that join its components, and (a, links)
    for members at home.  ``side`` is 0 or 1 in a pair of blocks, where only pairs of both sides count.
    """

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b", "component", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group in _groups(batches, "cloud"):
            node, at = np.unique(group.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("set").take(pa.array(at)).to_pylist()]
            weight = group.column("w").to_numpy()[at]
            if not group.column("cut")[0].as_py():
                root, total = vo.links_of(sets, percent, weight, cell)
                least = np.full(len(node), _NONE)
                np.minimum.at(least, root, group.column("least").fill_null(_NONE).to_numpy()[at])
                for k in np.flatnonzero(total).tolist():
                    name = int(least[root[k]])
                    rows.append((int(node[k]), None, None if name == _NONE else name, int(total[k])))
            else:
                home = group.column("home").to_numpy()[at]
                side = group.column("side").fill_null(-1).to_numpy()[at]
                total, forest = np.zeros(len(node), dtype=np.int64), vo.Forest(len(node))
                for i, found, at_home, own in vo.linked(sets, percent, cell):
                    other = (side[found] != side[i]) | (side[i] < 0)
                    found, at_home = found[other], at_home[other]
                    total[i] += weight[found].sum() if own else 0
                    total[found[at_home]] += weight[i]
                    rows += [(int(node[i]), int(node[j]), None, None) for j in forest.join(i, found).tolist()]
                rows += [(int(node[k]), None, None, int(total[k])) for k in np.flatnonzero(home & (total > 0)).tolist()]
            if len(rows) > 50_000:
                yield out(rows)
                rows = []
        yield out(rows)

    return run


_MEMBER = ["cloud", "cut", "home", "node", "w", "least", "n", "set", "side"]


def _voronoi(percent: int) -> Callable:
    """A row for each region that a member belongs to: its home, and those whose window holds it.

    Rows come sorted by (cloud, chunk), the pivots of the cloud before its members.
    """

    def near(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
        """Distances, pivot by member."""
        every, place = np.unique(np.concatenate(pivots), return_inverse=True)
        holds = np.zeros((len(every), len(pivots)), dtype=np.uint8)
        holds[place, np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])] = 1
        both = np.zeros((len(pivots), len(sets)), dtype=np.int64)
        for k, s in enumerate(sets):
            where = np.minimum(np.searchsorted(every, s), len(every) - 1)
            both[:, k] = holds[where[every[where] == s]].sum(axis=0, dtype=np.int64)
        return 1.0 - both / (np.array([len(p) for p in pivots])[:, None] + np.array([len(s) for s in sets]) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots = None, []
        for batch in batches:
            cloud, chunk, is_pivot = batch.column("cloud").to_numpy(), batch.column("chunk").to_numpy(), batch.column("pivot").to_numpy(zero_copy_only=False)
            name = np.stack((cloud, chunk, is_pivot))
            start = np.flatnonzero(np.append(True, (name[:, 1:] != name[:, :-1]).any(axis=0))) if batch.num_rows else []
            for a, b in zip(start, [*start[1:], batch.num_rows], strict=True):
                sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("set").slice(a, b - a).to_pylist()]
                if (cloud[a], chunk[a]) != now:
                    now, pivots = (cloud[a], chunk[a]), []
                if is_pivot[a]:
                    pivots += sets
                    continue
                if pivots:
                    home, inside = vo.windows(near(sets, pivots), percent)
                else:
                    home, inside = np.zeros(len(sets), np.int64), np.ones((1, len(sets)), bool)
                region, take = np.nonzero(inside)
                kept = batch.select(["node", "w", "least", "n", "set", "side"]).slice(a, b - a).take(pa.array(take))
                was = batch.column("home").slice(a, b - a).to_numpy(zero_copy_only=False)[take]
                names = sh.mix(np.full(len(take), cloud[a]).view(np.uint64) * np.uint64(31) + region.astype(np.uint64)).view(np.int64)
                columns = [pa.array(names), pa.array(np.ones(len(take), bool)), pa.array((home[take] == region) & was), *kept.columns, pa.array(np.full(len(take), cloud[a]))]
                yield pa.RecordBatch.from_arrays(columns, [*_MEMBER, "parent"])

    return run


def _resolved(work: Work, members: DataFrame, percent: int, leaf: int, leaf_shingles: int, cell: int) -> tuple[DataFrame, list[DataFrame], bool]:
    """Rows of ``_join`` for all clouds, the tables they read, and whether any was cut between tasks."""
    ready, kept, depth = [], [], 0
    while True:
        size = members.groupBy("cloud").agg(F.count("*").alias("many"), F.sum("n").alias("mass"))
        share = F.greatest(F.col("many") / leaf, F.col("mass") / leaf_shingles)
        large = work.keep(size.where(share > 1).withColumn("share", share), "large")
        kept.append(large)
        if not large.head(1):
            ready.append(members)
            break
        ready.append(members.join(large.select("cloud"), "cloud", "left_anti"))
        rest = members.join(large, "cloud")
        # the pivots are members of lowest hash: about two for each leaf that the cloud fills
        chunks = F.ceil("share").cast("int")
        want = F.least(F.lit(float(PIVOTS)), F.greatest(F.lit(2.0), F.ceil(2 * F.col("share")).cast("double")))
        order = F.xxhash64("node", F.lit(depth))
        cut = (want * 4 + 16) / F.col("many") * F.lit(2.0**64) - F.lit(2.0**63)
        few = rest.where(order.cast("double") <= cut).groupBy("cloud", "share").agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("order"), "n", "set"))), 1, F.max(want).cast("int")).alias("p"))
        few = few.select("cloud", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.explode("p").alias("p")).select("cloud", "chunk", F.lit(True).alias("pivot"), "p.n", "p.set")
        own = rest.select(*_MEMBER, F.pmod(F.xxhash64("node", F.lit("chunk")), chunks).cast("int").alias("chunk"), F.lit(False).alias("pivot"))
        both = own.unionByName(few, allowMissingColumns=True).repartition("cloud", "chunk").sortWithinPartitions("cloud", "chunk", F.desc("pivot"))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.select(*_MEMBER).schema)
        pieces = work.keep(both.mapInArrow(tidy(_voronoi(percent)), f"{fields}, parent long"), "voronoi")
        kept.append(pieces)
        # of a region without members at home nothing is asked
        now = pieces.groupBy("parent", "cloud").agg(F.count("*").alias("size"), F.max("home").alias("held")).where("held")
        grown = now.groupBy("parent").agg(F.max("size").alias("size"))
        stuck = work.keep(large.join(grown, large.cloud == grown.parent, "left").where(F.col("size").isNull() | (F.col("size") > THIN * F.col("many"))).select("cloud", "share"), "stuck")
        pieces = pieces.join(now.select("cloud"), "cloud", "left_semi").join(stuck.select(F.col("cloud").alias("parent")), "parent", "left_anti").drop("parent")
        # where windows do not thin, members lie near each other: pairs of blocks
        blocks = rest.select(*_MEMBER).join(stuck, "cloud")
        many = F.ceil(2 * F.col("share")).cast("int")
        mine = F.pmod(F.xxhash64("node", F.lit("block")), many).cast("int")
        blocks = blocks.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
        name = F.xxhash64("cloud", F.least("mine", "other"), F.greatest("mine", "other"))
        side = F.when(F.col("mine") != F.col("other"), (F.col("mine") > F.col("other")).cast("int"))
        ready.append(blocks.withColumns({"side": side, "cloud": name, "cut": F.lit(True)}).select(*_MEMBER))
        kept += [stuck, members := work.keep(pieces.select(*_MEMBER), "members")]
        depth += 1
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out.repartition("cloud").sortWithinPartitions("cloud").mapInArrow(tidy(_join(percent, cell)), _LINKS), kept, depth > 0


def row_name(id_col: str, text_col: str) -> F.Column:
    """64 bits of a row's id and text."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.col(text_col).cast("string"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, leaf: int = LEAF, leaf_shingles: int = LEAF_SHINGLES, region: int = REGION, hot: int = HOT, cell: int = vo.CELL, row_hash: bool = False
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``; with ``row_hash`` also ``row_name`` of the row.

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of
    distinct ``words``-word shingles, ASCII letters lower-cased.  component_id is
    the smallest id reachable by links, n_links the number of other rows linked.

    Fewer words than ``words``: the whole sequence is the only shingle.  Null or
    empty text, or white space alone: empty set, no links, its own component.
    Very long texts are read in chunks; their sets are held one at a time.
    Null ids: the row is reported; its component_id is the smallest id known in
    its component, null if none is.  Repeated rows link with each other.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    work = Work(docs.sparkSession, "jaccard")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = source.select("doc_id", row_name("doc_id", "text").alias("h"), "text")

    counts = work.keep(source.select("text").mapInArrow(tidy(_common(percent, words)), "shingle long, count long, total boolean").groupBy("shingle", "total").agg(F.sum("count").alias("count")), "common")
    rows = counts.where("total").agg(F.sum("count")).first()[0] or 0
    common = _often(counts.where("not total"), MOST_COMMON)
    parts = max(1, -(-8 * rows // REDUCER_BYTES))

    first = work.keep(named.mapInArrow(tidy(_packed(percent, words, common, parts, hot)), _PACKED), "packed")
    work.drop(counts)
    every = first.where("n > 0")
    empty = work.keep(first.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("h").alias("row_name")), "empty")
    # kept, so that a class of very many equal sets is a skewed join of plain tables
    classes = work.keep(every.groupBy("key").agg(F.min(F.struct("uid", "h")).alias("node"), F.count("*").alias("w"), F.min("doc_id").alias("least")).select("key", "node.uid", "node.h", "w", "least"), "classes")
    heads = classes.select("key", F.col("uid").alias("node"), F.col("h").alias("node_h"), "w", "least")
    known = work.keep(every.select("uid", "doc_id", F.col("h").alias("row_name"), "n", "key", "sketch", "wide").join(heads, "key"), "known")

    found = first.where("part is not null").select("part", "message", "hot", "uid").groupBy("part").applyInArrow(_regions(region), "region long, other long, kind int, members array<long>")
    stars = first.where("star is not null").select(F.xxhash64("star").alias("region"), F.xxhash64("star", F.lit(1)).alias("other"), F.lit(STAR).alias("kind"), F.col("star").alias("members"))
    regions = found.unionByName(stars).dropDuplicates(["region", "other"]).select("region", "kind", F.explode("members").alias("uid"))
    regions = work.keep(regions, "regions")
    work.drop(first)
    sketch = F.when(F.col("kind") == LEADERS, F.coalesce("wide", "sketch")).when(F.col("kind") == PLAIN, F.col("sketch")).alias("sketch")
    placed = _bands(regions.join(known.select("uid", "node", "n", "sketch", "wide"), "uid").select("region", "kind", "node", "n", sketch), percent)
    edges = work.keep(placed.repartition("region").sortWithinPartitions("region").mapInArrow(tidy(_clouds(percent)), "a long, b long"), "cloud-edges")
    work.drop(regions)

    clouds = components(work, edges)
    work.drop(edges)
    head = known.where("uid = node").select("node", "key", F.col("node_h").alias("h"), "w", "least", "n")
    wanted = work.keep(clouds.select("node", F.col("root").alias("cloud")).join(head, "node"), "wanted")
    work.drop(clouds)
    sets = named.mapInArrow(tidy(_fetch(words, BitTable(wanted, "h"))), "h long, key binary, set binary")
    members = sets.join(wanted, ["h", "key"]).withColumns({"cut": F.lit(False), "home": F.lit(True), "side": F.lit(None).cast("int")}).select(*_MEMBER)
    members = work.keep(members, "members")
    work.drop(wanted)

    joined, read, cut = _resolved(work, members, percent, leaf, leaf_shingles, cell)
    result = work.keep(joined, "links")
    work.drop(members, *read)
    whole = result.where("links is not null").select(F.col("a").alias("node"), "component", "links")
    if cut:
        found = components(work, result.where("b is not null").select("a", "b"))
        roots = work.keep(found.join(classes.select(F.col("uid").alias("node"), "least"), "node"), "roots")
        work.drop(found)
        lowest = roots.groupBy("root").agg(F.min("least").alias("lowest"))
        by_root = roots.join(lowest, "root").select("node", "lowest")
        whole = whole.groupBy("node").agg(F.min("component").alias("component"), F.sum("links").alias("links"))
        whole = whole.join(by_root, "node", "left").select("node", F.coalesce("component", "lowest").alias("component"), "links")
    named_ = work.keep(whole, "named")
    work.drop(result, classes, *([roots] if cut else []))
    full = known.select("doc_id", "row_name", "n", "node", "w", "least").join(named_, "node", "left")
    full = full.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "least").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"),
        "row_name",
    )
    out = full.unionByName(empty)
    return out if row_hash else out.drop("row_name")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component those with its smallest id.

    Rows are dropped one by one, so an id that stands on rows of different texts loses only the rows that
    are near a smaller one.  Rows without an id and rows without words stay.  An empty table gives an
    empty one; all columns are kept, whatever their names.
    """
    work = Work(docs.sparkSession, "near")
    found = jaccard_components(docs, id_col, text_col, row_hash=True)
    id_name, name = fresh_name(docs, "gone_id"), fresh_name(docs, "gone_name")
    gone = work.keep(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_name), F.col("row_name").alias(name)), "gone")
    asked, rest = routed(docs, row_name(id_col, text_col), gone, name)
    return rest.unionByName(asked.join(gone, (F.col(id_col).cast("long") == F.col(id_name)) & (row_name(id_col, text_col) == F.col(name)), "left_anti"))


def oracle(words: int = 5, percent: int = 80) -> str:
    """The same as SQL, by plain self-join and closure; for small tables whose ids are unique."""
    return rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        place AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS p FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + {words - 1}], ' ') AS shingle FROM place),
        size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
        link AS (SELECT a, b FROM shared JOIN size na ON na.doc_id = a JOIN size nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
        reach(node, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, link.b FROM reach r JOIN link ON link.a = r.other),
        root AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
        degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, root.component_id, coalesce(degree.n, 0) AS n_links
        FROM d JOIN root ON root.node = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN degree ON degree.a = d.doc_id
    """
