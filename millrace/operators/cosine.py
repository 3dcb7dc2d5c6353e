"""Exact nearest texts by the cosine of sparse rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranks import numbered
from millrace.tables import Work, scratch

NEIGHBOURS = 15
#: Rows of a block, about, and of a tile's side; sampled pivots at most; blocks whose bounds are sent to tasks at one time; rows and numbers of a product.
BLOCK, SIDE, PIVOTS, BOUNDS, TILE, NUMBERS = 8000, 16000, 256, 256, 1000, 4_000_000
#: Rows of a block that are looked at first, to find that two blocks must meet; blocks of a small table, about, as far as they do not get too small.
FIRST, FEWEST = 256, 16
#: How often a round of tiles sends each block, on average; blocks that any round may send.
COPIES, FEW = 2, 32
#: Similarities are rounded to so many digits; equal ones are ties.
DIGITS = 9


@dataclass
class Sparse:
    """Rows of (term, weight), as one list of entries cut by ``edge``."""

    edge: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(terms: pa.Array, weights: pa.Array) -> Sparse:
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        return Sparse(np.concatenate(([0], np.cumsum(sizes))), terms.flatten().to_numpy(), weights.flatten().to_numpy())

    def __len__(self) -> int:
        return len(self.edge) - 1

    def dense(self, terms: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Rows ``lo`` to ``hi`` over the given sorted terms."""
        hi = len(self) if hi is None else hi
        out = np.zeros((hi - lo, len(terms)))
        part = slice(self.edge[lo], self.edge[hi])
        at = np.minimum(np.searchsorted(terms, self.term[part]), max(len(terms) - 1, 0))
        row = np.repeat(np.arange(hi - lo), np.diff(self.edge[lo : hi + 1]))
        hit = terms[at] == self.term[part] if len(terms) else np.zeros(len(row), dtype=bool)
        out[row[hit], at[hit]] = self.weight[part][hit]
        return out

    def largest(self) -> tuple[np.ndarray, np.ndarray]:
        """All terms and the largest weight of each."""
        terms, at = np.unique(self.term, return_inverse=True)
        most = np.zeros(len(terms))
        np.maximum.at(most, at, self.weight)
        return terms, most


def bounds(rows: Sparse, blocks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each row and block (its terms, their largest weights) what no cosine with a row of the block exceeds.

    The smaller of two bounds: the row times the largest weights, and the length of the row's part on terms of
    the block, as rows of the block are no longer than 1.
    """
    out = np.zeros((len(rows), len(blocks)))
    begins = rows.edge[:-1]
    filled = np.diff(rows.edge) > 0
    for k, (terms, most) in enumerate(blocks):
        at = np.minimum(np.searchsorted(terms, rows.term), len(terms) - 1)
        hit = terms[at] == rows.term
        sums = [np.add.reduceat(x, begins[filled]) for x in (np.where(hit, rows.weight * most[at], 0), np.where(hit, rows.weight**2, 0))]
        out[filled, k] = np.minimum(sums[0], np.sqrt(sums[1]))
    return out


def _best(k: int, row: np.ndarray, other: np.ndarray, similarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` entries of each row of highest similarity, equal ones by ``other``, sorted by row."""
    order = np.lexsort((other, -similarity, row))
    row = row[order]
    use = np.arange(len(row)) - np.searchsorted(row, row) < k
    kept, order = row[use], order[use]
    return kept, other[order], similarity[order]


class _Near:
    """The nearest others found for the rows of a block, and the similarity that a further one has to reach."""

    def __init__(self, rows: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.zeros(rows) if floor is None else floor.copy()
        self.others, self.values = np.zeros((rows, k), np.int64), np.zeros((rows, k))  # a value of 0 is a free place

    row = property(lambda self: np.nonzero(self.values)[0])
    other = property(lambda self: self.others[self.values > 0])
    similarity = property(lambda self: self.values[self.values > 0])

    def add(self, row: np.ndarray, other: np.ndarray, similarity: np.ndarray) -> None:
        use = (similarity > 0) & (similarity >= self.floor[row])
        if not use.any():
            return
        mine = np.unique(row[use])
        held, (at, place) = self.values[mine], np.nonzero(self.values[mine])
        parts = (mine[at], row[use]), (self.others[mine][at, place], other[use]), (held[at, place], similarity[use])
        row, other, similarity = _best(self.k, *map(np.concatenate, parts))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.others[row, place], self.values[row, place] = other, similarity
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], similarity[last])


class _Block:
    """Rows of a block with their terms as codes of the block's own terms."""

    def __init__(self, rows: Sparse, cids: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None):
        """``known``: all terms and the largest weight of each, where the terms of ``rows`` are codes of them."""
        self.rows, self.cids = rows, cids
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(rows.edge))
        if known:
            (self.terms, self.most), self.code = known, rows.term
        else:
            self.terms, self.code = np.unique(rows.term, return_inverse=True)
            self.most = np.zeros(len(self.terms))
            np.maximum.at(self.most, self.code, rows.weight)

    @cached_property
    def uses(self) -> np.ndarray:
        """Rows that hold each term."""
        return np.bincount(self.code, minlength=len(self.terms))

    @cached_property
    def postings(self) -> tuple[list[np.ndarray], int]:
        """For each term the rows that hold it, each in the low bits of a number whose others are the weight as a part of their largest value; and the number of low bits."""
        order, edge = np.argsort(self.code, kind="stable"), np.cumsum(self.uses)[:-1]
        bits = max(1, (len(self.rows) - 1).bit_length())
        weight = np.minimum(np.rint(self.rows.weight * ((1 << 32 - bits) - 1)), (1 << 32 - bits) - 1).astype(np.uint32)
        return np.split((weight << np.uint32(bits) | self.row.astype(np.uint32))[order], edge), bits

    def reach(self, own: np.ndarray, most: np.ndarray, first: int | None = None) -> np.ndarray:
        """``bounds`` of each row, or of the ``first`` ones, in a block with which it shares the terms ``own``, whose largest weights are ``most``."""
        by_code = np.zeros(len(self.terms))
        by_code[own] = most
        rows = len(self.rows) if first is None else min(first, len(self.rows))
        part = slice(0, self.rows.edge[rows])
        weight, limit = self.rows.weight[part], by_code[self.code[part]]
        shared = np.flatnonzero(limit)
        row, weight = self.row[part][shared], weight[shared]
        sums = [np.bincount(row, x, minlength=rows) for x in (weight * limit[shared], weight * weight)]
        return np.minimum(sums[0], np.sqrt(sums[1]))

    def dense(self, column: np.ndarray, width: int, rows: np.ndarray) -> np.ndarray:
        """Some rows, in order, over ``width`` columns; ``column`` tells that of each code, -1 for none."""
        out = np.zeros((len(rows), width), np.float32)
        for lo in range(0, len(rows) if width else 0, TILE):
            mine = rows[lo : lo + TILE]
            first, last = mine[0], mine[-1] + 1
            part = slice(self.rows.edge[first], self.rows.edge[last])
            place = np.full(last - first, -1)
            place[mine - first] = np.arange(lo, lo + len(mine))
            row, at = place[self.row[part] - first], column[self.code[part]]
            hit = np.flatnonzero((row >= 0) & (at >= 0))
            out[row[hit], at[hit]] = self.rows.weight[part][hit]
        return out


def _reaching(value: np.ndarray, floor: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where values, each within ``slack`` of the truth, may be among the ``k`` highest of their row and reach its floor."""
    hit = value >= np.maximum(floor - slack, 1e-12)[:, None].astype(np.float32)
    if (many := np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * k)).size:
        least = np.partition(value[many], -k, axis=1)[:, -k]
        hit[many] &= value[many] >= (least - 2 * np.float32(slack))[:, None]
    return np.divmod(np.flatnonzero(hit), max(1, value.shape[1]))


#: Pairs whose cosines are computed in double precision at a time.
PAIRS = 256
#: Seconds, about, of a multiplication in a dense product and in lists of rows, of an entry of a dense part, and of opening a list: terms that
#: many rows hold are multiplied densely, the others by their lists.
DENSE_S, LIST_S, FILL_S, OPEN_S = 3.5e-11, 6e-9, 1e-9, 4e-7


def _split(uses: np.ndarray, others: np.ndarray, rows: int, other_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the shared terms are multiplied densely, and which by lists of rows: whatever takes less time by the rows that hold them."""
    gain = uses * (OPEN_S + others * LIST_S) - (rows * other_rows * DENSE_S + (rows + other_rows) * FILL_S)
    dense = np.flatnonzero(gain > 0)
    most = max(1, 2 * NUMBERS // max(1, rows, other_rows))
    if len(dense) > most:
        dense = np.sort(dense[np.argsort(-gain[dense], kind="stable")[:most]])
    return dense, np.setdiff1d(np.arange(len(gain)), dense, assume_unique=True)


def _exact(a: _Block, b: _Block, column: tuple[np.ndarray, np.ndarray, int], row: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, sorted by ``row``, in double precision; few at a time, which stay in a core's cache."""
    out, at_a, at_b = np.zeros(len(row)), column[0], column[1]
    table = np.zeros((PAIRS, max(1, column[2])))
    for lo in range(0, len(row), PAIRS):
        mine, place = np.unique(row[lo : lo + PAIRS], return_inverse=True)
        filled = []
        for r, line in zip(mine, table, strict=False):
            part = slice(a.rows.edge[r], a.rows.edge[r + 1])
            at, weight = at_a[a.code[part]], a.rows.weight[part]
            filled.append(at[at >= 0])
            line[filled[-1]] = weight[at >= 0]
        begin, end = b.rows.edge[other[lo : lo + PAIRS]], b.rows.edge[other[lo : lo + PAIRS] + 1]
        size = end - begin
        entry = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair, at = np.repeat(np.arange(len(size)), size), at_b[b.code[entry]]
        product = np.where(at >= 0, table[place[pair], at] * b.rows.weight[entry], 0.0)
        out[lo : lo + PAIRS] = np.bincount(pair, product, minlength=len(size))
        for line, at in zip(table, filled, strict=False):
            line[at] = 0
    return np.round(out, DIGITS)


def _multiplied(a: _Block, b: _Block, of_a: _Near, of_b: _Near | None, rows: np.ndarray, shared: tuple[np.ndarray, np.ndarray], done: np.ndarray | None = None) -> None:
    """Cosines of some rows of a block with all of another: sums in single precision tell what may count, which is computed in double precision.

    ``shared``: the codes of shared terms in either block; ``done``: rows of ``b`` that have met those of ``a`` already.
    ``of_b`` is None for a block with itself, where no row is its own neighbour.
    """
    used = a.uses[shared[0]] * (len(rows) / max(1, len(a.rows)))
    heads, tails = _split(used, b.uses[shared[1]], len(rows), len(b.rows))
    columns = [np.full(len(x.terms), -1) for x in (a, b)]
    every = [np.full(len(x.terms), -1) for x in (a, b)]
    for c, e, at in zip(columns, every, shared, strict=True):
        c[at[heads]] = np.arange(len(heads))
        e[at] = np.arange(len(at))
    y = b.dense(columns[1], len(heads), np.arange(len(b.rows))).T
    lists = np.full(len(a.terms), -1)
    lists[shared[0][tails]] = shared[1][tails]
    code = lists[a.code]
    listed = np.flatnonzero(code >= 0)
    edge, code, weight = np.searchsorted(listed, a.rows.edge), code[listed], a.rows.weight[listed]
    del listed
    times = b.uses[code]
    held, bits = b.postings if len(tails) else ([], 1)
    low, high, unit = np.uint32((1 << bits) - 1), np.uint32(bits), 1 / ((1 << 32 - bits) - 1)
    total = np.concatenate(([0.0], np.cumsum(weight)))[edge]
    weight = weight * unit
    # more than what rounding of rows of length 1, of their products and of weights in lists can add up to
    slack = (len(heads) + 4) * 2.0**-22 + 10.0**-DIGITS + unit * np.diff(total).max(initial=0.0)
    step = int(max(16, min(TILE, NUMBERS // max(len(b.rows), len(heads), 1))))
    for lo in range(0, len(rows), step):
        left = rows[lo : lo + step]
        value = a.dense(columns[0], len(heads), left) @ y
        for own, r in zip(value, left, strict=True):
            if (first := edge[r]) < (last := edge[r + 1]):
                entry = np.concatenate([held[c] for c in code[first:last].tolist()])
                own += np.bincount(entry & low, (entry >> high) * np.repeat(weight[first:last], times[first:last]), minlength=len(own))
        if of_b is None:
            value[np.arange(len(left)), left] = -1.0
        if done is not None:
            value[:, done] = -1.0
        i, j = _reaching(value, of_a.floor[left], of_a.k, slack)
        if of_b is not None:
            j2, i2 = _reaching(np.ascontiguousarray(value.T), of_b.floor, of_b.k, slack)
            i, j = np.divmod(np.union1d(i * len(b.rows) + j, i2 * len(b.rows) + j2), len(b.rows))
        exact = _exact(a, b, (*every, len(shared[0])), left[i], j)
        of_a.add(left[i], b.cids[j], exact)
        if of_b is not None:
            of_b.add(j, a.cids[left[i]], exact)


def _meet(a: _Block, b: _Block, of_a: _Near, of_b: _Near) -> None:
    """Two blocks: rows whose bound in the other block reaches what they have already, against all of the other."""
    _, at_a, at_b = np.intersect1d(a.terms, b.terms, assume_unique=True, return_indices=True)
    if len(b.rows) < len(a.rows):
        a, b, of_a, of_b, at_a, at_b = b, a, of_b, of_a, at_b, at_a
    need = [x.reach(own, y.most[other]) >= np.maximum(of.floor - 10.0**-DIGITS, 1e-300) for x, own, y, other, of in ((a, at_a, b, at_b, of_a), (b, at_b, a, at_a, of_b))]
    if need[0].mean() + need[1].mean() > 1 or need[0].all():  # then all rows meet about as soon
        need = [np.ones_like(need[0]), np.zeros_like(need[1])]
    if need[0].any():
        _multiplied(a, b, of_a, of_b, np.flatnonzero(need[0]), (at_a, at_b))
    if need[1].any():
        _multiplied(b, a, of_b, of_a, np.flatnonzero(need[1]), (at_b, at_a), np.flatnonzero(need[0]))


_FOUND = "cid long, other long, similarity double"
_BLOCK = "block long, cids binary, edge binary, code binary, weights binary, terms binary, bounds binary"
_NEAR = "block long, cids binary, row binary, other binary, similarity binary, floor binary"
#: Lists of numbers are kept as their bytes, which move faster than lists.
_KINDS = {"cids": np.int64, "edge": np.int64, "code": np.int32, "weights": np.float64, "terms": np.int64, "bounds": np.float64, "row": np.int32, "other": np.int64, "similarity": np.float64, "floor": np.float64}


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow or applyInArrow, after which a worker gives memory back: workers stay alive and would hold what the largest task needed."""

    def own(*given: object) -> Iterator:
        try:
            yield from run(*given)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not the GNU C library
                pass

    return own


def _table(schema: str, rows: list[list]) -> pa.Table:
    names = [f.split()[0] for f in schema.split(", ")]
    held = [[r[k] if name not in _KINDS else np.ascontiguousarray(r[k], _KINDS[name]).tobytes() for r in rows] for k, name in enumerate(names)]
    return pa.table([pa.array(x, pa.binary() if name in _KINDS else pa.int64()) for name, x in zip(names, held, strict=True)], names=names)


def _list(table: pa.Table, name: str, row: int) -> np.ndarray:
    return np.frombuffer(table.column(name)[row].as_buffer(), _KINDS[name])


def _block_of(table: pa.Table, row: int) -> _Block:
    rows = Sparse(*(_list(table, c, row) for c in ("edge", "code", "weights")))
    return _Block(rows, _list(table, "cids", row), (_list(table, "terms", row), _list(table, "bounds", row)))


def _gathered(key: tuple, table: pa.Table) -> pa.Table:
    """A block of its rows, in order of ``cid``."""
    table = table.sort_by("cid").combine_chunks()
    own = _Block(Sparse.of(table.column("t").combine_chunks(), table.column("w").combine_chunks()), table.column("cid").to_numpy())
    return _table(_BLOCK, [[key[0].as_py(), own.cids, own.rows.edge, own.code, own.rows.weight, own.terms, own.most]])


def _within(k: int):
    """The nearest others of each row inside its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for at in range(len(table)):
                own = _block_of(table, at)
                near, every = _Near(len(own.rows), k), np.arange(len(own.terms))
                _multiplied(own, own, near, None, np.arange(len(own.rows)), (every, every))
                yield from _table(_NEAR, [[table.column("block")[at].as_py(), own.cids, near.row, near.other, near.similarity, near.floor]]).to_batches()

    return run


def _wanted(blocks: list[tuple[int, np.ndarray, np.ndarray]]):
    """Pairs of blocks one of which has a row whose bound in the other reaches the k-th similarity it has already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, pairs = pa.Table.from_batches([batch]), []
            for at in range(len(table)):
                own, name, floor = _block_of(table, at), table.column("block")[at].as_py(), _list(table, "floor", at)
                need = np.maximum(floor - 10.0**-DIGITS, 1e-300)
                for block, terms, most in blocks:
                    if block == name:
                        continue
                    _, mine, other = np.intersect1d(own.terms, terms, assume_unique=True, return_indices=True)
                    if (own.reach(mine, most[other], FIRST) >= need[:FIRST]).any() or (own.reach(mine, most[other]) >= need).any():
                        pairs.append((min(name, block), max(name, block)))
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def _tile(k: int):
    """The pairs of blocks of each tile: for each of its blocks the others found that may be among the nearest."""

    def of_one(table: pa.Table) -> pa.Table:
        names, meets = table.column("block").to_pylist(), table.column("meets").to_pylist()
        filled = pc.is_valid(table.column("terms")).to_pylist()
        blocks = {names[at]: _block_of(table, at) for at in range(len(table)) if filled[at]}
        nears = {names[at]: _Near(len(blocks[names[at]].rows), k, _list(table, "floor", at)) for at in range(len(table)) if not filled[at]}
        pairs = sorted({(min(n, o), max(n, o)) for at, n in enumerate(names) if filled[at] for o in meets[at]})
        for a, b in pairs:
            _meet(blocks[a], blocks[b], nears[a], nears[b])
        return _table(_NEAR, [[n, blocks[n].cids, near.row, near.other, near.similarity, near.floor] for n, near in nears.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            del held
            tiles = table.column("tile").to_numpy()
            for tile in np.unique(tiles):
                yield from of_one(table.filter(pa.array(tiles == tile)) if len(np.unique(tiles)) > 1 else table).to_batches()

    return run


def _merged(k: int):
    """What was found for a block before and in the tiles of a round."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cids = _list(table, "cids", 0)
        near = _Near(len(cids), k)
        near.add(*(np.concatenate([_list(table, c, at) for at in range(len(table))]) for c in ("row", "other", "similarity")))
        return _table(_NEAR, [[key[0].as_py(), cids, near.row, near.other, near.similarity, near.floor]])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for at in range(len(table)):
            cids = _list(table, "cids", at)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cids[_list(table, "row", at)], _list(table, "other", at), _list(table, "similarity", at))], [f.split()[0] for f in _FOUND.split(", ")])


def _dealt(pivots: list[tuple[np.ndarray, np.ndarray]]):
    terms = np.unique(np.concatenate([t for t, _ in pivots])) if pivots else np.zeros(0, np.int64)
    matrix = np.zeros((len(terms), len(pivots)))
    for k, (t, w) in enumerate(pivots):
        matrix[np.searchsorted(terms, t), k] = w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Sparse.of(batch.column("t"), batch.column("w"))
            cell = [np.argmax(rows.dense(terms, lo, min(lo + FIRST, len(rows))) @ matrix, axis=1) for lo in range(0, len(rows), FIRST)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *cell]))], [*batch.schema.names, "cell"])

    return run


def _rounds(sizes: list[tuple[int, int]], pairs: list[tuple[int, int]], block: int) -> list[list[tuple[int, int, list[int]]]]:
    """Rounds of (block, tile, blocks it meets there): the pairs of blocks that each tile of two runs of neighbouring blocks holds.

    A run has about ``SIDE`` rows, so a block is sent once for each ``SIDE`` rows of those it meets; a round ends when it has
    sent every block ``COPIES`` times on average, so what it shuffles is in proportion to the table.
    """
    total, run_of, rows, run = sum(n for _, n in sizes), {}, 0, 0
    side = min(SIDE * block // BLOCK, max(block, total // 8))
    for name, n in sizes:
        if rows and rows + n > side:
            rows, run = 0, run + 1
        run_of[name], rows = run, rows + n
    runs, tiles = run + 1, {}
    for a, b in pairs:
        tiles.setdefault((run_of[a], run_of[b]), []).append((a, b))
    out, sent = [[]], 0
    # tiles of one sum of runs share no run, so they are spread evenly over the blocks
    for tile in sorted(tiles, key=lambda t: ((t[0] + t[1]) % runs, t)):
        meets: dict[int, list[int]] = {}
        for a, b in tiles[tile]:
            meets.setdefault(a, []).append(b)
            meets.setdefault(b, [])
        if sent and sent + len(meets) > max(COPIES * len(sizes), FEW):
            out, sent = [*out, []], 0
        out[-1] += [(name, tile[0] * runs + tile[1], other) for name, other in meets.items()]
        sent += len(meets)
    return [r for r in out if r]


def _each(rows: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """One part for each block: few blocks dealt by a hash would meet in some tasks."""
    place = F.broadcast(rows.sparkSession.createDataFrame([(name, at) for at, (name, _) in enumerate(sizes)], "block long, at int"))
    return rows.join(place, "block").repartitionById(max(1, len(sizes)), F.col("at")).drop("at")


def _between(work: Work, blocks: DataFrame, near: DataFrame, sizes: list[tuple[int, int]], k: int, block: int) -> DataFrame:
    """``near`` (what each block found inside itself) with what the other blocks hold, in rounds of tiles."""
    spark, wanted = work.spark, []
    for lo in range(0, len(sizes), BOUNDS):
        chunk = blocks.where(F.col("block").isin([name for name, _ in sizes[lo : lo + BOUNDS]])).select("block", "terms", "bounds").collect()
        sent = [(r.block, np.frombuffer(r.terms, np.int64), np.frombuffer(r.bounds)) for r in chunk]
        floors = near.select("block", "floor")
        wanted.append(work.keep(_each(blocks.join(floors, "block"), sizes).mapInArrow(lean(_wanted(sent)), "a long, b long"), "wanted"))
    pairs = sorted({(r.a, r.b) for kept in wanted for r in kept.distinct().collect()})
    kinds = [("cids", "binary"), ("edge", "binary"), ("code", "binary"), ("weights", "binary"), ("terms", "binary"), ("bounds", "binary")]
    for sends in _rounds(sizes, pairs, block):
        tiles = {tile: at for at, tile in enumerate(sorted({tile for _, tile, _ in sends}))}
        plan = F.broadcast(spark.createDataFrame([(name, tiles[tile], other) for name, tile, other in sends], "block long, tile int, meets array<long>"))
        rows = blocks.withColumn("floor", F.lit(None).cast("binary"))
        floors = near.select("block", *[F.lit(None).cast(t).alias(c) for c, t in kinds], "floor")
        dealt = rows.join(plan, "block").unionByName(floors.join(plan, "block")).repartitionById(len(tiles), F.col("tile"))  # a tile is much work on few bytes
        found = work.keep(dealt.mapInArrow(lean(_tile(k)), _NEAR), "found")
        merged = work.keep(near.unionByName(found).groupBy("block").applyInArrow(_merged(k), _NEAR), "near")
        work.drop(found, near)
        near = merged
    return near


def nearest_texts(rows: DataFrame, id_col: str = "doc_id", k: int = NEIGHBOURS, block: int = BLOCK, seed: int = 42, once: bool = False) -> DataFrame:
    """(uid, id, rank, other_uid, other, similarity): for every row of (id, terms, weights) the ``k`` others of highest cosine above 0.

    Exact, whatever the number of rows.  Equal rows are one class, of which the first ``k + 1`` members by id are kept, so a group of copies
    of any size is compared once.  Classes are dealt to blocks of about ``block`` near a sampled pivot (which costs time where it errs, never a
    neighbour).  Each block first finds its rows' neighbours inside it; the k-th similarity of a row is then the
    least that another block must offer.  Two blocks meet only where the bounds of one allow that to a row of the other, and there only such rows are multiplied,
    which keeps apart what shares few or light terms (languages, say).  Terms that many rows of two blocks hold are multiplied as dense parts, the others by lists of the rows that hold them.  Blocks meet in tiles, a bounded number of rows on either side; tiles are worked off in rounds, each of which
    shuffles the table a fixed number of times and keeps ``k`` others a row, so disk grows with the table, while time grows with the square of what bounds can't tell apart.

    Weights must be 0 or more, rows of length 1 at most, terms distinct in a row.  Equal similarities (to ``DIGITS`` digits) rank by id, then by place in the table. Null ids come last.
    Repeated rows are rows of their own and neighbours of each other; rows without terms have no neighbours and are none.  An empty table gives an
    empty result.  Other columns are ignored.  With ``once`` the working table that ``rows`` comes from (``kept_at``) is deleted when it has been read.
    """
    out = Work(rows.sparkSession, "neighbours")
    with scratch():
        return _nearest(out, rows, id_col, k, block, seed, once)


def _nearest(out: Work, rows: DataFrame, id_col: str, k: int, block: int, seed: int, once: bool) -> DataFrame:
    work = Work(rows.sparkSession, "cosine")
    entry = F.array_sort(F.arrays_zip(F.transform("terms", lambda x: F.xxhash64(x)).alias("t"), F.col("weights").alias("w")))
    own = rows.where(F.size("terms") > 0).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), entry.alias("v"))
    hashed = F.transform("v", lambda x: F.struct(x.t, F.round(x.w, DIGITS)))
    full = work.keep(own.withColumns({"h1": F.xxhash64(hashed), "h2": F.xxhash64(F.lit(seed), hashed)}), "rows")
    if once:
        work.drop(rows)
    own = out.keep(full.select("h1", "h2", "id", "uid"), "rows")
    first = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("id"), "uid")
    few = work.keep(own.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1), "members")
    # classes are named by their place by id, so ties go by name
    heads = out.keep(numbered(few.where("n = 1").select("h1", "h2", "id", "uid"), [F.asc_nulls_last("id"), F.col("uid")], "cid"), "heads")
    members = few.join(heads.select("h1", "h2", "cid"), ["h1", "h2"]).select("cid", "id", "uid")
    vectors = full.join(heads.select("uid", "cid"), "uid").select("cid", F.transform("v", lambda x: x.t).alias("t"), F.transform("v", lambda x: x.w).alias("w"))
    vectors = work.keep(vectors, "classes")
    work.drop(full)
    total = vectors.count()
    block = min(block, max(block // 4, -(-total // FEWEST)))
    want = max(1, min(PIVOTS, -(-total // block)))
    pivots = vectors.orderBy(F.xxhash64("cid", F.lit(seed)), "cid").limit(want).select("t", "w").collect()
    dealt = vectors.mapInArrow(lean(_dealt([(np.array(p.t), np.array(p.w)) for p in pivots])), "cid long, t array<long>, w array<double>, cell long")
    dealt = work.keep(dealt, "dealt")
    work.drop(vectors)
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    parted = dealt.join(F.broadcast(sizes), "cell").withColumn("block", F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("cid"), "parts"))
    blocks = work.keep(parted.select("block", "cid", "t", "w").groupBy("block").applyInArrow(_gathered, _BLOCK), "blocks")
    work.drop(dealt)
    sizes = [(r.block, r.n) for r in blocks.select("block", (F.octet_length("cids") / 8).cast("long").alias("n")).orderBy("block").collect()]
    near = work.keep(_each(blocks, sizes).mapInArrow(lean(_within(k)), _NEAR), "near")
    best = _between(work, blocks, near, sizes, k, block).select("cids", "row", "other", "similarity").mapInArrow(lean(_listed), _FOUND)
    best = work.keep(best, "best")
    work.drop(blocks)
    both = best.unionByName(heads.select("cid", F.col("cid").alias("other"), F.lit(1.0).alias("similarity")))
    listed = both.join(members.withColumnsRenamed({"cid": "other", "id": "other_id", "uid": "other_uid"}), "other")
    each = Window.partitionBy("cid").orderBy(F.desc("similarity"), F.asc_nulls_last("other_id"), "other_uid")
    listed = listed.withColumn("n", F.row_number().over(each)).where(F.col("n") <= k + 1)
    listed = out.keep(listed.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "other_id", "other_uid", "similarity"))).alias("near")), "near")
    of_row = own.join(heads.select("h1", "h2", "cid"), ["h1", "h2"]).join(listed, "cid")
    others = F.slice(F.filter("near", lambda x: x.other_uid != F.col("uid")), 1, k)
    spread = of_row.select("uid", F.col("id").alias(id_col), F.posexplode(others).alias("at", "x"))
    return spread.select("uid", id_col, (F.col("at") + 1).alias("rank"), F.col("x.other_uid").alias("other_uid"), F.col("x.other_id").alias("other"), F.col("x.similarity").alias("similarity"))
