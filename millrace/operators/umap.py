"""A seeded two-dimensional map of sparse rows by their neighbour graph (UMAP), in bulk-synchronous rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.cosine import DIGITS, lean, nearest_texts
from millrace.tables import Work

NEIGHBOURS, CLOSE, SEED = 15, 0.12, 42
#: Vectors and rounds of the spectral start; rounds of the map; points that each point is pushed from in a round; pushes for each pull.
WIDTH, STARTS, ROUNDS, SAMPLE, PUSHES = 6, 5, 24, 256, 5
#: Halvings of the local scale, and the largest step of a coordinate by one pull or push.
HALVINGS, STEP = 64, 4.0


def curve(close: float = CLOSE, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + a d^2b) is nearest to 1 up to ``close`` and falling as exp((close - d) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < close, 1.0, np.exp((close - d) / spread))
    a, b = 1.0, 1.0
    error = lambda a, b: float(((1 / (1 + a * d ** (2 * b)) - want) ** 2).sum())
    step = 0.5
    while step > 1e-6:  # pattern search: a smooth function of two numbers
        best = min(((a + i * step, b + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1) if a + i * step > 0 and b + j * step > 0), key=lambda x: error(*x))
        if best == (a, b):
            step /= 2
        a, b = best
    return a, b


def scales(distance: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, scale) of each row of distances (NaN where there are fewer): memberships exp(-(d - nearest) / scale) sum to log2 k."""
    nearest = np.nanmin(np.where(distance > 0, distance, np.nan), axis=1, initial=np.inf)
    nearest = np.where(np.isfinite(nearest), nearest, 0.0)
    gap = np.maximum(distance - nearest[:, None], 0)
    lo, hi, mid = np.zeros(len(distance)), np.full(len(distance), np.inf), np.ones(len(distance))
    for _ in range(HALVINGS):
        over = np.nansum(np.exp(-gap / mid[:, None]), axis=1) > np.log2(k)
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)
        mid = np.where(np.isinf(hi), mid * 2, (lo + hi) / 2)
    mean = np.nanmean(distance, axis=1)
    return nearest, np.maximum(np.minimum(mid, 1e3), 1e-3 * np.where(mean > 0, mean, 1.0))


def _memberships(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            others, far = batch.column("others").to_pylist(), batch.column("far").to_pylist()
            d = np.full((len(far), k), np.nan)
            for row, own in zip(d, far, strict=True):
                row[: len(own)] = own
            nearest, scale = scales(d, k)
            w = np.exp(-np.maximum(d - nearest[:, None], 0) / scale[:, None])
            row, at = np.nonzero(~np.isnan(d))
            values = [pa.array(batch.column("i").to_numpy()[row]), pa.array([others[r][c] for r, c in zip(row, at, strict=True)], pa.int64()), pa.array(w[row, at])]
            yield pa.RecordBatch.from_arrays(values, ["i", "j", "w"])

    return run


def fuzzy_graph(near: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(i, j, w) of both directions of every link of (uid, other_uid, rank, similarity), by fuzzy union of the memberships of its two ends."""
    listed = near.groupBy(F.col("uid").alias("i")).agg(F.array_sort(F.collect_list(F.struct("rank", "other_uid", (1 - F.col("similarity")).alias("far")))).alias("n"))
    own = listed.select("i", F.transform("n", lambda x: x.other_uid).alias("others"), F.transform("n", lambda x: F.greatest(x.far, F.lit(0.0))).alias("far"))
    one = own.mapInArrow(lean(_memberships(k)), "i long, j long, w double")
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    s, q = F.sum("w"), F.sum(F.col("w") * F.col("w"))
    return both.groupBy("i", "j").agg((s - (s * s - q) / 2).alias("w"))  # a + b - ab; of one alone itself


#: Points of a part, about.
PART = 8192
_LINKED = "part int, ids binary, row binary, at binary, w binary, targets binary, edge binary, out binary, degree double, most double"
_SENT = "part int, source int, values binary, told binary"


def _linked(key: tuple, table: pa.Table) -> pa.Table:
    """The links of a part's points as lists: the point of each link by its place in the part, the other end by its place among what other parts send, and what the part sends to each."""
    i, j, w, other = (table.column(c).to_numpy() for c in ("i", "j", "w", "other"))
    ids, row = np.unique(i, return_inverse=True)
    order = np.lexsort((j, other))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(other[order]) != 0) | (np.diff(j[order]) != 0)
    at = np.empty(len(order), np.int32)
    at[order] = np.cumsum(new) - 1
    # links have both directions, so the points that another part needs are those that have a link to it, in its order
    pair = np.unique(other.astype(np.int64) * len(ids) + row)
    targets, first = np.unique(pair // len(ids), return_index=True)
    held = (ids.astype(np.int64), row.astype(np.int32), at, w, targets.astype(np.int32), np.append(first, len(pair)).astype(np.int32), (pair % len(ids)).astype(np.int32))
    kinds = _LINKED.split(", ")
    values = [[key[0].as_py()], *[[x.tobytes()] for x in held], [float(w.sum())], [float(w.max())]]
    return pa.table([pa.array(v, pa.binary() if "binary" in kind else pa.float64() if "double" in kind else pa.int32()) for v, kind in zip(values, kinds, strict=True)], names=[x.split()[0] for x in kinds])


class _Part:
    """The points of a part with their links, what they hold (a row of numbers for each), and what other parts have sent."""

    def __init__(self, linked: dict, sent: list[tuple[int, bytes]]):
        self.part, kinds = linked["part"], {"ids": np.int64, "row": np.int32, "at": np.int32, "w": np.float64, "targets": np.int32, "edge": np.int32, "out": np.int32}
        self.ids, self.row, self.at, self.w, self.targets, self.edge, self.out = (np.frombuffer(linked[c], kind) for c, kind in kinds.items())
        by_source = {source: values for source, values in sent}
        own = by_source.pop(-1, b"")
        self.own = np.frombuffer(own).reshape(len(self.ids), -1)
        self.inbox = np.frombuffer(b"".join(by_source[n] for n in sorted(by_source))).reshape(-1, max(1, self.own.shape[1]))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """For each point the sum of a number of each of its links."""
        return np.bincount(self.row, values, minlength=len(self.ids))

    def random(self, seed: int) -> np.ndarray:
        """A number from 0 to 1 for each point, by its id."""
        x = self.ids.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) / 2.0**64

    def sends(self, values: np.ndarray, told: np.ndarray, last: bool = False) -> pa.RecordBatch:
        """What the points hold now, what the driver is told, and what goes to other parts."""
        values = np.ascontiguousarray(values)
        rows = [(self.part, -1, values.tobytes(), np.ascontiguousarray(told, float).tobytes())]
        if not last:
            rows += [(int(t), self.part, values[self.out[lo:hi]].tobytes(), None) for t, lo, hi in zip(self.targets, self.edge, self.edge[1:], strict=False)]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], [f.split()[0] for f in _SENT.split(", ")])


class _Rounds:
    """Points in parts, worked on in rounds: a part gets what other parts sent to it, and sends anew."""

    def __init__(self, work: Work, graph: DataFrame, points: int):
        parts = max(1, -(-points // PART))
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
        own = graph.select(of("i").alias("part"), "i", "j", "w", of("j").alias("other"))
        self.work, self.points, self.parts, self.sent, self.sample = work, points, parts, None, np.zeros((0, 2))
        self.linked = work.keep(own.groupBy("part").applyInArrow(_linked, _LINKED), "parts")
        self.total, self.most = self.linked.agg(F.sum("degree"), F.max("most")).first()

    def _run(self, step: Callable[[_Part], pa.RecordBatch], schema: str) -> DataFrame:
        both = self.linked.select("part", *[f.split()[0] for f in _LINKED.split(", ")[1:8]], F.lit(None).cast("int").alias("source"), F.lit(None).cast("binary").alias("values"))
        if self.sent is not None:
            both = both.unionByName(self.sent.select("part", "source", "values"), allowMissingColumns=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            linked, sent = {}, {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["source"] is None:
                        linked[row["part"]] = row
                    else:
                        sent.setdefault(row["part"], []).append((row["source"], row["values"]))
            for part in sorted(linked):
                yield step(_Part(linked[part], sent.pop(part, [])))

        return both.repartitionById(self.parts, F.col("part")).mapInArrow(lean(run), schema)

    def turn(self, step: Callable[[_Part], pa.RecordBatch], name: str) -> list[np.ndarray]:
        """One round; what its parts tell."""
        before, self.sent = self.sent, self.work.keep(self._run(step, _SENT), name)
        if before is not None:
            self.work.drop(before)
        return [np.frombuffer(r.told) for r in self.sent.where("source = -1").select("part", "told").orderBy("part").collect()]

    def listed(self) -> DataFrame:
        """(i, x, y) of what the points hold."""

        def rows(part: _Part) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(part.own[:, 0]), pa.array(part.own[:, 1])], ["i", "x", "y"])

        return self._run(rows, "i long, x double, y double")


def _evened(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(turn, shift) by which columns become orthonormal and the trivial axis, the first of ``gram``, is projected out; columns that have become dependent are left out."""
    clean = gram[1:, 1:] - np.outer(gram[0, 1:], gram[0, 1:])
    value, vector = np.linalg.eigh(clean)
    keep = value > 1e-9 * max(value[-1], 1e-300)
    turn = vector[:, keep] / np.sqrt(value[keep])
    return turn, -gram[0, 1:] @ turn


def _spectral(rounds: _Rounds, seed: int, width: int, steps: int) -> None:
    """Leaves with each point its place on the first two axes of the graph's normalised adjacency after the trivial one, by subspace iteration.

    Each round is one pass over the links and one small matrix of sums from each part.
    """
    total, points = rounds.total, rounds.points

    def sums(root: np.ndarray, x: np.ndarray) -> np.ndarray:
        columns = np.column_stack([root / np.sqrt(total), x])
        return columns.T @ columns

    def start(part: _Part) -> pa.RecordBatch:
        root = np.sqrt(part.summed(part.w))
        x = np.column_stack([2 * part.random(seed * 1000 + c) - 1 for c in range(width)])
        return part.sends(np.column_stack([root, x]), sums(root, x))

    gram = sum(rounds.turn(start, "start")).reshape(width + 1, width + 1)
    for step in range(steps):
        turn, shift = _evened(gram)

        def moved(part: _Part, turn: np.ndarray = turn, shift: np.ndarray = shift) -> pa.RecordBatch:
            even, there = (x[:, 1:] @ turn + x[:, :1] / np.sqrt(total) * shift for x in (part.own, part.inbox))
            there = there / part.inbox[:, :1]
            root = part.own[:, 0]
            pulled = np.column_stack([part.summed(part.w * there[part.at, c]) for c in range(there.shape[1])])
            x = (even + pulled / root[:, None]) / 2
            return part.sends(np.column_stack([root, x]), np.concatenate([sums(root, x).ravel(), (even.T @ x).ravel()]))

        told, kept = sum(rounds.turn(moved, "moved")), turn.shape[1]
        gram, inside = told[: (kept + 1) ** 2].reshape(kept + 1, kept + 1), told[(kept + 1) ** 2 :].reshape(kept, kept)
    axes = np.linalg.eigh((inside + inside.T) / 2)[1][:, ::-1][:, :2]  # of largest eigenvalue inside the subspace
    onto = np.zeros((kept + 1, axes.shape[1] + 1))
    onto[0, 0], onto[1:, 1:] = 1, axes
    turn, shift = _evened(onto.T @ gram @ onto)
    turn = np.hstack([axes @ turn, np.zeros((kept, 2 - turn.shape[1]))])
    shift = np.append(shift, np.zeros(2 - len(shift)))

    def placed(part: _Part) -> pa.RecordBatch:
        out = part.own[:, 1:] @ turn + part.own[:, :1] / np.sqrt(total) * shift
        return part.sends(out, np.abs(out).max(axis=0, initial=0.0), last=True)

    most = np.max(rounds.turn(placed, "axes"), axis=0)
    most[most == 0] = 1.0

    def spread_out(part: _Part) -> pa.RecordBatch:
        jitter = np.column_stack([part.random(seed * 1000 + width + c) / 10 for c in range(2)])
        return part.sends(part.own / most * 10 + jitter, _sampled(part, part.own / most * 10 + jitter, seed, points))

    rounds.sample = _chosen(rounds.turn(spread_out, "spectral"))


def _sampled(part: _Part, places: np.ndarray, seed: int, points: int) -> np.ndarray:
    """(number, x, y) of points whose seeded number is low: of all parts together more than ``SAMPLE``, if there are as many."""
    number = part.random(seed)
    low = number < min(1.0, 2 * SAMPLE / max(1, points))
    return np.column_stack([number[low], places[low]])


def _chosen(told: list[np.ndarray]) -> np.ndarray:
    """The sample: the ``SAMPLE`` of lowest number."""
    rows = np.concatenate([x.reshape(-1, 3) for x in told])
    return rows[np.argsort(rows[:, 0], kind="stable")[:SAMPLE], 1:]


def _pushed(places: np.ndarray, sample: np.ndarray, a: float, b: float) -> np.ndarray:
    """The mean push of the sampled points on each place."""
    push = np.zeros_like(places)
    for lo in range(0, len(places), 256):
        gap = places[lo : lo + 256, None] - sample[None]
        square = gap[:, :, 0] ** 2 + gap[:, :, 1] ** 2
        force = np.where(square > 0, 2 * b / ((0.001 + square) * (1 + a * square**b)), 0.0)
        push[lo : lo + 256] = np.clip(force[:, :, None] * gap, -STEP, STEP).mean(axis=1)
    return push


def _drawn(rounds: _Rounds, a: float, b: float, seed: int, steps: int) -> None:
    """Each point moves by what its links pull and by the mean push of the sampled points, as often as it is pulled."""
    most, points = rounds.most, rounds.points
    for step in range(steps):

        def moved(part: _Part, sample: np.ndarray = rounds.sample, rate: float = 1.0 - step / steps, next_seed: int = seed + step + 1) -> pa.RecordBatch:
            # links too weak to be drawn once in all rounds are left out, as each round draws every link by its weight
            w = np.where(part.w >= most / 500, part.w / most, 0.0)
            x = part.own
            gap = x[part.row] - part.inbox[part.at]
            square = gap[:, 0] ** 2 + gap[:, 1] ** 2
            near = np.where(square > 0, square, 1.0)
            power = near**b
            force = np.where(square > 0, -2 * a * b * (power / near) / (1 + a * power), 0.0)
            pull = np.column_stack([part.summed(w * np.clip(force * gap[:, c], -STEP, STEP)) for c in range(2)])
            pulls = part.summed(w)[:, None]
            # a step sums what single pulls and pushes would do one by one, so it is scaled to what one turn of each may do
            x = x + rate * (pull + PUSHES * pulls * _pushed(x, sample, a, b)) / np.maximum(pulls, 1.0)
            return part.sends(x, _sampled(part, x, next_seed, points))

        rounds.sample = _chosen(rounds.turn(moved, "placed"))


def embed(rows: DataFrame, id_col: str = "doc_id", k: int = NEIGHBOURS, close: float = CLOSE, seed: int = SEED, rounds: int = ROUNDS, once: bool = False) -> DataFrame:
    """(id, x, y): a map of (id, terms, weights) in which neighbours by cosine lie close, for every row with terms.

    Exact neighbours; a local scale for each row, by bisection; the fuzzy union of both directions; a spectral start by
    subspace iteration; then rounds in which every link pulls its ends together and sampled points push all others away, with a rate that
    falls to 0.  Points are dealt to parts of about ``PART``, each with the links of its points; in a round a part gets the places that other parts
    send to it, as one list from each, and sends its own anew.  Numbers only: a point of very many links makes its part longer, 16 bytes a link.
    The pushing sample (``SAMPLE`` points, seeded) is all that tasks are sent.

    Equal rows are one point.  Rows without neighbours stay where the start puts them, at the origin.  Null ids and repeated rows are rows of their own;
    rows without terms are not in the result; an empty table gives an empty result.  Other columns are ignored.  With ``once`` the working table
    that ``rows`` comes from (``kept_at``) is deleted when it has been read.
    """
    work = Work(rows.sparkSession, "umap")
    entry = F.array_sort(F.arrays_zip(F.col("terms").alias("t"), F.col("weights").alias("w")))
    hashed = F.transform(entry, lambda x: F.struct(x.t, F.round(x.w, DIGITS)))
    own = rows.where(F.size("terms") > 0).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("i"), "terms", "weights", F.xxhash64(hashed).alias("h1"), F.xxhash64(F.lit(seed), hashed).alias("h2"))
    full = work.keep(own, "rows")
    if once:
        work.drop(rows)
    own = work.keep(full.select("id", "i", "h1", "h2"), "own")
    heads = own.groupBy("h1", "h2").agg(F.min("i").alias("i"))
    listed = work.keep(full.join(heads.select("i"), "i").select("i", "terms", "weights"), "listed")
    work.drop(full)
    points = work.keep(listed.select("i"), "points")
    near = nearest_texts(listed, "i", k, seed=seed, once=True).drop("uid", "other_uid").withColumnsRenamed({"i": "uid", "other": "other_uid"})
    graph = work.keep(fuzzy_graph(near, k), "graph")
    linked = graph.select("i").distinct().count()
    if not linked:
        now = points.select("i", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    else:
        parts = _Rounds(work, graph, linked)
        work.drop(graph)
        _spectral(parts, seed, WIDTH, STARTS)
        _drawn(parts, *curve(close), seed, rounds)
        now = work.keep(parts.listed(), "map")
    all_points = points.select("i").join(now, "i", "left")
    placed = own.join(heads.withColumnRenamed("i", "head"), ["h1", "h2"]).join(all_points.withColumnRenamed("i", "head"), "head")
    return placed.select(F.col("id").alias(id_col), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "xy"])


def spread(points: DataFrame, id_col: str = "doc_id", to: float = 10.0) -> DataFrame:
    """(id, x, y) moved to mean 0 and, where it has any, to standard deviation ``to`` on either axis; of an empty table nothing."""
    row = points.agg(*[f(c) for c in "xy" for f in (F.avg, F.stddev_pop)]).first()
    return points.select(id_col, *[((F.col(c) - (row[2 * k] or 0.0)) / (row[2 * k + 1] or 1.0) * to).alias(c) for k, c in enumerate("xy")])
