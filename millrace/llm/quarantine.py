"""Quarantine and cascading release of the turns of conversations.

A turn waits for its parent, fails while it is faulty and is tried again, dies after the last attempt, and then holds back all
that hangs on it.  What a turn makes of its parent's delivery time is a piecewise function (constant, shifted or dead), and such
functions compose.  Turns of a conversation are cut into parts of bounded size, wherever that falls.  Within a part the forest of
turns is decomposed into heavy paths, each with a segment tree of composed functions: a query climbs light edges, an evaluation
gives all prefixes of all paths, topmost first.  A part depends on the one before by the last turns alone,
so it is itself a tuple of such functions; these are composed up a tree of parts and evaluated down it.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.work import Work, release

#: Seconds between arrivals; parents stand fewer than this many turns earlier; attempts; seconds from the first attempt to each.
GAP, REACH, ATTEMPTS = 7, 5, 6
OFFSETS = tuple(10 * 2**a - 10 for a in range(ATTEMPTS))
#: Turns of a part, about; parts whose functions one task composes.
PART, FAN = 50_000, 64
#: The input of a turn without a parent: before any arrival.
START = -1

#: (from, slope, value) ascending; slope 0: the value; slope 1: the input plus the value; value None: dead.
Pieces = tuple[tuple[int, int, int | None], ...]
#: Of each of the last turns before a place: what its delivery time is of which earlier turn's (0: of none).
Tail = list[tuple[int, Pieces]]

IDENTITY: Pieces = ((START, 1, 0),)
NEVER: Pieces = ((START, 0, None),)


def at(f: Pieces, x: int | None) -> int | None:
    """The value of a function; None, of a turn that is never delivered, stays None."""
    if x is None:
        return None
    _, slope, value = f[bisect_right(f, x, key=lambda piece: piece[0]) - 1]
    return value if value is None or not slope else x + value


def after(f: Pieces, g: Pieces) -> Pieces:
    """The function that gives ``g`` of the value of ``f``."""
    out: list[tuple[int, int, int | None]] = []

    def put(start: int, slope: int, value: int | None) -> None:
        if not out or out[-1][1:] != (slope, value):
            out.append((start, slope, value))

    for k, (start, slope, value) in enumerate(f):
        if value is None or not slope:
            put(start, 0, at(g, value))
            continue
        stop = f[k + 1][0] if k + 1 < len(f) else None
        first = bisect_right(g, start + value, key=lambda piece: piece[0]) - 1
        for begin, own_slope, own in g[first:]:
            x = max(start, begin - value)
            if stop is not None and x >= stop:
                break
            put(x, own_slope, own if own is None or not own_slope else own + value)
    return tuple(out)


def delivery(arrival: int, faulty: bool, repaired: int, allowed: tuple[bool, ...]) -> Pieces:
    """Delivery time of a turn by the delivery time of its parent."""
    if faulty:
        held = [(repaired - offset, 1, offset) for offset, ok in zip(OFFSETS, allowed, strict=True) if ok][::-1]
        by_start: Pieces = ((START - OFFSETS[-1] - 1, 0, None), *held)
    else:
        by_start = IDENTITY
    return after(((START, 0, arrival), (arrival, 1, 0)), by_start)


class Forest:
    """Heavy paths over nodes whose parents have smaller numbers; a parent of -1 is none, one of -1 - k stands k places before the first node."""

    def __init__(self, parent: list[int], function: Callable[[int], Pieces]):
        self.parent, self.function, n = parent, function, len(parent)
        size = [1] * n
        for v in range(n - 1, -1, -1):
            if parent[v] >= 0:
                size[parent[v]] += size[v]
        heavy: dict[int, int] = {}
        for v, p in enumerate(parent):
            if p >= 0 and (p not in heavy or size[v] > size[heavy[p]]):
                heavy[p] = v
        self.head, self.place, self.paths = list(range(n)), [0] * n, {}
        for v, p in enumerate(parent):
            if p >= 0 and heavy[p] == v:
                self.head[v], self.place[v] = self.head[p], self.place[p] + 1
                self.paths[self.head[v]].append(v)
            else:
                self.paths[v] = [v]
        self.trees: dict[int, list[list[Pieces]]] = {}

    def tree(self, head: int) -> list[list[Pieces]]:
        """Functions of the nodes of a path, of pairs of neighbours, and so on up to the whole path."""
        if head not in self.trees:
            levels = [[self.function(v) for v in self.paths[head]]]
            while len(levels[-1]) > 1:
                low = levels[-1]
                levels.append([after(low[k], low[k + 1]) if k + 1 < len(low) else low[k] for k in range(0, len(low), 2)])
            self.trees[head] = levels
        return self.trees[head]

    def prefix(self, head: int, stop: int) -> Pieces:
        """The composed function of the first ``stop`` nodes of a path, of a few nodes of its tree."""
        f, done = IDENTITY, 0
        for level in range(len(self.tree(head)) - 1, -1, -1):
            if done + (1 << level) <= stop:
                f = after(f, self.tree(head)[level][done >> level])
                done += 1 << level
        return f

    def climb(self, v: int) -> tuple[int, Pieces]:
        """What node ``v`` is of which turn before the first node (0: of none), by way of light edges."""
        f = IDENTITY
        while True:
            head = self.head[v]
            f = after(self.prefix(head, self.place[v] + 1), f)
            v = self.parent[head]
            if v < 0:
                return (-1 - v, f) if v < -1 else (0, ((START, 0, at(f, START)),))

    def inputs(self, before: list[int | None]) -> list[int | None]:
        """The input of every node (None: held back), by the delivery times of the turns before; paths further up come first."""
        found: list[int | None] = [None] * len(self.parent)
        for head, path in self.paths.items():
            p = self.parent[head]
            x = START if p == -1 else before[-2 - p] if p < -1 else at(self.function(p), found[p])
            if x is None:
                continue
            levels = self.tree(head)
            todo = [(len(levels) - 1, 0, x)]
            while todo:
                level, k, x = todo.pop()
                if x is None:
                    continue
                if not level:
                    found[path[k]] = x
                    continue
                low = levels[level - 1]
                if 2 * k + 1 < len(low):
                    todo.append((level - 1, 2 * k + 1, at(low[2 * k], x)))
                todo.append((level - 1, 2 * k, x))
        return found


def joined(first: Tail, then: Tail) -> Tail:
    """Two parts as one."""
    return [(first[k - 1][0], after(first[k - 1][1], f)) if k else (0, f) for k, f in then]


def _packed(tail: Tail) -> str:
    return json.dumps(tail)


def _tail(text: str) -> Tail:
    return [(k, tuple(map(tuple, f))) for k, f in json.loads(text)]


class _Part:
    """The turns of one part, sorted; ``before``: turns of its first conversation in the parts before."""

    def __init__(self, table: pa.Table, starts: pa.Table):
        self.table = table.sort_by([(c, "ascending") for c in ("conv_id", "turn", "crc", "uid")])
        own = {name: self.table.column(name).to_numpy() for name in ("distance", "faulty", "repair", "allowed")}
        conv = self.table.column("conv_id").to_pylist()
        n = len(conv)
        begins = np.array([k == 0 or conv[k] != conv[k - 1] for k in range(n)], dtype=bool)
        self.first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        self.before = starts.column("before")[0].as_py() if starts.num_rows else 0
        self.p = np.arange(n) - self.first + np.where(self.first == 0, self.before, 0)
        self.arrival = GAP * self.p
        self.faulty, self.repaired = own["faulty"].astype(bool), self.arrival + own["repair"]
        self.allowed = (own["allowed"][:, None] >> np.arange(ATTEMPTS)) & 1 == 1
        distance = np.where(own["distance"] > self.p, 0, own["distance"])
        parent = np.where(distance == 0, -1, np.where(np.arange(n) - distance >= 0, np.arange(n) - distance, np.arange(n) - distance - 1))
        arrival, faulty, repaired, allowed = self.arrival.tolist(), self.faulty.tolist(), self.repaired.tolist(), list(map(tuple, self.allowed.tolist()))
        known: dict[int, Pieces] = {}

        def function(v: int) -> Pieces:
            if v not in known:
                known[v] = delivery(arrival[v], faulty[v], repaired[v], allowed[v])
            return known[v]

        self.forest = Forest(parent.tolist(), function)

    def tail(self) -> Tail:
        n, first = len(self.p), int(self.first[-1])
        out: Tail = []
        for back in range(1, REACH):
            if n - back >= first:
                out.append(self.forest.climb(n - back))
            else:  # further back than this part: a turn before it, if the conversation began there
                k = back - n
                out.append((k, IDENTITY) if first == 0 and k <= self.before else (0, NEVER))
        return out


_PLACED = "conv_id long, turn long, p long, crc long, status string, attempts int, first_at long, last_at long"


def _transfer(key: tuple, table: pa.Table, starts: pa.Table) -> pa.Table:
    tail = _packed(_Part(table, starts).tail()) if table.num_rows else _packed([(k, IDENTITY) for k in range(1, REACH)])
    release()
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "tail": [tail]})


def _up(key: tuple, table: pa.Table) -> pa.Table:
    parts = table.sort_by("part").column("tail").to_pylist()
    whole = _tail(parts[0])
    for text in parts[1:]:
        whole = joined(whole, _tail(text))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "tail": [_packed(whole)]})


def _down(key: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
    """Delivery times before each part of a group, by those before the group."""
    now = given.column("times")[0].as_py() if given.num_rows else [None] * (REACH - 1)
    table = table.sort_by("part")
    times = []
    for text in table.column("tail").to_pylist():
        times.append(now)
        now = [at(f, now[k - 1] if k else START) for k, f in _tail(text)]
    return pa.table({"part": table.column("part"), "times": pa.array(times, pa.list_(pa.int64()))})


def _replayed(key: tuple, table: pa.Table, starts: pa.Table) -> pa.Table:
    part = _Part(table, starts)
    x = part.forest.inputs(starts.column("times")[0].as_py() if starts.num_rows else [None] * (REACH - 1))
    held = np.array([v is None for v in x], dtype=bool)
    first = np.maximum(part.arrival, np.array([START if v is None else v for v in x], dtype=np.int64))
    tried = first[:, None] + np.array(OFFSETS)
    works = ~part.faulty[:, None] | (tried >= part.repaired[:, None]) & part.allowed
    dead = ~works.any(axis=1)
    attempts = np.where(held, 0, np.where(dead, ATTEMPTS, works.argmax(axis=1) + 1))
    last = first + np.array(OFFSETS)[np.maximum(attempts, 1) - 1]
    columns = [part.table.column("conv_id"), part.table.column("turn"), pa.array(part.p), part.table.column("crc")]
    columns += [pa.array(np.where(held, "blocked", np.where(dead, "dead", "delivered"))), pa.array(attempts, pa.int32()), pa.array(first, mask=held), pa.array(last, mask=held)]
    del part, x
    release()
    return pa.table(columns, names=[f.split()[0] for f in _PLACED.split(", ")])


def _spread(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``rows`` in sorted parts of about ``PART``, numbered in order, whatever share one key has."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART))
    return rows.repartitionByRange(parts, *keys).withColumn(name, F.spark_partition_id().cast("long"))


def _long(value: Column) -> Column:
    """A whole decimal as 64 bits, wrapped around."""
    low = F.pmod(value, F.lit(Decimal(2**64)))
    return F.when(low >= F.lit(Decimal(2**63)), low - F.lit(Decimal(2**64))).otherwise(low).cast("long")


def replay(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, status, attempts, first_at, last_at, release_no, state) of every row of ``turns``.

    A turn's place in its conversation is its rank by turn (then by checksum of the text); all hashes are CRC-32 of ``k:conv_id:turn``.  Parts of about ``PART`` turns are
    dealt by ranges of (conversation, turn), releases by ranges of (conversation, time, turn), so a conversation of any size
    lies in as many tasks as it fills; between parts go four functions each, ``FAN`` parts to a task, tree upon tree.

    Null text counts as empty.  Rows without a conversation are one, a null turn is the last of its
    conversation, and either is written as nothing in a hash.  Repeated rows are turns of their own, with the same hashes.  ``state`` wraps around
    at 64 bits.  A very long text gives a checksum only.  An empty table gives an empty result.  Other columns are ignored.
    """
    work = Work(turns.sparkSession, "replay")
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    named = [F.coalesce(c.cast("string"), F.lit("")) for c in (conv, turn)]
    h = [F.crc32(F.concat_ws(":", F.lit(str(k)), *named)) for k in range(ATTEMPTS + 3)]
    allowed = sum(((h[a + 3] % 3 != 0).cast("long") * (1 << a) for a in range(1, ATTEMPTS)), (h[3] % 3 != 0).cast("long"))
    rows = turns.select(
        conv.alias("conv_id"), turn.alias("turn"), F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("crc"),
        (h[0] % REACH).alias("distance"), (h[1] % 101 < 50).alias("faulty"), (h[2] % 101).alias("repair"), allowed.alias("allowed"), F.monotonically_increasing_id().alias("uid"),
    )
    order = [F.asc_nulls_last(c) for c in ("conv_id", "turn", "crc", "uid")]
    placed = work.keep(_spread(rows, order, "part"), "turns")
    counts = placed.groupBy("part", "conv_id").count()
    earlier = F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = work.keep(counts.withColumn("before", earlier).where("before > 0").select("part", "before"), "starts")
    by_part = placed.groupBy("part")
    levels = [work.keep(by_part.cogroup(starts.groupBy("part")).applyInArrow(_transfer, "part long, tail string"), "tails")]
    parts = int(placed.agg(F.max("part")).first()[0] or 0) + 1
    while parts > FAN:
        group = F.expr(f"part div {FAN}").alias("group")
        levels.append(work.keep(levels[-1].groupBy(group).applyInArrow(_up, "part long, tail string"), "tails"))
        parts = -(-parts // FAN)
    times = work.spark.createDataFrame([], "part long, times array<long>")
    for level in reversed(levels):
        group = F.expr(f"part div {FAN}").alias("group")
        times = work.keep(level.groupBy(group).cogroup(times.groupBy(F.col("part").alias("group"))).applyInArrow(_down, "part long, times array<long>"), "times")
    given = times.join(starts, "part")
    found = work.keep(by_part.cogroup(given.groupBy("part")).applyInArrow(_replayed, _PLACED), "replayed")
    work.drop(placed)

    order = [F.asc_nulls_last(c) for c in ("conv_id", "last_at", "turn", "p")]
    sent = work.keep(_spread(found.where("status = 'delivered'"), order, "part"), "sent")
    own = Window.partitionBy("part", "conv_id").orderBy(*order[1:])
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    product = lambda a, b: (F.col(a).cast("decimal(12,0)") * F.col(b).cast("decimal(25,0)")).cast("decimal(38,0)")
    numbered = sent.withColumn("n", F.row_number().over(own).cast("long")).withColumns(
        {"crcs": F.sum(F.col("crc").cast("decimal(15,0)")).over(running), "weighed": F.sum((F.col("n") * F.col("crc")).cast("decimal(20,0)")).over(running)}
    )
    totals = numbered.groupBy("part", "conv_id").agg(*[F.max(c).alias(c) for c in ("n", "crcs", "weighed")])
    prior = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("rows_before", F.coalesce(F.sum("n").over(prior), F.lit(0)))
    before = before.withColumn("state_before", F.coalesce(F.sum((product("rows_before", "crcs") + F.col("weighed")).cast("decimal(38,0)")).over(prior), F.lit(Decimal(0))).cast("decimal(38,0)"))
    before = work.keep(before.select(F.col("part").alias("of_part"), F.col("conv_id").alias("of"), "rows_before", "state_before"), "before")
    met = numbered.join(before.hint("merge"), (F.col("part") == F.col("of_part")) & F.col("conv_id").eqNullSafe(F.col("of")))
    state = (F.col("state_before") + product("rows_before", "crcs") + F.col("weighed")).cast("decimal(38,0)")
    columns = ["conv_id", "turn", "status", "attempts", "first_at", "last_at"]
    delivered = met.select(*columns, (F.col("rows_before") + F.col("n")).alias("release_no"), _long(state).alias("state"))
    none = F.lit(None).cast("long")
    return delivered.unionByName(found.where("status <> 'delivered'").select(*columns, none.alias("release_no"), none.alias("state")))


def _crc32(text: str) -> str:
    """CRC-32 of a text in SQL; ``crc_table`` must be among the tables."""
    data = f"list_transform(range(strlen({text})), lambda i: CAST(instr('0123456789ABCDEF', substr(hex({text}), 2 * i + 1, 1)) * 16 + instr('0123456789ABCDEF', substr(hex({text}), 2 * i + 2, 1)) - 17 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


def oracle() -> str:
    """The same as SQL, a turn after its parent."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    tried = f"list_filter(range(1, {ATTEMPTS + 1}), lambda a: NOT faulty OR (greatest(arrival, {{x}}) + 10 * (1 << CAST(a - 1 AS INTEGER)) - 10 >= arrival + repair AND allowed[a]))[1]"
    return f"""
        WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: {step})) AS steps),
        placed AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations),
        hashed AS (
            SELECT conv_id, turn, p, {_crc32("text")} AS crc, list_transform(range({ATTEMPTS + 3}), lambda k: {_crc32("concat(k, ':', conv_id, ':', turn)")}) AS h
            FROM placed, crc_table),
        turns AS (
            SELECT conv_id, turn, p, crc, {GAP} * p AS arrival, CASE WHEN h[1] % {REACH} BETWEEN 1 AND p THEN p - h[1] % {REACH} END AS parent,
                   h[2] % 101 < 50 AS faulty, h[3] % 101 AS repair, list_transform(h[4:], lambda x: x % 3 <> 0) AS allowed
            FROM hashed),
        walked AS (
            SELECT conv_id, p, CASE WHEN {tried.format(x=START)} IS NULL THEN 'dead' ELSE 'delivered' END AS status, CAST(coalesce({tried.format(x=START)}, {ATTEMPTS}) AS INTEGER) AS attempts, CAST(arrival AS BIGINT) AS first_at
            FROM turns WHERE parent IS NULL
            UNION ALL
            SELECT t.conv_id, t.p, CASE WHEN w.status <> 'delivered' THEN 'blocked' WHEN {tried.format(x="w.first_at + 10 * (1 << (w.attempts - 1)) - 10")} IS NULL THEN 'dead' ELSE 'delivered' END,
                   CASE WHEN w.status <> 'delivered' THEN 0 ELSE CAST(coalesce({tried.format(x="w.first_at + 10 * (1 << (w.attempts - 1)) - 10")}, {ATTEMPTS}) AS INTEGER) END,
                   CASE WHEN w.status = 'delivered' THEN greatest(t.arrival, w.first_at + 10 * (1 << (w.attempts - 1)) - 10) END
            FROM turns t JOIN walked w ON w.conv_id = t.conv_id AND w.p = t.parent),
        found AS (
            SELECT conv_id, turn, p, crc, status, attempts, first_at, CASE WHEN status <> 'blocked' THEN CAST(first_at + 10 * (1 << (attempts - 1)) - 10 AS BIGINT) END AS last_at
            FROM walked JOIN turns USING (conv_id, p)),
        released AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, turn, p) AS release_no FROM found WHERE status = 'delivered')
        SELECT conv_id, turn, status, attempts, first_at, last_at, release_no, CAST(sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no) AS BIGINT) AS state FROM released
        UNION ALL SELECT conv_id, turn, status, attempts, first_at, last_at, NULL, NULL FROM found WHERE status <> 'delivered'
    """
