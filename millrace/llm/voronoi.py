"""Voronoi regions of a set of sets under the Jaccard distance, in numpy, and exact joins inside them.

Pivots are members.  Every member has a home, the region of its nearest pivot,
and is replicated to each further region that may hold the home of a partner.
With radius r and d the distance, a partner y of x has, by the triangle
inequality, ``d(y, p) <= d(x, p) + r`` for each pivot p, so if x is at home at p

* ``d(y, p) <= d(y, own pivot of y) + 2 r``  (as d(x, p) <= d(x, q) for each q), and
* ``d(y, p) <= reach(p) + r``  with reach(p) the largest distance of a member at home there.

What lies farther than ``core`` from all pivots would stand in every window, as unrelated
sets are at distance 1 from each other.  It is at home in one outer region instead, whose
window holds all y with ``d(y, own pivot of y) > core - r``.

Both ends of a link thus meet in the home region of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Members of a region that are compared at once; larger ones, and whole sets of sets of any size, are cut by pivots.
CELL = 8
#: Pivots of one cut at most.
PIVOTS = 32
#: A cut whose largest region holds more than this share of the members is not worth a further one.
THIN = 0.9
#: Bytes of lines of bits that are held at one time; where they would need more, sets are compared one with all others.
MOST_BYTES = 32 << 20
_EPS = 1e-9


@dataclass
class Cuts:
    """What was cut: regions, members at home in them, members replicated to them, and regions that windows did not thin."""

    regions: int = 0
    home: int = 0
    replicas: int = 0
    thick: int = 0
    largest: int = field(default=0)


class Sets:
    """Sorted sets of fingerprints as one flat array of small numbers."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, universe: int):
        self.flat, self.sizes, self.universe = flat, sizes, universe
        self.edge = np.concatenate(([0], np.cumsum(sizes)))

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Sets:
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        return cls(place.astype(np.int64, copy=False), np.array([len(s) for s in sets], dtype=np.int64), len(every))

    def __len__(self) -> int:
        return len(self.sizes)

    def take(self, members: np.ndarray) -> Sets:
        size = self.sizes[members]
        start = np.repeat(self.edge[members] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return Sets(self.flat[start + np.arange(int(size.sum()))], size, self.universe)

    def shared(self, k: int, after: int = 0) -> np.ndarray:
        """Number of elements that set ``k`` shares with each set from ``after`` on.  No set is empty."""
        mark = np.zeros(self.universe, dtype=np.int64)
        mark[self.flat[self.edge[k] : self.edge[k + 1]]] = 1
        return np.add.reduceat(mark[self.flat[self.edge[after] :]], self.edge[after:-1] - self.edge[after])

    def distances(self, k: int) -> np.ndarray:
        both = self.shared(k)
        return 1.0 - both / (self.sizes + self.sizes[k] - both)


def core(percent: int) -> float:
    """Largest distance from the nearest pivot at which a member is at home there: a partner is then nearer than an unrelated set."""
    return max(0.0, 0.9 - (100 - percent) / 100)


def windows(distance: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(home, inside) from distances (pivot x member): the region of each member, the last being the outer one, and the windows without the bound by reach."""
    radius = (100 - percent) / 100
    nearest = distance.min(axis=0)
    home = np.where(nearest > core(percent), len(distance), np.argmin(distance, axis=0))
    inside = (distance <= nearest + 2 * radius + _EPS) & (distance <= core(percent) + radius + _EPS)
    return home, np.vstack((inside, nearest > core(percent) - radius - _EPS))


def regions(sets: Sets, percent: int, want: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, whether each is at home) of each Voronoi region; pivots are far from each other (greedily)."""
    radius = (100 - percent) / 100
    far, at = [sets.distances(0)], [0]
    nearest = far[0]
    while len(far) < want and nearest.max() > 0:
        at.append(int(np.argmax(nearest)))
        far.append(sets.distances(at[-1]))
        nearest = np.minimum(nearest, far[-1])
    distance = np.array(far)
    home, inside = windows(distance, percent)
    out = []
    for p, within in enumerate(inside):
        own = home == p
        if own.any():
            if p < len(distance):
                within = within & (distance[p] <= distance[p][own].max() + radius + _EPS)
            members = np.flatnonzero(within)
            out.append((members, own[members]))
    return out


def pairs(sets: Sets, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, many j), each pair within the radius once, exactly."""
    sizes = sets.sizes
    often = np.bincount(sets.flat, minlength=sets.universe) > 1
    wide = int(often.sum())
    if len(sets) <= 64 or len(sets) * wide > 8 * MOST_BYTES:
        for i in range(len(sets) - 1):
            both, other = sets.shared(i, i + 1), sizes[i + 1 :]
            close = np.flatnonzero(100 * both >= percent * (sizes[i] + other - both))
            if len(close):
                yield i, close + i + 1
        return
    # a line of bits for each set, over the elements that several sets hold, a bounded number of columns at a time
    number = np.cumsum(often) - 1
    member = np.repeat(np.arange(len(sets)), sizes)
    known = often[sets.flat]
    column, line = number[sets.flat[known]], member[known]
    step = max(64, (MOST_BYTES // 4 // len(sets)) // 64 * 64)
    blocks = []
    for first in range(0, max(wide, 1), step):
        cells = np.zeros((len(sets), -(-min(step, max(wide - first, 1)) // 64) * 64), dtype=bool)
        here = (column >= first) & (column < first + step)
        cells[line[here], column[here] - first] = True
        blocks.append(np.packbits(cells, axis=1, bitorder="little").view(np.uint64))
    order = np.argsort(sizes, kind="stable")
    rank = sizes[order]
    last = np.searchsorted(rank * percent, rank * 100, side="right")  # percent * larger <= 100 * smaller
    blocks = [b[order] for b in blocks]
    for i in range(len(sets) - 1):
        stop = int(last[i])
        both = sum(np.bitwise_count(b[i + 1 : stop] & b[i]).sum(axis=1, dtype=np.int64) for b in blocks)
        close = np.flatnonzero(100 * both >= percent * (rank[i] + rank[i + 1 : stop] - both))
        if len(close):
            yield int(order[i]), order[close + i + 1]


class Forest:
    """Components of a graph whose edges come as (i, many j)."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, found: np.ndarray) -> np.ndarray:
        """Join ``i`` with all of ``found``; those of them that were needed."""
        root = self.root
        other = found[root[found] != root[i]]
        if not len(other):
            return other
        labels, at = np.unique(root[other], return_index=True)
        least = min(int(labels[0]), int(root[i]))
        if len(labels) == 1:
            root[(root == labels[0]) | (root == root[i])] = least
        else:
            change = np.zeros(len(root), dtype=bool)
            change[labels] = change[root[i]] = True
            root[change[root]] = least
        return other[at]


def linked(sets: list[np.ndarray], percent: int, cell: int = CELL, cuts: Cuts | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool, np.ndarray]]:
    """(i, many j, whether each j is at home, whether i is) for the links of each region, recursively.

    A link is seen once in the home region of each of its ends (in one, if that is the same).
    """
    every = Sets.of(sets)
    cuts = Cuts() if cuts is None else cuts
    todo = [(np.arange(len(every)), np.ones(len(every), dtype=bool))]
    first = True
    while todo:
        members, home = todo.pop()
        own = every if len(members) == len(every) else every.take(members)
        if len(members) > (1 if first else cell):
            first = False
            parts = regions(own, percent, min(PIVOTS, max(2, -(-len(members) // cell))))
            cuts.regions += len(parts)
            for inside, at_home in parts:
                cuts.home += int(at_home.sum())
                cuts.replicas += int((~at_home).sum())
                cuts.largest = max(cuts.largest, len(inside))
            if max(len(inside) for inside, _ in parts) <= THIN * len(members):
                for inside, at_home in parts:
                    at_home = at_home & home[inside]
                    if len(inside) > 1 and at_home.any():
                        todo.append((members[inside], at_home))
                continue
            cuts.thick += 1
        for i, found in pairs(own, percent):
            yield int(members[i]), members[found], home[found], bool(home[i])


def links_of(sets: list[np.ndarray], percent: int, weight: np.ndarray, cell: int = CELL, cuts: Cuts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(component, links) of each set: the smallest index of its component, and the weight of the sets linked with it."""
    total, forest = np.zeros(len(sets), dtype=np.int64), Forest(len(sets))
    for i, found, at_home, own in linked(sets, percent, cell, cuts):
        if own:
            total[i] += weight[found].sum()
        total[found[at_home]] += weight[i]
        forest.join(i, found)
    return forest.root, total
