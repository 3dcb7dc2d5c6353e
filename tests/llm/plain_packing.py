"""Best-fit packing in one place, the plain version that the distributed sweeps are held against."""

import numpy as np


def best_fit(lengths: np.ndarray, room: np.ndarray, capacity: int, band: float = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each document, the room of each sequence afterwards, and the number of sweeps.

    Bulk-synchronous best fit.  Documents are sorted by length, longest first (their
    rank), gaps by room.  In a sweep each document of the band asks for its successor, the
    smallest room that holds it; of those that ask for gaps of one room as many as there are gaps
    get one each, by rank; the gaps shrink; the others sweep again.  When none of the
    band finds a gap, as many sequences are opened as its tokens fill.
    """
    room, sweeps = room.astype(np.int64), 0
    order = np.argsort(-lengths, kind="stable")
    ranked = -lengths[order]
    sequence, offset = np.full(len(lengths), -1, dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    done = 0
    while done < len(order):
        stop = int(np.searchsorted(ranked, ranked[done] / band, side="right"))
        todo = order[done:stop]
        done = stop
        while len(todo):
            sweeps += 1
            gaps = np.bincount(room, minlength=capacity + 1)
            held = np.where(gaps > 0, np.arange(capacity + 1), capacity + 1)
            successor = np.minimum.accumulate(held[::-1])[::-1][lengths[todo]]
            asks = successor <= capacity
            if not asks.any():
                room = np.append(room, np.full(-(-int(lengths[todo].sum()) // capacity), capacity))
                continue
            who, where = todo[asks], successor[asks]
            by = np.argsort(where, kind="stable")
            who, where = who[by], where[by]
            turn = np.arange(len(who)) - np.searchsorted(where, where, side="left")
            first = turn < gaps[where]
            who, where, turn = who[first], where[first], turn[first]
            at = np.argsort(room, kind="stable")[(np.cumsum(gaps) - gaps)[where] + turn]
            sequence[who], offset[who] = at, capacity - room[at]
            room[at] -= lengths[who]
            todo = todo[sequence[todo] < 0]
    return sequence, offset, room, sweeps
