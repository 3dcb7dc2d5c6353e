"""Rounds of tiles between blocks."""

import numpy as np

from millrace.operators import cosine


def test_rounds_hold_every_pair_once_and_send_no_more_than_their_share():
    sizes = [(k * 7, 1500 + k % 3) for k in range(60)]
    pairs = [(a, b) for a, _ in sizes for b, _ in sizes if a < b]
    rounds = cosine._rounds(sizes, pairs, cosine.BLOCK)
    met = [(min(name, o), max(name, o)) for r in rounds for name, _, others in r for o in others]
    assert sorted(met) == pairs
    assert len(rounds) > 1 and all(len(r) <= cosine.COPIES * len(sizes) for r in rounds)
    assert cosine._rounds([(1, 5)], [], cosine.BLOCK) == []


def test_products_in_single_precision_lose_no_neighbour():
    rng = np.random.default_rng(3)
    size, width = 80, 30
    matrix = np.round(rng.random((2 * size, width)) * (rng.random((2 * size, width)) < 0.4), 1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1), 1e-9)[:, None]
    blocks = []
    for part in (matrix[:size], matrix[size:]):
        row, term = np.nonzero(part)
        rows = cosine.Sparse(np.searchsorted(row, np.arange(size + 1)), term.astype(np.int64), part[row, term])
        blocks.append(cosine._Block(rows, np.arange(size) + size * len(blocks)))
    nears = [cosine._Near(size, 4) for _ in blocks]
    cosine._meet(*blocks, *nears)
    exact = np.round(matrix[:size] @ matrix[size:].T, cosine.DIGITS)
    for near, value, first in ((nears[0], exact, size), (nears[1], exact.T, 0)):
        want = [(r, first + c, value[r, c]) for r in range(size) for c in np.lexsort((np.arange(size), -value[r]))[:4] if value[r, c] > 0]
        assert list(zip(near.row, near.other, near.similarity, strict=True)) == want
