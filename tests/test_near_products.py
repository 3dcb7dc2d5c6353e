"""What products of blocks work on."""

import numpy as np

from millrace.operators import cosine


def block(rng, rows, first, often, rare):
    """Rows of some terms that many hold and some that few do."""
    terms = [np.sort(np.concatenate([rng.choice(often, often // 2, replace=False), often + rng.choice(rare, 12, replace=False)])) for _ in range(rows)]
    weights = [(w := rng.random(len(t)) + 0.1) / np.linalg.norm(w) for t in terms]
    rows = cosine.Sparse(np.cumsum([0] + [len(t) for t in terms]), np.concatenate(terms).astype(np.int64), np.concatenate(weights))
    return cosine._Block(rows, np.arange(len(rows)) + first)


def test_terms_of_few_rows_are_not_multiplied_densely(monkeypatch):
    rng, widths, often, rare, k = np.random.default_rng(5), [], 40, 3000, 4
    a, b = block(rng, 300, 0, often, rare), block(rng, 700, 300, often, rare)
    dense = cosine._Block.dense
    monkeypatch.setattr(cosine._Block, "dense", lambda self, column, width, *rest: widths.append(width) or dense(self, column, width, *rest))
    nears = [cosine._Near(len(x.rows), k) for x in (a, b)]
    cosine._meet(a, b, *nears)
    assert widths and 0 < max(widths) <= 2 * often
    x, y = (part.rows.dense(np.arange(often + rare)) for part in (a, b))
    value = np.round(x @ y.T, cosine.DIGITS)
    for near, of, first in ((nears[0], value, 300), (nears[1], value.T, 0)):
        want = [(r, first + c, of[r, c]) for r in range(len(of)) for c in np.lexsort((np.arange(of.shape[1]), -of[r]))[:k]]
        got = list(zip(near.row, near.other, near.similarity, strict=True))
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2 * 10.0**-cosine.DIGITS)
