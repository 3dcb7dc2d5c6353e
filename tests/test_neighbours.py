"""Exact neighbours by cosine, and the map drawn from them."""

import math
import random

import numpy as np
import pytest

from millrace.operators import cosine, umap, vectors

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id int, terms array<string>, weights array<double>, uid int, cid string, block string, rank int"


def made(spark, rows):
    return spark.createDataFrame([(i, [t for t, _ in v], [w for _, w in v], 1, "x", "y", 0) for i, v in rows], SCHEMA).repartition(3)


def vectors_of(seed, groups=3):
    """Rows of several vocabularies, with copies, repeated rows, null ids and rows without terms."""
    rng = random.Random(seed)
    rows = []
    for n in range(90):
        v = {f"{'abc'[n % groups]}{rng.randrange(25)}": rng.random() for _ in range(rng.randint(1, 9))}
        length = math.sqrt(sum(w * w for w in v.values()))
        rows.append((n, sorted((t, w / length) for t, w in v.items())))
    copies = [(200 + k, rows[4][1][::-1]) for k in range(30)]
    return rows + copies + [rows[7], rows[7], (None, rows[9][1]), (None, []), (500, []), (501, [("alone", 1.0)])]


def brute(rows, k):
    kept = [(i, dict(v)) for i, v in rows if v]
    key = lambda i: (i is None, i or 0)
    out = []
    for a, (i, v) in enumerate(kept):
        near = [(round(sum(w * o.get(t, 0) for t, w in v.items()), cosine.DIGITS), j) for b, (j, o) in enumerate(kept) if b != a]
        near = sorted((-s, key(j)) for s, j in near if s > 0)[:k]
        out += [(i, n + 1, None if j[0] else j[1], round(-s, 6)) for n, (s, j) in enumerate(near)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "k"), [(2000, 5), (20, 5), (7, 3)])
def test_nearest_texts(spark, block, k):
    """One block and many, against all pairs: no neighbour is lost, whatever the blocks."""
    rows = vectors_of(block)
    got = cosine.nearest_texts(made(spark, rows), k=k, block=block).collect()
    assert sorted(((r.doc_id, r["rank"], r.other, round(r.similarity, 6)) for r in got), key=repr) == brute(rows, k)
    assert all(r.uid != r.other_uid for r in got)


def test_nearest_texts_of_nothing(spark):
    assert cosine.nearest_texts(made(spark, [])).collect() == []
    assert cosine.nearest_texts(made(spark, [(1, []), (None, [])])).collect() == []
    assert cosine.nearest_texts(made(spark, [(1, [("a", 1.0)])])).collect() == []


def test_bounds_are_bounds():
    """No cosine exceeds its bound, and what shares no term has bound 0."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(30)]
    own = cosine.Sparse(np.cumsum([0] + [len(r) for r in rows]), np.concatenate(rows).astype(np.int64), np.concatenate([(w := rng.random(len(r))) / np.linalg.norm(w) for r in rows]))
    dense = own.dense(np.arange(40))
    got = cosine.bounds(own, [own.largest(), (np.array([99]), np.array([1.0]))])
    assert ((dense @ dense.T).max(axis=1) <= got[:, 0] + 1e-12).all() and (got[:, 1] == 0).all()


def test_tfidf_rows_are_those_of_tfidf(spark):
    docs = spark.createDataFrame([(1, "one two two three"), (1, "one two"), (None, "two three four"), (3, None), (4, "")], "doc_id int, text string")
    one = sorted(((r.doc_id, r.term, r.weight) for r in vectors.tfidf(docs).collect()), key=repr)
    rows = vectors.tfidf_rows(docs).collect()
    assert len(rows) == 5 and sorted(((r.doc_id, t, w) for r in rows for t, w in zip(r.terms, r.weights, strict=True)), key=repr) == one


def test_local_scales():
    """Memberships of a row sum to log2 k; nearer neighbours belong more; distances of 0 do not count as nearest."""
    d = np.array([[0.1, 0.2, 0.3, 0.5, 0.9], [0.0, 0.4, 0.4, 0.5, 0.6], [0.7, 0.8, np.nan, np.nan, np.nan]])
    nearest, scale = umap.scales(d, 5)
    assert nearest.tolist() == [0.1, 0.4, 0.7]
    member = np.exp(-np.maximum(d - nearest[:, None], 0) / scale[:, None])
    assert member[0].sum() == pytest.approx(math.log2(5), abs=1e-6) and (np.diff(member[0]) < 0).all()
    a, b = umap.curve()
    assert 1 / (1 + a * 0.05 ** (2 * b)) > 0.95 and abs(1 / (1 + a * 1.12 ** (2 * b)) - math.exp(-1)) < 0.1


def test_fuzzy_graph(spark):
    """Both directions of each link have one weight, a + b - ab."""
    near = spark.createDataFrame([(1, 2, 1, 0.9), (1, 3, 2, 0.5), (2, 1, 1, 0.9), (3, 1, 1, 0.5)], "uid long, other_uid long, rank int, similarity double")
    got = {(r.i, r.j): r.w for r in umap.fuzzy_graph(near, 2).collect()}
    assert set(got) == {(1, 2), (2, 1), (1, 3), (3, 1)} and all(got[a, b] == pytest.approx(got[b, a]) for a, b in got)
    assert got[1, 2] == pytest.approx(1.0) and 0 < got[1, 3] <= 1


def trust(distance, places, k=15):
    """The share of neighbours on the map that are neighbours in fact, by rank (trustworthiness)."""
    n = len(places)
    np.fill_diagonal(distance, -1)
    rank = np.argsort(np.argsort(distance, axis=1, kind="stable"), axis=1, kind="stable")
    gap = ((places[:, None] - places[None]) ** 2).sum(2)
    np.fill_diagonal(gap, -1)
    shown = np.argsort(gap, axis=1, kind="stable")[:, 1 : k + 1]
    return 1 - 2 * np.maximum(np.take_along_axis(rank, shown, 1) - k, 0).sum() / (n * k * (2 * n - 3 * k - 1))


def test_map_is_truer_than_averaging(spark):
    """Trustworthiness over the documents, against the layout by averages of neighbours; the map is the same each time, and copies meet."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = vectors.tfidf_rows(docs)
    known = [r for r in rows.collect() if r.terms]
    terms = {t: k for k, t in enumerate(sorted({t for r in known for t in r.terms}))}
    dense = np.zeros((len(known), len(terms)))
    for row, r in zip(dense, known, strict=True):
        row[[terms[t] for t in r.terms]] = r.weights
    got = {r.doc_id: (r.x, r.y) for r in umap.embed(rows).collect()}
    assert set(got) == {r.doc_id for r in known}
    old = {r.doc_id: (r.x, r.y) for r in vectors.layout(vectors.tfidf(docs)).collect()}
    new, before = (trust(1 - dense @ dense.T, np.array([m[r.doc_id] for r in known])) for m in (got, old))
    assert new > 0.7 and new > before, (new, before)


def test_map_of_edge_cases(spark):
    rows = vectors_of(3)
    got = umap.embed(made(spark, rows), k=5, rounds=3).collect()
    assert len(got) == sum(bool(v) for _, v in rows)
    again = umap.embed(made(spark, rows), k=5, rounds=3).collect()
    assert sorted(((r.doc_id, round(r.x, 6)) for r in got), key=repr) == sorted(((r.doc_id, round(r.x, 6)) for r in again), key=repr)
    places = {(r.x, r.y) for r in got if r.doc_id == 4 or r.doc_id is not None and 200 <= r.doc_id < 230}
    assert len(places) == 1
    assert umap.embed(made(spark, [])).collect() == [] and umap.spread(umap.embed(made(spark, [(1, [("a", 1.0)])]))).collect()[0][1:] == (0.0, 0.0)
