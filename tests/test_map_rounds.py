"""Rounds of the map."""

import numpy as np
import pytest

from millrace.operators import umap
from millrace.tables import Work


def test_rounds_of_the_map_move_lists_not_points(spark, monkeypatch):
    """A round writes a row for each part and pair of parts, not for each point or link; the map does not depend on the parts."""
    rng, made = np.random.default_rng(2), []
    docs = [(n, [f"t{t}" for t in rng.choice(30, 6, replace=False)], [6**-0.5] * 6) for n in range(150)]
    rows = spark.createDataFrame(docs, "doc_id int, terms array<string>, weights array<double>")
    keep = Work.keep
    monkeypatch.setattr(Work, "keep", lambda self, df, name="t": made.append((name, kept := keep(self, df, name), kept.count())) or kept)
    whole = {r.doc_id: (r.x, r.y) for r in umap.embed(rows, k=5, rounds=2).collect()}
    monkeypatch.setattr(umap, "PART", 40)
    some = {r.doc_id: (r.x, r.y) for r in umap.embed(rows, k=5, rounds=2).collect()}
    counts = [n for name, _, n in made if name == "placed"]
    assert len(counts) == 4 and max(counts) <= 4 + 4 * 4
    assert set(some) == set(whole) == set(range(150)) and len(set(whole.values())) > 100
    assert all(some[n] == pytest.approx(whole[n], abs=1e-6) for n in whole)
