"""Substring search by trigrams, and nearest points by a quadtree, against all pairs."""

import math
import random

import numpy as np
import pytest

from millrace.functions.text import normalize_search
from millrace.operators import trigrams
from millrace.operators.quadtree import nearest_points


def folded(rng, n):
    return " ".join("".join(rng.choices("abc1", k=rng.randint(1, 5))) for _ in range(n))


def test_search(spark):
    """Short, missing, compact and repeated searches; null texts, long ones, repeated rows."""
    rng = random.Random(2)
    rows = [(k, folded(rng, rng.choice([1, 4, 30]))) for k in range(300)] + [(7, "abc ab1"), (7, "abc ab1"), (None, "cab cab"), (301, None), (302, ""), (303, "zz " * 400_000 + "needle")]
    searches = [(1, "abc a"), (1, "Abc  A"), (2, "ab"), (3, "c"), (4, "NEEDLE"), (5, "zzz"), (6, None), (7, " "), (None, "cab c"), (8, "ábc"), (9, "a-b"), (10, rows[0][1])]
    left = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id int, search_text string, block int, place int, trigram int").repartition(3)
    index = trigrams.TrigramIndex(left)
    got = index.search(spark.createDataFrame([(k, s, "x") for k, s in searches], "item_id int, search string, needle string"))
    want = []
    for key in dict.fromkeys(k for k, _ in searches):
        needles = {n for k, s in searches if k == key and (f := normalize_search(s or "")) for n in (f, f.replace(" ", ""))}
        want += [(key, i) for i, t in rows if any(n in (t or "") for n in needles)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_search_reads_few_lists(spark):
    """The scan of the lists is told which trigrams it needs, and what it finds is little of the whole."""
    rng = random.Random(3)
    rows = [(k, folded(rng, 20)) for k in range(2000)] + [(5000, "a rare word: xylophone".replace(":", ""))]
    index = trigrams.TrigramIndex(spark.createDataFrame(rows, "doc_id int, search_text string"))
    needles = index.needles(spark.createDataFrame([(1, "xylophone")], "item_id int, search string"), "item_id", "search")
    hits = index.candidates(needles)
    plan = hits._jdf.queryExecution().toString()
    assert "In(trigram" in plan and hits.count() == 1
    lists = index.postings.count()
    assert index.postings.where("trigram in (select 0)").count() <= lists / 10
    assert [tuple(r) for r in index.search(spark.createDataFrame([(1, "xylophone")], "item_id int, search string")).collect()] == [(1, 5000)]


def test_search_of_nothing(spark):
    rows, searches = spark.createDataFrame([], "doc_id int, search_text string"), spark.createDataFrame([(1, "abc"), (2, "a")], "item_id int, search string")
    assert trigrams.TrigramIndex(rows).search(searches).collect() == []
    assert trigrams.TrigramIndex(spark.createDataFrame([(1, "abc")], "doc_id int, search_text string")).search(searches.limit(0)).collect() == []


def test_trigrams_follow_slices(monkeypatch):
    text = folded(random.Random(4), 300)
    want = sorted({tuple(text[k : k + 3]) for k in range(len(text) - 2)})
    whole = trigrams.trigrams(text)
    assert len(whole) == len(want)
    monkeypatch.setattr(trigrams, "SLICE", 7)
    assert (trigrams.trigrams(text) == whole).all() and len(trigrams.trigrams("ab")) == 0


def points_of(seed, n):
    """A dense cluster with a third of all points in one place, a spread rest, points on lines, and broken ones."""
    rng = np.random.default_rng(seed)
    rows = [(k, *map(float, p)) for k, p in enumerate(np.vstack([rng.normal(0, 1e-3, (n, 2)), rng.uniform(-50, 90, (n // 4, 2)), np.column_stack([np.arange(20.0), np.zeros(20)])]))]
    rows += [(10_000 + k, 0.25, -0.5) for k in range(n // 2)]
    return rows + [(rows[3][0], *rows[3][1:]), (None, 0.25, -0.5), (None, 5.0, 5.0), (20_001, None, 1.0), (20_002, float("nan"), 1.0), (20_003, float("inf"), 0.0)]


@pytest.mark.parametrize(("k", "radius"), [(1, None), (6, None), (4, 1.5)])
def test_nearest_points(spark, k, radius):
    rows = points_of(k, 300)
    taps = [(1, 0.0, 0.0), (2, 0.25, -0.5), (3, 1000.0, -2000.0), (4, 30.0, 30.0), (5, 9.5, 0.0), (6, 0.0, 0.0), (6, 0.0, 0.0), (None, 5.0, 5.1), (7, None, 0.0), (8, -0.0, 0.0)]
    left = spark.createDataFrame([(*t, 1, 2) for t in taps], "tap_id int, x double, y double, cx int, n int")
    right = spark.createDataFrame([(*p, 1, 2) for p in rows], "vec_id int, x double, y double, cy int, rank int").repartition(3)
    want = []
    good = [p for p in rows if all(v is not None and math.isfinite(v) for v in p[1:])]
    for tap, x, y in (t for t in taps if t[1] is not None):
        found = sorted((math.sqrt((px - x) ** 2 + (py - y) ** 2), i is None, i or 0) for i, px, py in good)
        want += [(tap, n + 1, None if none else i, round(d, 9)) for n, (d, none, i) in enumerate(found[:k]) if radius is None or d <= radius]
    got = nearest_points(left, right, k, radius).collect()
    assert sorted(((r.tap_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in got), key=repr) == sorted(want, key=repr)


def test_nearest_points_of_nothing(spark):
    taps, points = spark.createDataFrame([(1, 0.0, 0.0)], "tap_id int, x double, y double"), spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 2.0)], "vec_id int, x double, y double")
    assert nearest_points(taps, points.limit(0)).collect() == [] and nearest_points(taps.limit(0), points).collect() == []
    assert [tuple(r) for r in nearest_points(taps, points, 3).collect()] == [(1, 1, 1, math.sqrt(8)), (1, 2, 2, math.sqrt(8))]
