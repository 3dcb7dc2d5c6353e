"""Texts that are searched once are neither indexed nor shuffled; what is found is what the index finds."""

import random
from pathlib import Path

import pytest

from millrace.functions.text import normalize_search
from millrace.operators import trigrams
from millrace.queries import QUERIES


def folded(rng, n):
    return " ".join("".join(rng.choices("abc1", k=rng.randint(1, 5))) for _ in range(n))


def work_tables(spark):
    at = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    return set(at.glob("millrace-trigrams-*")) | set(at.glob("millrace-searches-*"))


def test_the_query_writes_and_shuffles_no_texts(spark):
    before = work_tables(spark)
    found = QUERIES["search_many"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and work_tables(spark) == before
    assert plan.count("regexp_replace") == 1  # each text is folded once


@pytest.mark.parametrize(("slice_of", "one_pass", "passes", "hits"), [(1 << 20, 2_000_000, 8, 1 << 16), (40, 2_000_000, 8, 3), (1 << 20, 60, 99, 1 << 16), (1 << 20, 10, 1, 1 << 16)])
def test_search_many(spark, monkeypatch, slice_of, one_pass, passes, hits):
    """Short, missing, compact, shared, nested and repeated searches; null, empty, long and repeated texts; null keys and ids; slices, batches of hits, several passes, and more searches than these take."""
    monkeypatch.setattr(trigrams, "SLICE", slice_of)
    monkeypatch.setattr(trigrams, "ONE_PASS", one_pass)
    monkeypatch.setattr(trigrams, "MOST_PASSES", passes)
    monkeypatch.setattr(trigrams, "HITS", hits)
    rng = random.Random(5)
    rows = [(k, folded(rng, rng.choice([1, 4, 30]))) for k in range(200)] + [(7, "abc ab1"), (7, "abc ab1"), (None, "cab cab"), (301, None), (302, ""), (303, "zz " * 3000 + "needle")]
    searches = [("a", "abc a"), ("a", "Abc  A"), ("b", "ab"), ("c", "c"), ("d", "NEEDLE"), ("d2", "needle"), ("e", "zzz"), ("f", None), ("g", " "), (None, "cab c"), ("h", "ábc"), ("i", "a-b"), ("j", "ab"), ("k", rows[0][1]), ("l", rows[9][1])]
    left = spark.createDataFrame(rows, "doc_id int, search_text string").repartition(3)
    got = trigrams.search_many(left, spark.createDataFrame(searches, "item_id string, search string"))
    want = []
    for key in dict.fromkeys(k for k, _ in searches):
        needles = {n for k, s in searches if k == key and (f := normalize_search(s or "")) for n in (f, f.replace(" ", ""))}
        want += [(key, i) for i, t in rows if any(n in (t or "") for n in needles)]
    assert got.columns == ["item_id", "doc_id"] and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_search_many_of_nothing(spark):
    rows, searches = spark.createDataFrame([(1, "abc")], "doc_id int, search_text string"), spark.createDataFrame([(1, "abc"), (2, " "), (3, None)], "item_id int, search string")
    assert [tuple(r) for r in trigrams.search_many(rows, searches).collect()] == [(1, 1)]
    assert trigrams.search_many(rows, searches.where("item_id > 1")).collect() == []
    assert trigrams.search_many(rows, searches.limit(0)).collect() == []
    assert trigrams.search_many(rows.limit(0), searches).collect() == []
