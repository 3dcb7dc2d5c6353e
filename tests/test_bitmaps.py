"""Facet answers from bitmaps, against the rows."""

import random
from collections import Counter

import pytest

from millrace.operators.bitmaps import FacetBitmaps
from millrace.plans.facets import FacetQuery


@pytest.fixture(scope="module")
def both(spark):
    """Rows over several buckets of bits, most of them of one year and topic; null and repeated topics, null years, repeated rows."""
    rng = random.Random(1)
    rows = [(k, 2000 if rng.random() < 0.4 else rng.choice([1999, 2001, None]), rng.choice([["a"], ["a", "b"], ["b", "a", "a"], ["c", None], [], None, ["a", "b", "c"]])) for k in range(70_000)]
    rows += [rows[5], rows[5], (None, 2000, ["a", "b"])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "id int, year int, topics array<string>, place int, bits string").repartition(4)
    return rows, FacetBitmaps(table, ["id"])


QUERIES = [FacetQuery(), FacetQuery(topics=("a", "b")), FacetQuery(topics=("a", "b"), mode="exclude"), FacetQuery(years=(1999, 2000), topics=("c",)), FacetQuery(topics=("nowhere",)), FacetQuery(topics=("nowhere",), mode="exclude", years=(2001,)), FacetQuery(years=(1800,))]


@pytest.mark.parametrize("query", QUERIES)
def test_answers(both, query):
    rows, bits = both

    def matches(year, topics):
        every = set(query.topics) <= set(topics or ())
        return (not query.years or year in query.years) and (not query.topics or (every if query.mode == "include" else not every))

    kept = [r for r in rows if matches(r[1], r[2])]
    found = bits.select(query)
    assert found.agg(bits.size(found)).first()[0] == len(kept)
    assert {r.value: r.n for r in bits.counts(found, "topic").collect()} == Counter(t for r in kept for t in set(r[2] or ()) - {None})
    assert {r.value: r.n for r in bits.counts(found, "year").collect()} == Counter(str(r[1]) for r in kept if r[1])
    assert {(r.year, r.topic): r.n for r in bits.pivot(found).collect()} == Counter((r[1], t) for r in kept if r[1] for t in set(r[2] or ()) - {None})
    assert Counter((r.id, r.year) for r in bits.selected_rows(found).collect()) == Counter(r[:2] for r in kept)


def test_a_search_meets_facets(both):
    rows, bits = both
    places = bits.rows.where("key0 % 10 = 3").select("place")
    found = bits.select(FacetQuery(topics=("a",)), places)
    assert found.agg(bits.size(found)).first()[0] == sum(r[0] is not None and r[0] % 10 == 3 and "a" in (r[2] or ()) for r in rows)


def test_no_rows(spark):
    bits = FacetBitmaps(spark.createDataFrame([], "id int, year int, topics array<string>"), ["id"])
    found = bits.select(FacetQuery(topics=("a",), mode="exclude"))
    assert found.agg(bits.size(found)).first()[0] == 0 and bits.counts(found, "topic").collect() == [] and bits.pivot(found).collect() == [] and bits.selected_rows(found).collect() == []
