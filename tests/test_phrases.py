"""Phrases by an automaton, and tops of keywords from one scan, against plain counts."""

import random
from collections import Counter

import pytest

from millrace.operators import counts
from millrace.operators.phrases import phrase_hits, phrases_of


@pytest.mark.parametrize("block", [100_000, 700])
def test_phrase_hits(spark, block):
    """A vocabulary of thousands in one automaton and in several: overlaps, whole words, repeated rows, null and long texts."""
    rng = random.Random(1)
    words = ["".join(rng.choices("ab1", k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 30])))) for k in range(150)] + [(5, "a a a a"), (5, "a a a a"), (None, "ab ab"), (9, None), (10, "a b " * 50_000)]
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(3000)} | {"a a", "a b a", "a"}
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, search_text string, phrase string, n int").repartition(3)
    vocabulary = spark.createDataFrame([(p, 1) for p in [*phrases, "a a", "", None, " a a "]], "phrase string, doc_id int")
    want = []
    for i, t in rows:
        w = (t or "").split()
        found = Counter(" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
        want += [(i, p, n) for p, n in found.items() if p in phrases]
    assert sorted(map(tuple, phrase_hits(table, vocabulary, block=block).collect()), key=repr) == sorted(want, key=repr)


def test_phrases_of_texts_and_nothing(spark):
    texts = spark.createDataFrame([("a b c",), ("b c",), (None,), ("",)], "search_text string")
    assert sorted(r.phrase for r in phrases_of(texts, (1, 2)).collect()) == ["a", "a b", "b", "b c", "c"]
    none = spark.createDataFrame([], "doc_id int, search_text string, phrase string")
    some = spark.createDataFrame([(1, "a b", "a")], "doc_id int, search_text string, phrase string")
    assert phrase_hits(none, some).collect() == [] and phrase_hits(some, none).collect() == []


def test_keyword_tops(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([2000, 2001, None]), rng.choice([None, [], rng.choices("abcdefgh", weights=range(1, 9), k=4), ["h", "", None]])) for k in range(400)]
    table = spark.createDataFrame([(*r, 1, True) for r in rows], "row_ord int, year int, keywords array<string>, rank int, whole boolean").repartition(3)
    got = {}
    for r in counts.keyword_tops(table, "keywords", 5, 2).collect():
        got.setdefault(r.year, []).append((r["rank"], r.keyword, r.n))
    for year, most in ((None, 5), (2000, 2), (2001, 2)):
        n, first = Counter(), {}
        for o, y, words in rows:
            for place, w in enumerate(dict.fromkeys(words or ())):
                if w and (year is None or y == year):
                    n[w] += 1
                    first.setdefault(w, (o, place))
        want = sorted(n, key=lambda w: (-n[w], first[w]))[:most]
        assert sorted(got[year]) == [(k + 1, w, n[w]) for k, w in enumerate(want)]
    assert counts.keyword_tops(table.limit(0), "keywords", 5, 2).collect() == []
