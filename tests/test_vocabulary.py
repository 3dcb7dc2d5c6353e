"""The vocabulary by a floor of uses."""

from millrace.operators import vectors


def test_vocabulary_is_exact_where_the_floor_is_guessed_too_high(spark, monkeypatch):
    texts = ["a1 b2 c3 " * 50] * 3 + ["d4 e5 f6", "d4 e5 g7", "f6 d4"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, vectors.tfidf(docs, most=10, share=1.0).collect()))
    terms = {t for _, t, _ in want}
    assert {"a1", "c3 a1", "d4", "e5"} <= terms and len(terms) == 10
    monkeypatch.setattr(vectors.np, "median", lambda sums: -1000)  # a floor above all uses but the repeated ones'
    assert sorted(map(tuple, vectors.tfidf(docs, most=10, share=1.0).collect())) == want
