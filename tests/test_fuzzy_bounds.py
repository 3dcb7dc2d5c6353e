"""Titles of no fitting length and runs of no asked title are left out before anything is shuffled."""

from millrace.operators.fuzzy import best_titles


def test_only_runs_of_asked_titles_are_ranked(spark):
    left = spark.createDataFrame([(1, "a small title of things"), (2, "nothing like it")], "left_id int, title_key string")
    right = spark.createDataFrame([(1, "a small title of thing"), (2, "zzz " * 20_000), (3, "qq ww ee rr tt yy uu ii oo")], "right_id int, right_key string")
    found = best_titles(left, right)
    assert "high#" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.left_id, r.right_id) for r in found.collect()] == [(1, 1)]
    none = best_titles(left.limit(0), right)
    assert none.collect() == []
