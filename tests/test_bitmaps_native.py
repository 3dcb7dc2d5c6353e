"""Bitmaps of selections, years and topics meet without Python, so no batch of bitmaps stands in a worker."""

from millrace import queries

FOLDER = "/root/testdata/sf0.001"


def test_no_bitmap_goes_to_python(spark):
    for query in (queries.bitmap_year_topics, queries.bitmap_topic_counts_include):
        plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan
        assert "bitmap_and_agg" in plan
