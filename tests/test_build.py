"""The build job end to end, and text of papers."""

import json

from pyspark.sql import functions as F

from millrace.plans.build import build, repair_only, restore, serialised, statistics
from millrace.plans.facets import Vocabulary
from millrace.sources import archive, papers


def got_rows(spark, tmp_path):
    return spark.read.parquet(f"{tmp_path}/out/rows")


def test_build(spark, tmp_path):
    rows = [
        {"id": "1", "year": 2018, "title": "Neural coding of memory", "authors": "ada lovelace 1, MIT", "abstract": "Coding in memory networks", "author_keywords": ["fMRI", "workingmemory"], "topic_area": "Memory"},
        {"id": "1", "year": 2019, "title": "Vision models", "authors": "Bob Ray", "abstract": "Models of vision", "keywords": [], "track": "Vision"},
        {"id": "2", "year": 2019, "title": "[GAC update] news", "authors": "", "abstract": ""},
        {"id": "3", "year": 2019, "title": "Memory of vision", "authors": None, "abstract": None, "author_keywords": ["fMRI"]},
    ]
    (tmp_path / "p.json").write_text(json.dumps({"metadata": {}, "submissions": rows, "stats": {}}))
    cache = spark.createDataFrame([("2019:1", ["Everything else", "Vision"])], "row_key string, assigned_topics array<string>")
    got = {r.row_key: r for r in build(spark, str(tmp_path / "p.json"), str(tmp_path / "out"), Vocabulary(("Memory", "Vision", "Everything else"), "Memory"), cache).collect()}
    assert set(got) == {"2018:1", "2019:1", "2019:3"}
    assert got["2018:1"].keywords == ["fmri", "working memory"] and got["2018:1"].authors == "Ada Lovelace"
    assert got["2019:1"].assigned_topics == ["Vision"] and got["2018:1"].assigned_topics[0] == "Memory"
    assert got["2019:1"].keywords == ["vision"]
    back = archive.read_explorer(spark, f"{tmp_path}/out/table")
    assert back.count() == 3 and back.where("x is not null").count() >= 2
    # fresh labels are kept: a second build asks for none
    class Own:
        def __call__(self, title, abstract, keywords):
            raise AssertionError(title)

    class First:
        def __call__(self, title, abstract, keywords):
            return "Vision", []

    args = (spark, str(tmp_path / "p.json"), str(tmp_path / "out2"), Vocabulary(("Memory", "Vision", "Everything else"), "Memory"), cache)
    one = {r.row_key: r.assigned_topics for r in build(*args, First(), cache_path=str(tmp_path / "labels")).collect()}
    assert one == {"2018:1": ["Vision"], "2019:1": ["Vision"], "2019:3": ["Vision"]} and archive.read_labels(spark, str(tmp_path / "labels")).count() == 2
    two = {r.row_key: r.assigned_topics for r in build(*args, Own(), cache_path=str(tmp_path / "labels")).collect()}
    assert one == two
    assert spark.read.json(f"{tmp_path}/out2/embeddings/metadata").first()["count"] >= 2
    kept = repair_only(spark, str(tmp_path / "p.json"), str(tmp_path / "out2"))
    assert {r.row_key: r.assigned_topics for r in kept.collect()} == one and archive.read_payload(spark, f"{tmp_path}/out2/payload").count() == 3
    restored = restore(spark, f"{tmp_path}/out2/table", [f"{tmp_path}/out2/table"], f"{tmp_path}/restored", only_empty=False)
    assert restored.count() == 3 and archive.read_explorer(spark, f"{tmp_path}/restored").where("id = '1' and year = 2018").first().keywords == ["fmri", "working memory"]
    names = {r.name for r in serialised(statistics(got_rows(spark, tmp_path))).collect()}
    assert names == {"overall_top", "by_year", "topics_by_year", "cooccurrence", "counts_by_year"}
    top = {(r.keyword, r.n) for r in spark.read.parquet(f"{tmp_path}/out/overall_top").collect()}
    assert ("fmri", 2) in top


def test_papers(spark):
    text = "Title Of It\nAda Lovelace (ada@x.edu), Alan Turing (at@y.org)\nUniversity of X\nAbstract\nWe Show Things"
    both = [text, "A Title Here of things\nAda Lovelace, Alan Turing and Grace Hopper\nSome text\nKeywords x", None]
    read = spark.createDataFrame([(k, t) for k, t in enumerate(both)], "k int, t string").orderBy("k").select(papers.authors_of(F.col("t")).alias("a"))
    assert [r.a for r in read.collect()] == ["Ada Lovelace, Alan Turing", "Ada Lovelace, Alan Turing, Grace Hopper", ""]
    assert papers.keyword_block("x Keywords: a; b\nc\n\nmore") == "a; b c" and papers.keyword_block(None) == ""
    titles = spark.createDataFrame([("1", "Neural coding of memory"), ("2", "Else")], "id string, title string")
    files = spark.createDataFrame([("neural_coding_memory.pdf",), ("neural-vision.pdf",), ("other.pdf",)], "name string")
    got = [(r.id, r.name, r.rank) for r in papers.papers_of_titles(titles, files).orderBy("rank").collect()]
    assert got[0] == ("1", "neural_coding_memory.pdf", 1) and {g[0] for g in got} == {"1"}
