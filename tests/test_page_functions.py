"""Table functions over pages, evidence of authors and titles judged up to the last word taken, on small literal tables."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import authors, keywords
from millrace.sources import html, page_functions

LISTING = '<table><tr><td>P1</td><td><a href="/poster/?id=7">A &amp; b</a></td><td>Jane</td></tr><tr><td>x</td></tr></table>'
PAPERS = '<table><tr><td>1</td><td>First</td><td>Ann</td><td><a href="abstract_3.pdf">a</a></td></tr><tr><td>2</td><td>Last</td><td>Bob</td><td><a href="abstract_3.pdf">b</a></td></tr></table>'
DETAIL = '<h1>On nets</h1><p>Keywords: nets, words</p><a href="/p.PDF?x=1">pdf</a>'


@pytest.fixture(scope="module")
def pages(spark):
    page_functions.register(spark)
    rows = [(1, "http://x.org/a/", LISTING), (2, "http://x.org/a/", PAPERS), (3, "http://x.org/a/", DETAIL), (4, None, None), (5, "http://x.org/", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def joined(spark, pages, call):
    return [tuple(r) for r in spark.sql(f"SELECT p.page_id, r.* FROM {{pages}} p, LATERAL {call} r ORDER BY 1, 2", pages=pages).collect()]


def test_listing(spark, pages):
    assert joined(spark, pages, r"page_listing(p.html, p.url, '/poster/\\?id=', 3)") == [(1, "7", "P1", "A & b", "Jane", "", "http://x.org/poster/?id=7")]
    assert joined(spark, pages, "page_listing(p.html, p.url, NULL, 3)") == []


def test_papers_keep_the_last_of_a_number(spark, pages):
    assert joined(spark, pages, r"paper_listing(p.html, p.url, 'abstract_(\\w+)\\.pdf', 4)") == [(2, "3", "Last", "Bob", "http://x.org/a/abstract_3.pdf")]


def test_anchors_as_the_plain_function(spark, pages):
    got = joined(spark, pages, r"page_anchors(p.html, p.url, '(\\d)', 1)")
    want = [(r.page_id, a["id"], a["title"], a["url"]) for r in pages.collect() for a in html.anchors(r.html or "", r.url or "", r"(\d)", 1)]
    assert got == sorted(want) and len(got) == 3


def test_detail_of_empty_pages_is_empty(spark, pages):
    got = {r[0]: r[1:] for r in joined(spark, pages, "page_detail(p.html, p.url)")}
    assert got[3] == ("On nets", "", "", "nets, words", "", "", "http://x.org/p.PDF?x=1")
    assert got[4] == got[5] == ("",) * 7


def test_no_pages(spark, pages):
    assert joined(spark, pages.limit(0), "page_detail(p.html, p.url)") == []


def test_evidence(spark):
    rows = spark.createDataFrame([(0, "Ada Lovelace 1 (a@x.edu), Élodie Durand 2 ; 1 Uni"), (1, None), (2, "Ada Lovelace and bob"), (3, "plain")], "k int, t string")
    got = {r.k: r for r in rows.select("k", authors.evidence(F.col("t")).alias("e"), authors.block_score(F.col("t")).alias("s"), authors.authors_are_thin(F.col("t")).alias("thin")).collect()}
    assert (got[0].e.names, got[0].e.people, got[0].e.address, got[0].s) == (2, 3, True, 4 + 2 + 3 + 5 + 3 + 1 + 1)
    assert (got[1].s, got[1].thin, got[2].s, got[2].thin, got[3].s) == (0, True, 4, False, 0)


def test_paragraphs(spark):
    texts = ["Poster 3 in hall", "Poster session", "the Poster <b> poster session", "View PDF of it", None, "Poster " + "x" * 170 + " in hall", "An extended abstract: it"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    assert [r[0] for r in rows.select(authors.is_noise_paragraph(F.col("t"))).collect()] == [True, True, False, True, True, False, True]
    texts = ["Ada Lovelace, Alan Turing", "Éa Ba, Ab Cd", "Name 1 , other ; 1 Uni", "Presenter: Ada Lovelace, Alan Turing", None, "a (b@c.de)", "x" * 700 + "Ada Lovelace, Alan Turing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    assert [r[0] for r in rows.select(authors.is_author_block(F.col("t"), F.lit("<p>"))).collect()] == [True, False, True, False, False, True, False]


def test_title_keywords_stop_at_the_limit(spark):
    rows = spark.createDataFrame([(0, "the nets nets of brains shows poster words in long titles again more"), (1, None), (2, "")], "k int, t string").orderBy("k")
    assert [r[0] for r in rows.select(keywords.title_keywords(F.col("t"), limit=3)).collect()] == [["nets", "brains", "words"], [], []]


def test_cut_references_stand_as_written(spark, tmp_path):
    import duckdb

    from millrace.extraction_queries import SQL, detail_fields

    page = '<html><head><title>x</title></head><body><nav><ul><li><a href="/a">one &amp; b</a></li></ul></nav><h1>a &amp;&amp; b&amp</h1><p>short</p><div class="ad">c&copy</div><footer>© d&amp;copy; e &#39</footer></body></html>'
    spark.createDataFrame([(1, "http://x.org/", page)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(SQL["detail_fields"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'"))
    got = detail_fields(spark, str(tmp_path)).select(*want.columns).collect()
    assert [tuple(r) for r in got] == want.fetchall()
    assert got[0].title == "a && b&amp" and got[0].keywords == "c&copy"
