"""Fetching in waves, ranks by ranges, and years of which pages failed."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators.ranks import numbered
from millrace.plans import acquire
from millrace.sources import crawl


def site_of(log, down=(), deadly=None):
    """Answers by address; every request is noted in a file, as tasks run elsewhere."""
    log, down = str(log), set(down)

    def read(url):
        with open(log, "a") as out:
            out.write(f"{url}\n")
        if url == deadly:
            raise SystemExit(1)  # the worker is lost, and the job with it
        if url in down:
            raise OSError("down")
        return f"body of {int(url.rsplit('/', 1)[1]) % 7}"

    return read


def asked(log):
    with open(log) as lines:
        return Counter(lines.read().split())


def addresses(spark, n=60):
    urls = [f"http://{'hot' if k % 3 else f'h{k}'}.example/{k}" for k in range(n)]
    return urls, spark.createDataFrame([(u, 1, b"x") for u in [*urls, urls[0], urls[1], None, ""]], "url string, host int, body binary")


def test_crawl(spark, tmp_path):
    """Every address once; equal bodies once; those that failed are asked again, the others are not."""
    urls, table = addresses(spark)
    down = {urls[4], urls[9]}
    site, store = site_of(tmp_path / "log", down), f"{tmp_path}/store"
    got = {r.url: r for r in crawl.crawl(table, store, site, retries=2, wait=0.0, pause=0.0, wave=25, tasks=2).collect()}
    assert set(got) == set(urls) and {u for u, r in got.items() if r.error} == {urls[4], urls[9]}
    assert asked(tmp_path / "log") == Counter({u: 2 if u in down else 1 for u in urls}) and got[urls[4]].tries == 2 and "down" in got[urls[4]].error
    held = {r.digest: bytes(r.body) for r in crawl.bodies(spark, store).collect()}
    assert len(held) == 7 and all(held[got[u].digest] == f"body of {k % 7}".encode() for k, u in enumerate(urls) if u not in down)
    later = site_of(tmp_path / "later")
    again = crawl.crawl(table, store, later, wait=0.0, pause=0.0, tasks=2).collect()
    assert set(asked(tmp_path / "later")) == {urls[4], urls[9]} and all(r.digest and not r.error for r in again)
    assert len(crawl.bodies(spark, store).collect()) == 7


def test_crawl_goes_on_after_a_loss(spark, tmp_path):
    """What finished waves have answered is not asked again by the job that follows."""
    urls, table = addresses(spark)
    store = f"{tmp_path}/store"
    with pytest.raises(Exception):  # noqa: B017, PT011 - whatever a lost worker is reported as
        crawl.crawl(table, store, site_of(tmp_path / "first", deadly=urls[10]), wait=0.0, pause=0.0, wave=12, tasks=1)
    kept = {r.url for r in crawl.stored(spark, store).collect()}
    second = site_of(tmp_path / "second")
    got = crawl.crawl(table, store, second, wait=0.0, pause=0.0, wave=12, tasks=1).collect()
    assert {r.url for r in got if r.digest} == set(urls) and not set(asked(tmp_path / "second")) & kept and set(asked(tmp_path / "second")) == set(urls) - kept


def test_crawl_keeps_to_the_pause(spark, tmp_path):
    """A lane's requests are a pause apart; other hosts go on meanwhile."""
    import time

    frame = next(iter([__import__("pandas").DataFrame({"url": ["http://a/1", "http://a/2", "http://a/3", "http://b/1"], "host": ["a", "a", "a", "b"], "lane": [0, 0, 0, 0]})]))
    times = {}
    list(crawl._asking(lambda url: times.setdefault(url, time.monotonic()) and "x", 1, 0.0, 0.1)(iter([frame])))
    assert times["http://a/2"] - times["http://a/1"] >= 0.1 and times["http://a/3"] - times["http://a/2"] >= 0.1 and times["http://b/1"] < times["http://a/2"]


def test_crawl_of_nothing(spark, tmp_path):
    assert crawl.crawl(spark.createDataFrame([(None,), ("",)], "url string"), f"{tmp_path}/none", site_of(tmp_path / "log")).collect() == []


def test_numbered(spark):
    rows = [(k % 3 == 0, (k * 37) % 500, "x") for k in range(500)] + [(None, 7, "y"), (True, None, "y")]
    table = spark.createDataFrame(rows, "match boolean, ord int, part string").repartition(5)
    got = numbered(table, [F.asc_nulls_first("match"), F.asc_nulls_last("ord")]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or False, r[1] is None, r[1] or 0))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.place)] == want and [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(502))
    assert numbered(table.limit(0), [F.col("ord")]).collect() == []


def test_a_year_with_a_failed_page_keeps_its_old_rows(spark):
    """Two pages of one year, one of which failed: its rows from the other page do not stand beside the old ones."""
    columns = "id string, year int, title string, authors string, abstract string, topic_area string, track string, poster_number string, row_ord long"
    old = spark.createDataFrame([("1", 2018, "Old one", "", "", "", "", "", 0), ("2", 2019, "Old two", "", "", "", "", "", 1)], columns)
    new = spark.createDataFrame([("1", 2018, "New one", "", "", "", "", "", 0), ("2", 2019, "New two", "", "", "", "", "", 1)], columns)
    failed = spark.createDataFrame([(2018, "http://a/page2", "down")], "year int, url string, error string")
    got = acquire.update(old, *acquire.whole_years(new, failed, [2018, 2019]))
    assert sorted((r.year, r.title) for r in got.collect()) == [(2018, "Old one"), (2019, "New two")]
    rows, years = acquire.whole_years(new, failed, [2018])
    assert years == [] and rows.collect() == []
