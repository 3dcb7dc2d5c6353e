"""Jobs that fetch years of an archive: listings, details, papers, backfill, and the merge with what is there.

Pages are read by an injected ``get`` (url -> body) and papers by an injected ``extract`` (bytes -> text), so a
job runs against a network, a cache or a table alike.  A page that fails leaves its row as the
listing had it; a listing that fails leaves its year out, with a row among the failures.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import authors, keywords, text
from millrace.functions.columns import strings
from millrace.operators import fuzzy, merge
from millrace.plans.build import UPDATES, is_update
from millrace.session import ready
from millrace.sources import archive, html, papers
from millrace.tables import Work

Get = Callable[[str], bytes | str]
Post = Callable[[str, dict[str, str]], bytes | str]
Extract = Callable[[bytes], str]

#: How a listing is read: a table of posters, links of an older site, a table of papers.
KINDS = {"table": html.listing, "anchors": html.anchors, "papers": html.paper_listing}
_LISTED = ("id", "title", "presenter", "authors", "topic", "poster_number", "url")
_DETAIL = ("title", "abstract", "authors", "keywords", "topic_area", "presenter", "paper_url")
_LISTS = ("author_keywords", "extracted_keywords", "keywords")


@dataclass(frozen=True)
class YearSource:
    """Where a year is listed, how the listing is read, and what its links look like.

    With ``form`` the listing is the answer to a posted form.  A year of several pages has a source for each.
    """

    year: int
    url: str
    kind: str = "table"
    link: str | None = None
    form: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Rules:
    """What differs between archives: years with papers, years whose labels count as keywords, titles that are no submissions."""

    paper_years: tuple[int, ...] = ()
    label_years: tuple[int, ...] = ()
    combined_years: tuple[int, ...] = ()
    updates: str = UPDATES
    keywords: keywords.KeywordRules = field(default=keywords.DEFAULT)


def listings(spark: SparkSession, sources: list[YearSource], get: Get | None = None, post: Post | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Rows (year, id, title, presenter, authors, topic, poster_number, url) of all listings, and failures (year, url, error).

    A listing without rows is a failure.
    """
    asked = spark.createDataFrame([(s.year, s.url, s.kind, s.link) for s in sources], "year int, url string, kind string, link string")
    work = Work(spark, "listings")
    forms, read, send = {s.url: s.form for s in sources if s.form}, get or archive.get, post or archive.post
    answer = lambda url: send(url, dict(forms[url])) if url in forms else read(url)
    pages = work.keep(archive.fetched(asked.select("url").distinct(), answer, **how).join(asked, "url"), "pages")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                page = bytes(r.body).decode("utf-8", "replace") if r.body is not None else ""
                link = {"link": r.link} if isinstance(r.link, str) else {}
                out += [(r.year, r.url, *[row.get(c) for c in _LISTED]) for row in KINDS[r.kind](page, r.url, **link)]
            yield pd.DataFrame(out, columns=["year", "listing", *_LISTED])

    rows = work.keep(pages.select("year", "url", "kind", "link", "body").mapInPandas(run, "year int, listing string, " + ", ".join(f"{c} string" for c in _LISTED)), "rows")
    found = rows.select("year", F.col("listing").alias("url")).distinct()
    failed = pages.join(found, ["year", "url"], "left_anti").select("year", "url", F.coalesce("error", F.lit("no rows")).alias("error"))
    return rows.drop("listing"), failed


def details(rows: DataFrame, get: Get | None = None, **how) -> DataFrame:
    """(url, title, abstract, authors, keywords, topic_area, presenter, paper_url) of each page that can be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for url, body in zip(frame["url"], frame["body"], strict=True):
                page = bytes(body).decode("utf-8", "replace")
                own = html.detail(page) | {"paper_url": html.paper_link(page, url)}
                out.append((url, *[own.get(c) or "" for c in _DETAIL]))
            yield pd.DataFrame(out, columns=["url", *_DETAIL])

    pages = archive.fetched(rows.select("url").where("url <> ''").distinct(), get, **how).where("body is not null")
    return pages.select("url", "body").mapInPandas(run, "url string, " + ", ".join(f"{c} string" for c in _DETAIL))


def _texts(spark: SparkSession, urls: DataFrame, extract: Extract | None, get: Get | None, known: DataFrame | None, **how) -> DataFrame:
    if extract is None:
        return known if known is not None else spark.createDataFrame([], "url string, text string")
    return archive.paper_texts(urls, extract, get, known, **how)


def scrape(spark: SparkSession, sources: list[YearSource], get: Get | None = None, extract: Extract | None = None, rules: Rules = Rules(), known_texts: DataFrame | None = None, prior: DataFrame | None = None, post: Post | None = None, **how) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Submissions of all sources, with ``row_ord`` in the order of years and posters, and failures (year, url, error).

    Authors are the page's if they are not thin, else the paper's, the listing's and the presenter. Keywords are the
    page's, else the paper's, else the conference's label.  Missing tracks and abstracts come from ``prior`` (year, title,
    track, abstract), by exact or close title, within the year or from rows of no year.
    """
    work = Work(ready(spark), "scrape")
    listed, failed = listings(spark, sources, get, post, **how)
    is_paper = F.col("url").rlike(r"(?i)\.pdf(?:$|[?#])")
    pages = work.keep(details(listed.where(~is_paper), get, **how), "details")
    d = pages.select("url", *[F.col(c).alias(f"d_{c}") for c in _DETAIL])
    rows = listed.join(d, "url", "left").withColumn("paper_url", F.when(F.col("year").isin(*rules.paper_years) if rules.paper_years else F.lit(False), F.when(is_paper, F.col("url")).otherwise(F.col("d_paper_url"))))
    texts = work.keep(_texts(spark, rows.select(F.col("paper_url").alias("url")), extract, get, known_texts, **how), "texts")
    read = texts.select(F.col("url").alias("paper_url"), "text")
    rows = work.keep(rows.join(read, "paper_url", "left"), "rows")

    filled = merge.filled
    some = lambda *c: F.coalesce(*[filled(x) for x in c], F.lit(""))
    fields = html.pdf_fields(F.coalesce("text", F.lit("")))
    by_page, by_paper = F.coalesce("d_authors", F.lit("")), papers.authors_of(F.col("text"))
    thin = authors.authors_are_thin
    named = F.when(~thin(by_page), by_page).when(~thin(by_paper), by_paper).otherwise(some(by_page, by_paper, F.col("authors"), F.col("d_presenter"), F.col("presenter")))
    topic = some(F.col("d_topic_area"), F.col("topic"), fields["topic"])
    title = F.when(F.col("d_title").rlike(r"^\d{1,4}[-/.]\d{1,2}|^(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day\b"), None).otherwise(filled("d_title"))
    rows = rows.select(
        F.coalesce("id", F.lit("")).alias("id"),
        "year",
        text.normalize_field(F.coalesce(title, F.col("title"), F.lit(""))).alias("title"),
        authors.normalize_authors(named).alias("authors"),
        text.normalize_field(some(F.col("d_abstract"), fields["abstract"])).alias("abstract"),
        F.col("d_keywords").alias("raw"),
        "text",
        text.normalize_field(topic).alias("topic_area"),
        text.normalize_field(topic).alias("track"),
        text.unique_poster(F.coalesce("poster_number", F.lit("")), F.coalesce("id", F.lit(""))).alias("poster_number"),
        F.col("url").alias("source_url"),
        F.lit("poster").alias("submission_type"),
    )
    label = text.topic_label(F.col("topic_area"), F.col("track"))
    counts_ = F.col("year").isin(*rules.label_years) if rules.label_years else F.lit(False)
    own = keywords.finalized(keywords.parse_keywords(F.col("raw"), rules.keywords), papers.keyword_lists(F.col("text"), rules.keywords), label, counts_, rules.keywords)
    rows = rows.withColumn("own", own).select("*", *[F.col(f"own.{c}").alias(c) for c in _LISTS]).drop("own", "raw", "text")
    rows = work.keep(rows.where(~is_update(F.col("title"), rules.updates)), "submissions")
    if prior is not None:
        rows = work.keep(backfilled(rows, prior), "backfilled")
    ordered = rows.orderBy("year", F.coalesce(filled("poster_number"), F.lower("title")), "id")
    names = [x.split()[0] for x in archive.SUBMISSION.split(", ")]
    return ordered.withColumn("row_ord", F.monotonically_increasing_id()).select("row_ord", *names), failed


def backfilled(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """``rows`` whose empty track and abstract come from the row of ``prior`` (year, title, track, abstract) with the same or a close title."""
    old = archive.by_title(prior.withColumn("row_ord", F.monotonically_increasing_id())).select("title_key", F.col("track").alias("p_track"), F.col("abstract").alias("p_abstract"))
    keyed = rows.withColumn("title_key", text.title_key(F.col("title")))
    asked = keyed.where("title_key <> '' and (track = '' or abstract = '')").select("title_key").distinct()
    best = fuzzy.best_titles(asked.select(F.col("title_key").alias("left_id"), "title_key"), old.select(F.col("title_key").alias("right_id"), F.col("title_key").alias("right_key")))
    found = best.select("title_key", "right_key").join(old.withColumnRenamed("title_key", "right_key"), "right_key").drop("right_key")
    track, abstract = merge.pending_backfill((F.col("track"), F.col("abstract")), (F.col("p_track"), F.col("p_abstract")))
    return keyed.join(found, "title_key", "left").withColumns({"track": track, "abstract": abstract}).select(*rows.columns)


def enriched(rows: DataFrame, pages: DataFrame, texts: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``rows`` with their three lists of keywords resolved anew.

    ``pages`` (url, keywords, paper_url) and ``texts`` (url, text) are what was read; rows without either keep what they can.
    """
    p = pages.select(F.col("url").alias("source_url"), F.col("keywords").alias("p_raw"), F.col("paper_url").alias("p_paper")).dropDuplicates(["source_url"])
    t = texts.select(F.col("url").alias("p_paper"), F.col("text").alias("p_text")).dropDuplicates(["p_paper"])
    is_paper = F.col("source_url").rlike(r"(?i)\.pdf(?:$|[?#])")
    found = rows.join(p, "source_url", "left").withColumn("p_paper", F.when(is_paper, F.col("source_url")).otherwise(F.col("p_paper"))).join(t, "p_paper", "left")
    in_years = lambda years: F.coalesce(F.col("year").isin(*years), F.lit(False)) if years else F.lit(False)
    from_html = keywords.first_filled(
        keywords.initial_html_keywords(F.col("author_keywords"), F.col("keywords"), in_years(rules.combined_years) | ~in_years(rules.paper_years)),
        keywords.parse_keywords(F.col("p_raw"), rules.keywords),
    )
    label = text.topic_label(F.col("topic_area"), F.col("track"))
    own = keywords.finalized(from_html, papers.keyword_lists(F.col("p_text"), rules.keywords), label, in_years(rules.label_years), rules.keywords)
    return found.withColumn("p_own", own).withColumns({c: F.col(f"p_own.{c}") for c in _LISTS}).select(*[F.col(f"`{c}`") for c in rows.columns])


def refresh_keywords(rows: DataFrame, get: Get | None = None, extract: Extract | None = None, rules: Rules = Rules(), years: list[int] | None = None, force: bool = False, known_texts: DataFrame | None = None, **how) -> DataFrame:  # noqa: B008
    """``rows`` with ``gained``: keywords of those that a paper may help are read again; others stay.

    ``force`` also asks for rows that have keywords, and forgets those first.
    """
    spark = rows.sparkSession
    work = Work(ready(spark), "refresh")
    asked = keywords.needs_paper(F.col("author_keywords"), F.col("year"), F.col("source_url"), list(rules.paper_years), force)
    if years is not None:
        asked = asked & F.coalesce(F.col("year").isin(*years), F.lit(False))
    rows = work.keep(rows.withColumn("gained", asked), "rows")
    todo = rows.where("gained")
    if force:
        todo = todo.withColumns({c: strings() for c in _LISTS})
    is_paper = F.col("source_url").rlike(r"(?i)\.pdf(?:$|[?#])")
    pages = work.keep(details(todo.where(~is_paper).select(F.col("source_url").alias("url")), get, **how), "details")
    urls = pages.select(F.col("paper_url").alias("url")).unionByName(todo.where(is_paper).select(F.col("source_url").alias("url")))
    texts = work.keep(_texts(spark, urls, extract, get, known_texts, **how), "texts")
    done = enriched(todo, pages, texts, rules).withColumn("gained", F.size("author_keywords") > 0)
    return rows.where("not gained").unionByName(done)


def update(existing: DataFrame, scraped: DataFrame, years: list[int]) -> DataFrame:
    """An archive with ``years`` replaced by what was scraped, empty fields filled from what stood there."""
    key = text.title_key(F.col("title"))
    fields = ["title", "authors", "abstract", "topic_area", "track", "poster_number"]
    merged = merge.merge_years(existing.withColumn("title_key", key), scraped.select(*existing.columns).withColumn("title_key", key), years, fields, authors.block_score)
    return merged.drop("title_key")


def whole_years(scraped: DataFrame, failed: DataFrame, years: list[int]) -> tuple[DataFrame, list[int]]:
    """What was scraped of the years of which no page failed, and those years; of the others the archive keeps its own rows."""
    lost = {r["year"] for r in failed.select("year").distinct().collect()}
    whole = [y for y in dict.fromkeys(years) if y not in lost]
    return scraped.where(F.col("year").isin(*whole)) if whole else scraped.limit(0), whole


def main() -> None:
    parser = argparse.ArgumentParser(description="Scrape years of an archive into a payload.")
    parser.add_argument("sources", help="JSON list of {year, url, kind, link}")
    parser.add_argument("out")
    parser.add_argument("--years", nargs="*", type=int)
    parser.add_argument("--payload", help="what is there already; its rows of the scraped years are replaced")
    parser.add_argument("--refresh-keywords", action="store_true", help="only read keywords of the payload again")
    parser.add_argument("--force-keywords", action="store_true")
    asked = parser.parse_args()
    spark = ready(SparkSession.builder.getOrCreate())
    with open(asked.sources, encoding="utf-8") as file:
        sources = [YearSource(**(s | {"form": tuple(map(tuple, s.get("form", ())))})) for s in json.load(file)]
    chosen = [s for s in sources if not asked.years or s.year in asked.years]
    old = archive.read_payload(spark, asked.payload) if asked.payload else None
    if asked.refresh_keywords:
        rows = refresh_keywords(old, years=asked.years, force=asked.force_keywords).drop("gained")
    else:
        rows, failed = scrape(spark, chosen)
        if old is not None:
            rows = update(old, *whole_years(rows, failed, [s.year for s in chosen]))
    archive.write_payload(rows, asked.out)


if __name__ == "__main__":
    main()
