"""Table functions over pages for SQL: rows of listings, anchors and details by ``LATERAL``.

``register`` makes them known to a session.  A null page or address counts as empty; an empty page gives no row
of a listing and one row of empty fields of a detail; null patterns give no rows.  Each call
sees one page, so a query over pages needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from millrace.sources import html


def _rows(found: list[dict], *names: str) -> Iterator[tuple]:
    for row in found:
        yield tuple(row.get(n, "") for n in names)


@udtf(returnType="id string, poster_number string, title string, presenter string, topic string, url string")
class PageListing:
    """Table rows with a matching link, as ``html.listing``."""

    def eval(self, page: str, base: str, link: str, cells: int):
        if link is not None and cells is not None:
            yield from _rows(html.listing(page or "", base or "", link, cells), "id", "poster_number", "title", "presenter", "topic", "url")


@udtf(returnType="id string, title string, authors string, url string")
class PaperListing:
    """Table rows that link a paper, the last of each number, as ``html.paper_listing``."""

    def eval(self, page: str, base: str, link: str, cells: int):
        if link is not None and cells is not None:
            yield from _rows(html.paper_listing(page or "", base or "", link, cells), "id", "title", "authors", "url")


@udtf(returnType="id string, title string, url string")
class PageAnchors:
    """Links of an older listing, the last of each number, as ``html.anchors``."""

    def eval(self, page: str, base: str, link: str, least: int):
        if link is not None and least is not None:
            yield from _rows(html.anchors(page or "", base or "", link, least), "id", "title", "url")


@udtf(returnType="title string, abstract string, authors string, keywords string, topic_area string, presenter string, paper string")
class PageDetail:
    """The fields of one page and the address of its paper, as ``html.detail`` and ``html.paper_link``."""

    def eval(self, page: str, base: str):
        own = html.detail(page or "") | {"paper": html.paper_link(page or "", base or "")}
        yield from _rows([own], "title", "abstract", "authors", "keywords", "topic_area", "presenter", "paper")


FUNCTIONS = {"page_listing": PageListing, "paper_listing": PaperListing, "page_anchors": PageAnchors, "page_detail": PageDetail}


def register(spark: SparkSession) -> SparkSession:
    """The functions under their names in SQL, for this session."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
    return spark
