"""Rows out of HTML pages, with the standard parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A name of two to four words, with footnote marks.
_PERSON = r"[A-ZÀ-ÖØ-Þ][\w.'’-]*(?:\s+[A-ZÀ-ÖØ-Þ][\w.'’-]*){1,3}\s*[\d*†,]*"
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


class _Page(HTMLParser):
    """Cells of table rows, anchors, paragraphs and headings, in page order."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.links: list[dict] = []
        self.blocks: list[dict] = []
        self.named: dict[str, str] = {}
        self.open: list[tuple[str, str]] = []
        self.skip = 0
        self.feed(page or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "tr":
            self.rows.append({"cells": [], "links": [], "classes": " ".join(c for _, c in self.open)})
        elif tag in ("td", "th") and self.rows:
            self.rows[-1]["cells"].append("")
        elif tag == "a" and own.get("href"):
            self.links.append({"href": own["href"], "text": ""})
            if self.rows and self.rows[-1]["cells"]:
                self.rows[-1]["links"].append(own["href"])
        elif tag in ("p", "h1", "h2", "h3", "title"):
            self.blocks.append({"tag": tag, "text": "", "sup": False, "classes": " ".join(c for _, c in self.open)})
        elif tag == "sup" and self.blocks:
            self.blocks[-1]["sup"] = True
        if tag not in _VOID:
            self.open.append((tag, own.get("class") or ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.skip:
            return
        tags = {t for t, _ in self.open}
        for name in {n for _, names in self.open for n in names.split()}:
            self.named[name] = self.named.get(name, "") + data
        if self.rows and self.rows[-1]["cells"] and tags & {"td", "th"}:
            self.rows[-1]["cells"][-1] += data
        if "a" in tags and self.links:
            self.links[-1]["text"] += data
        if self.blocks and self.blocks[-1]["tag"] in tags:
            self.blocks[-1]["text"] += data


def _one_space(text: str) -> str:
    return " ".join(text.split())


def listing(page: str, base: str, link: str = r"/poster/\?id=", cells: int = 3) -> list[dict]:
    """Rows of a listing: (id, title, presenter, topic, url) of table rows with enough cells and a matching link."""
    out = []
    for row in _Page(page).rows:
        hit = next((h for h in row["links"] if re.search(link, h)), None)
        if hit and len(row["cells"]) >= cells:
            text = [_one_space(c) for c in row["cells"]] + [""] * 4
            found = re.search(r"(?:id=|PaperNum=|abstract_)(\w+)", hit)
            out.append({"id": found[1] if found else "", "poster_number": text[0], "title": text[1], "presenter": text[2], "topic": text[3], "url": urljoin(base, hit)})
    return out


def anchors(page: str, base: str, link: str, least: int = 5) -> list[dict]:
    """Links of an older listing: the last of each number in the address, with titles of ``least`` characters and more."""
    rows: dict[str, dict] = {}
    for a in _Page(page).links:
        number = re.search(link, a["href"])
        if number and len(_one_space(a["text"])) >= least:
            rows[number[1]] = {"id": number[1], "title": _one_space(a["text"]), "url": urljoin(base, a["href"])}
    return list(rows.values())


def paper_listing(page: str, base: str, link: str = r"abstract_(\w+)\.pdf", cells: int = 4) -> list[dict]:
    """Rows of a table that link a paper: (id, title, authors, url), the last of each number."""
    rows: dict[str, dict] = {}
    for row in _Page(page).rows:
        found = next(((h, m[1]) for h in row["links"] if (m := re.search(link, h))), None)
        if found and len(row["cells"]) >= cells:
            text = [_one_space(c) for c in row["cells"]]
            rows[found[1]] = {"id": found[1], "title": text[1], "authors": text[2], "url": urljoin(base, found[0])}
    return list(rows.values())


def paper_link(page: str, base: str) -> str:
    """The address of the paper that a page links, or opens in a window; empty without one."""
    hit = next((a["href"] for a in _Page(page).links if re.search(r"(?i)\.pdf(?:$|[?#])", a["href"])), None)
    if hit is None:
        opened = re.search(r"""window\.open\(\s*['"]([^'"]+)""", page or "")
        hit = opened[1] if opened else None
    return urljoin(base, hit) if hit else ""


def detail(page: str, abstract_class: str = "paper-abstract", topic_class: str = "session-trackname") -> dict:
    """Title (h1 to h3), abstract, authors, and labelled paragraphs.

    The abstract is what stands in an element of ``abstract_class``, as on older pages, else the longest free
    paragraph over 120 characters; a topic area may stand in one of ``topic_class``.  Authors stand in a paragraph
    with raised marks, or, on pages of tables, in the first row of names.
    """
    out = {"title": "", "abstract": "", "authors": "", "keywords": "", "topic_area": "", "presenter": ""}
    labels = {"Keywords:": "keywords", "Topic Area:": "topic_area", "Presenter:": "presenter", "Authors:": "authors"}
    own = _Page(page)
    for block in own.blocks:
        text = _one_space(block["text"])
        label = next((x for x in labels if text.startswith(x)), None)
        if block["tag"] != "p":
            out["title"] = out["title"] or (text if block["tag"] != "title" else "")
        elif label:
            out[labels[label]] = text[len(label) :].strip()
        elif block["sup"] and len(text) <= 700:
            out["authors"] = text
        elif len(text) > 120 and len(text) > len(out["abstract"]):
            out["abstract"] = text
    out["abstract"] = _one_space(own.named.get(abstract_class, "")) or out["abstract"]
    out["topic_area"] = out["topic_area"] or _one_space(own.named.get(topic_class, ""))
    if not out["authors"]:
        cells = (_one_space(c) for row in own.rows for c in row["cells"])
        out["authors"] = next((c for c in cells if len(c) <= 700 and re.fullmatch(rf"{_PERSON}(?:\s*[,;&]\s*{_PERSON})+", c)), "")
    return out


def extracted(pages: DataFrame, rows: Callable[[str, str], list[dict]], schema: str, id_col: str = "page_id") -> DataFrame:
    """Rows of each page by ``rows`` (html, url); a page that can't be parsed gives none."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, url, page in zip(frame[id_col], frame["url"], frame["html"], strict=True):
                out += [(key, *[r.get(n) for n in names]) for r in rows(page or "", url or "")]
            yield pd.DataFrame(out, columns=[id_col, *names])

    return pages.select(id_col, "url", "html").mapInPandas(run, f"{id_col} long, {schema}")


def pdf_links(html: Column) -> Column:
    """Names of PDFs in a directory listing, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)href="([^"]+\.pdf)"'), F.lit(1))))


def links(html: Column) -> Column:
    """Addresses of links, as they stand in the page."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('<a href="([^"]*)"'), F.lit(1))


def pdf_fields(text: Column) -> Column:
    """(abstract, topic, keywords) between the headings of a paper's text."""
    part = lambda name, stop: F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)\b{name}\s*:?\s*(.*?)(?=\b(?:{stop})\b|\z)", 1), r"\s+", " "))
    return F.struct(part("abstract", "keywords|topic|introduction").alias("abstract"), F.lower(part("topic", "keywords|abstract|introduction")).alias("topic"), part("keywords", "introduction|abstract|topic").alias("keywords"))
