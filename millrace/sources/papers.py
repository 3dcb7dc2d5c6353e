"""Authors and keywords out of the text of papers, and the paper that belongs to a title."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.authors import NAME, authors_are_thin, is_affiliation_text, normalize_authors
from millrace.functions.columns import let
from millrace.functions.keywords import DEFAULT, KeywordRules, first_filled, normalize_phrase, parse_keywords

#: Characters before the abstract in which names stand.
HEADER = 3500
_PERSON = re.compile(rf"{NAME}(?:[ \t]+{NAME}){{1,3}}")
_BEFORE_EMAIL = re.compile(rf"({NAME}(?:[ \t]+{NAME}){{1,3}})[\s\d,*†‡]*\([^()\s]+@[^()\s]+\)")


def named_people(text: str | None) -> str:
    """Names that an address follows, if there are two; else the names that fill a line above the abstract."""
    head = re.split(r"(?i)\b(?:abstract|keywords)\b", (text or "")[:HEADER], maxsplit=1)[0]
    found = dict.fromkeys(m[1] for m in _BEFORE_EMAIL.finditer(head))
    if len(found) < 2:
        lines = {}
        for line in head.split("\n")[1:]:
            plain = re.sub(r"\([^)]*\)|[\d*†‡]+", " ", line)
            names = [" ".join(n.split()) for n in re.split(r",|;|&|\band\b", plain) if n.strip()]
            if names and all(_PERSON.fullmatch(n) and not is_affiliation_text(n) for n in names):
                lines |= dict.fromkeys(names)
        found |= lines
    return ", ".join(found)


def keyword_block(text: str | None) -> str:
    """What follows the heading of keywords: its lines up to an empty one, the introduction or running text."""
    after = re.split(r"(?i)\bkey\s?words?\b\s*[:—-]?\s*", text or "", maxsplit=1)
    if len(after) < 2:
        return ""
    lines = []
    for line in re.split(r"(?i)\bintroduction\b", after[1], maxsplit=1)[0].split("\n"):
        if not line.strip() or re.match(r"(?:The|We|In|This|Our|It|Here)\s+\w+\s+\w+", line.strip()):
            break
        lines.append(line.strip())
    return " ".join(lines)


@F.pandas_udf(StringType())
def _authors(texts: pd.Series) -> pd.Series:
    return texts.map(named_people)


@F.pandas_udf(StringType())
def _block(texts: pd.Series) -> pd.Series:
    return texts.map(keyword_block)


def authors_of(text: Column) -> Column:
    """Authors by the text of a paper, as ``normalize_authors`` spells them."""
    return normalize_authors(_authors(F.coalesce(text, F.lit(""))))


def keywords_of(text: Column) -> Column:
    """The raw keyword line, for ``functions.keywords.parse_keywords``."""
    return _block(F.coalesce(text, F.lit("")))


def keyword_lists(text: Column, rules: KeywordRules = DEFAULT) -> Column:
    """Keywords of a paper's text: of the block under the heading, else of what stands before the introduction, else line by line.

    Line by line, lines of numbers and of the conference are left out; a line without marks is one keyword.
    """
    own = F.coalesce(text, F.lit(""))
    clean = lambda raw: F.array_distinct(F.transform(parse_keywords(raw, rules), lambda k: normalize_phrase(k, rules)))
    before_body = F.regexp_extract(own, r"(?is)\bkey\s?words?\b\s*[:—-]?\s*(.*?)\b(?:introduction|background)\b", 1)
    lines = F.filter(F.transform(F.split(F.regexp_extract(own, r"(?s)\bKeywords\b\s*[:—-]?\s*(.*?)(?:\n\s*\n|\z)", 1), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"(?i)^\d+$|\bconference\b"))
    by_line = F.flatten(F.transform(lines, lambda x: F.when(x.contains(";"), parse_keywords(x, rules)).otherwise(F.array(F.lower(x)))))
    return let(keywords_of(own), lambda block: first_filled(clean(block), clean(before_body), F.array_distinct(by_line)))


def title_score(title: str, name: str) -> float:
    """How well a file name fits a title: sequence ratio of letters and digits, or share of the title's words in it."""
    fold = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    words = {w for w in re.findall("[a-z0-9]+", title.lower()) if len(w) > 3}
    stem = re.sub(r"(?i)\.pdf$", "", name)
    inside = sum(w in fold(stem) for w in words) / len(words) if words else 0.0
    return max(difflib.SequenceMatcher(None, fold(title), fold(stem)).ratio(), inside)


#: Files that hold a word for each task that pairs them with titles; more are dealt to several tasks.
FILES_OF_A_WORD = 10_000


def papers_of_titles(titles: DataFrame, files: DataFrame, least: float = 0.5, most: int = 5) -> DataFrame:
    """(id, name, score, rank): up to ``most`` files for each title, best score first, then the shorter name.

    Titles (id, title) and files (name) meet on words of over three letters that both hold; what shares
    no such word is not looked at.  A word that many files hold is dealt to as many tasks as it
    takes.  Titles and names without such words match nothing.  Repeated names count once.
    """
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 3)))
    held = files.select("name").distinct().select("name", words(F.regexp_replace("name", r"(?i)\.pdf$", "")).alias("w"))
    tasks = held.groupBy("w").agg(F.ceil(F.count("*") / FILES_OF_A_WORD).cast("int").alias("tasks"))
    dealt = held.join(tasks, "w").withColumn("task", F.pmod(F.xxhash64("name"), "tasks").cast("int"))
    asked = titles.select("id", "title", words(F.col("title")).alias("w")).join(tasks, "w").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    pairs = asked.join(dealt.drop("tasks"), ["w", "task"]).select("id", "title", "name").distinct()

    @F.pandas_udf("double")
    def score(title: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([title_score(t, n) for t, n in zip(title, name, strict=True)], dtype=float)

    scored = pairs.select("id", "name", score("title", "name").alias("score")).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.length("name"), "name"))
    return scored.withColumn("rank", best).where(F.col("rank") <= most)


def authors_by_files(titles: DataFrame, files: DataFrame, texts: DataFrame, least: float = 0.5, most: int = 5) -> DataFrame:
    """(id, authors): of the best files of each title the first whose text (name, text) lists authors that are not thin."""
    found = papers_of_titles(titles, files, least, most).join(texts.select("name", authors_of(F.col("text")).alias("authors")), "name")
    return found.where(~authors_are_thin(F.col("authors"))).groupBy("id").agg(F.min_by("authors", "rank").alias("authors"))
