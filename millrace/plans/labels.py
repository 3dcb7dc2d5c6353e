"""Topic labels: a classifier behind a protocol, applied to rows that the cache does not know."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import listed
from millrace.functions.text import label_prompt, parse_answer
from millrace.operators.merge import assignment, unlabelled


class Classifier(Protocol):
    """Returns (primary, secondaries) for a title, an abstract and keywords; may raise."""

    def __call__(self, title: str, abstract: str, keywords: list[str]) -> tuple[str, list[str]]: ...


class LexicalClassifier:
    """Topics by the words they share with a row; works without a network."""

    def __init__(self, topics: list[str]):
        self.words = {t: {w for w in t.lower().replace("/", " ").split() if len(w) > 3} for t in topics}

    def __call__(self, title: str, abstract: str, keywords: list[str]) -> tuple[str, list[str]]:
        text = f"{title} {title} {abstract} {' '.join(keywords)}".lower().split()
        score = {t: sum(w in own for w in text) for t, own in self.words.items()}
        order = sorted((t for t in score if score[t]), key=lambda t: -score[t])
        return (order[0], order[1:5]) if order else ("", [])


def _tried(ask: Callable, row: tuple, attempts: int, wait: float):
    """What ``ask`` answers for a row, again after doubling waits; None if it never does."""
    for n in range(attempts):
        try:
            return ask(*row)
        except Exception:  # noqa: BLE001 - a failed row stays open
            if n + 1 < attempts:
                time.sleep(wait * 2**n)
    return None


def classify(rows: DataFrame, cache: DataFrame, classifier: Classifier, topics: list[str], fallback: str, limit: int | None = None, refresh: bool = False, attempts: int = 4, wait: float = 2.0) -> DataFrame:
    """(row_key, assigned_topics, failed) for rows to be labelled; each is tried ``attempts`` times with doubling waits.

    Null titles and abstracts count as empty, null keywords as none.  A row that fails keeps the fallback and ``failed``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                found = _tried(classifier, (r.title or "", r.abstract or "", list(r.keywords) if r.keywords is not None else []), attempts, wait)
                out.append((r.row_key, found[0] if found else None, list(found[1]) if found else [], found is None))
            yield pd.DataFrame(out, columns=["row_key", "primary_theme", "secondary_topics", "failed"])

    asked = unlabelled(rows, cache, limit, refresh).select("row_key", "title", "abstract", "keywords")
    labelled = asked.mapInPandas(run, "row_key string, primary_theme string, secondary_topics array<string>, failed boolean")
    return labelled.select("row_key", assignment(F.col("primary_theme"), F.col("secondary_topics"), topics, fallback).alias("assigned_topics"), "failed")


def classify_by_prompt(rows: DataFrame, cache: DataFrame, ask: Callable[[str], str], topics: list[str], fallback: str, limit: int | None = None, refresh: bool = False, attempts: int = 4, wait: float = 2.0) -> DataFrame:
    """The same with a service that is asked in words: ``ask`` takes the prompt of a row and answers in JSON.

    An answer that can't be read counts as failed.  Which service, model and key there are is the caller's.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"row_key": frame["row_key"], "answer": [_tried(ask, (prompt,), attempts, wait) for prompt in frame["prompt"]]})

    prompt = label_prompt(F.col("title"), F.col("abstract"), listed(F.col("keywords")), topics)
    asked = unlabelled(rows, cache, limit, refresh).select("row_key", prompt.alias("prompt"))
    answered = asked.mapInPandas(run, "row_key string, answer string").select("row_key", parse_answer(F.col("answer")).alias("a"))
    return answered.select("row_key", assignment(F.col("a.primary_theme"), F.col("a.secondary_topics"), topics, fallback).alias("assigned_topics"), F.col("a.primary_theme").isNull().alias("failed"))
