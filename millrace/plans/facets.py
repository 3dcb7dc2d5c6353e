"""Query state of the facet views, compiled to one predicate."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import normalize_search


@dataclass(frozen=True)
class FacetQuery:
    """Years, topics (include: all present; exclude: not all present) and search text.

    A view applies ``matches``; an empty facet adds no predicate, so what is
    left is pushed to the scan.
    """

    years: tuple[int, ...] = ()
    search: str = ""
    topics: tuple[str, ...] = ()
    mode: str = "include"
    highlighted: str | None = None
    delta: tuple[int | None, int | None] = (None, None)

    # -- predicates

    def year_match(self, column: str = "year") -> Column:
        return F.col(column).isin(*self.years) if self.years else F.lit(True)

    def topic_match(self, column: str = "topics") -> Column:
        """Null and empty topics fail include and pass exclude."""
        if not self.topics:
            return F.lit(True)
        wanted = F.array(*map(F.lit, self.topics))
        every = F.size(F.array_intersect(F.coalesce(F.col(column), F.array().cast("array<string>")), wanted)) == len(set(self.topics))
        return every if self.mode == "include" else ~every

    def search_match(self, column: str = "search_text") -> Column:
        needle = normalize_search(self.search)
        if not needle:
            return F.lit(True)
        compact = needle.replace(" ", "")
        found = F.col(column).contains(needle)
        return found | F.col(column).contains(compact) if compact != needle else found

    def matches(self) -> Column:
        return self.year_match() & self.topic_match() & self.search_match()

    def filtered(self, rows: DataFrame) -> DataFrame:
        for active, predicate in ((self.years, self.year_match), (self.topics, self.topic_match), (self.search.strip(), self.search_match)):
            if active:
                rows = rows.where(predicate())
        return rows

    def trend_rows(self, rows: DataFrame) -> DataFrame:
        """The filter of trend views, which show all years."""
        return replace(self, years=()).filtered(rows)

    @property
    def active(self) -> bool:
        return bool(self.years or self.topics or self.search.strip())

    # -- state changes

    def toggle_year(self, year: int) -> FacetQuery:
        years = set(self.years) ^ {year}
        return replace(self, years=tuple(sorted(years)))

    def toggle_topic(self, topic: str) -> FacetQuery:
        topics = set(self.topics) ^ {topic}
        return replace(self, topics=tuple(sorted(topics, key=_collation)))

    def with_mode(self, mode: str) -> FacetQuery:
        return replace(self, mode="exclude" if mode == "exclude" else "include")

    def clear_topics(self) -> FacetQuery:
        return replace(self, topics=())

    def clear(self) -> FacetQuery:
        return FacetQuery(delta=self.delta)

    def reveal(self, year: int, topics: list[str], search_text: str, key: str | None = None) -> FacetQuery:
        """The least change that shows a row: drop topics that hide it, go to its year, drop a search that misses it."""
        state = self
        every = set(self.topics) <= set(topics)
        if self.topics and every != (self.mode == "include"):
            state = replace(state, topics=())
        if self.years and year not in self.years:
            state = replace(state, years=(year,))
        needle = normalize_search(self.search)
        if needle and needle not in search_text and needle.replace(" ", "") not in search_text:
            state = replace(state, search="")
        return replace(state, highlighted=key or state.highlighted)

    def with_delta_years(self, available: list[int], preferred: tuple[int, int] | None = None) -> FacetQuery:
        """One selected year: it and the available year before it (the first two for the first); else fill what is unset.

        What is unset becomes ``preferred``, if both of its years are available, else the first and last.
        """
        years = sorted(available)
        if len(self.years) == 1 and self.years[0] in years and len(years) > 1:
            at = max(1, years.index(self.years[0]))
            return replace(self, delta=(years[at - 1], years[at]))
        if not years:
            return self
        start, stop = preferred if preferred and set(preferred) <= set(years) else (years[0], years[-1])
        return replace(self, delta=(self.delta[0] or start, self.delta[1] or stop))

    # -- labels

    def year_label(self) -> str:
        names = [str(y) for y in sorted(self.years)]
        return ("Year " if len(names) == 1 else "Years ") + _listed(names) if names else ""

    def search_label(self) -> str:
        return f'Search "{self.search.strip()}"' if self.search.strip() else ""

    def topic_label(self) -> str:
        if not self.topics:
            return ""
        verb = "Include" if self.mode == "include" else "Exclude"
        return f"{verb} papers with {'all of ' if len(self.topics) > 1 else ''}{_listed(list(self.topics))}"

    def label(self) -> str:
        return " · ".join(x for x in (self.year_label(), self.search_label(), self.topic_label()) if x)

    def year_menu_label(self) -> str:
        if not self.years:
            return "All years"
        return ", ".join(map(str, sorted(self.years))) if len(self.years) <= 2 else f"{len(self.years)} years"

    def slug(self) -> str:
        return re.sub(" +", "-", normalize_search(self.label()))[:60] or "all-submissions"


    def note(self, points: int, highlighted: int) -> str:
        """What is said under the map."""
        if self.highlighted:
            return "Jumped to the highlighted submission"
        return f"{points} papers on map · {highlighted} highlighted · {self.label()}" if self.active else f"{points} submissions, colored by year"

    # -- lists

    def paper_list(self, rows: DataFrame) -> DataFrame:
        """(row_key, title, source_url, meta, topics, highlighted) of the rows that match; topics sorted, ``meta`` of year, poster and authors."""
        filled = lambda c, before="": F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(before), F.col(c)))
        meta = F.concat_ws(" · ", F.col("year").cast("string"), filled("poster_number", "Poster "), filled("authors"))
        topics = F.array_sort(F.coalesce("topics", F.array().cast("array<string>")))
        own = F.col("row_key") == F.lit(self.highlighted) if self.highlighted else F.lit(False)
        return self.filtered(rows).select("row_key", "title", "source_url", meta.alias("meta"), topics.alias("topics"), own.alias("highlighted"))

    def drawn_points(self, points: DataFrame) -> DataFrame:
        """Points with whether they match, those that do last, so that they are drawn on top."""
        return points.withColumn("match", self.matches()).orderBy("match", "row_ord")

    def results_label(self, count: int) -> str:
        return f"{count} papers · {self.topic_label()}" if self.topics else f"{count} matching submissions"


def _collation(text: str) -> tuple[str, str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return plain.casefold(), text


def _listed(names: list[str]) -> str:
    if len(names) < 3:
        return " and ".join(names)
    return f"{', '.join(names[:-1])}, and {names[-1]}"


@dataclass(frozen=True)
class Vocabulary:
    """Topics of an archive in their fixed order, the fallback and the catch-all, and colours by place."""

    topics: tuple[str, ...]
    fallback: str
    catch_all: str = "Everything else"
    colors: tuple[str, ...] = field(default=("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7"))

    def active(self) -> list[str]:
        return [t for t in self.topics if t != self.catch_all]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.topics)), "topic_id int, topic string")

    def topic_color(self, topic: str = "topic") -> Column:
        """By place in the vocabulary; an unknown topic takes the first."""
        colors = F.array(*map(F.lit, self.colors))
        place = F.array_position(F.array(*map(F.lit, self.topics)), F.col(topic))
        return F.get(colors, (F.greatest(place - 1, F.lit(0)) % len(self.colors)).cast("int"))

    def year_color(self, year: str = "year") -> Column:
        return F.get(F.array(*map(F.lit, self.colors)), (F.abs(F.col(year)) % len(self.colors)).cast("int"))
