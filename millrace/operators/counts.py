"""Counts, shares, pivots and period changes over (row, year, topics) tables.

Null and empty topic lists count as none; a topic that stands twice in a row counts once.  Rows of no year are
rows of the year null.  Repeated rows count each.  Empty tables give empty results, or zeros where a
result has one row.  Columns that an operator does not name are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topic_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each distinct topic of each row, with its place (the first place is the primary topic)."""
    return rows.select(*keep, F.posexplode(F.array_distinct("topics")).alias("place", "topic"))


def topic_counts(rows: DataFrame, *by: str) -> DataFrame:
    """(by, topic, n): rows with each topic."""
    return topic_rows(rows, *by).groupBy(*by, "topic").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, *by: str, k: int | None = None, ties: tuple[str, ...] = ("first_ord",)) -> DataFrame:
    """``rank`` within ``by`` by count, then by first encounter; rows beyond ``k`` are cut early in each partition.

    A column ``rank`` that is there already is replaced.
    """
    out = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), *ties)))
    return out.where(F.col("rank") <= k) if k else out


def top(counts: DataFrame, k: int, ties: tuple[str, ...] = ("first_ord",)) -> DataFrame:
    """The ``k`` largest of all, by a sorted heap in each task, with their ``rank``; fewer where there are fewer."""
    few = counts.orderBy(F.desc("n"), *ties).limit(k)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), *ties)))


def keyword_counts(rows: DataFrame, column: str, *by: str, ord: str = "row_ord") -> DataFrame:
    """(by, keyword, n, first_ord): rows with a keyword, and where it was met first."""
    words = rows.select(*by, ord, F.posexplode(F.array_distinct(column)).alias("place", "keyword")).where("keyword <> ''")
    return words.groupBy(*by, "keyword").agg(F.count("*").alias("n"), F.min(F.struct(ord, "place")).alias("first_ord"))


def keyword_tops(rows: DataFrame, column: str, overall: int, each: int, by: str = "year", ord: str = "row_ord") -> DataFrame:
    """(by, keyword, n, rank): the ``overall`` most frequent keywords of all rows (``by`` null) and the ``each`` most frequent of each ``by``.

    One scan: rows are counted by (``by``, keyword) before they are shuffled, and the totals over all are sums of those counts, so a
    keyword that every row has is one number a task. Exact; ranks go by count, then by first encounter, and are cut in each partition before the last
    shuffle. Rows without ``by`` count in the whole only; null and empty keywords are none; an empty table gives an empty result.
    """
    fine = keyword_counts(rows, column, by, ord=ord)
    levels = F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit(None).cast(rows.schema[by].dataType).alias(by)), F.struct(F.lit(False).alias("whole"), F.col(by).alias(by)))).alias("level")
    summed = fine.select(levels, "keyword", "n", "first_ord").groupBy("level.whole", F.col(f"level.{by}").alias(by), "keyword").agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))
    kept = summed.where(F.col("whole") | F.col(by).isNotNull())
    return ranked(kept, "whole", by, k=max(overall, each)).where(F.col("rank") <= F.when(F.col("whole"), overall).otherwise(each)).select(by, "keyword", "n", "rank")


def cooccurrence(rows: DataFrame, column: str, ord: str = "row_ord") -> DataFrame:
    """(source, target, n, first_ord) of unordered pairs within a row's list; lists are short, so pairs stay in the row."""
    words = F.filter(F.array_distinct(column), lambda k: k != "")
    pairs = F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.greatest(F.size(words) - i - 1, F.lit(0))), lambda b: F.struct(F.least(a, b).alias("source"), F.greatest(a, b).alias("target")))))
    out = rows.select(ord, F.posexplode(pairs).alias("place", "pair")).select(ord, "place", "pair.*")
    return out.groupBy("source", "target").agg(F.count("*").alias("n"), F.min(F.struct(ord, "place")).alias("first_ord"))


def year_counts(rows: DataFrame) -> DataFrame:
    """(year, n): rows of each year."""
    return rows.groupBy("year").agg(F.count("*").alias("n"))


def year_counts_filled(rows: DataFrame, years: list[int]) -> DataFrame:
    """A row for each asked year, zero where there is none."""
    asked = rows.sparkSession.createDataFrame([(y,) for y in years], "year int")
    return asked.join(year_counts(rows.where(F.col("year").isin(*years))), "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def share(n, total):
    return F.when(total > 0, n / total * 100).otherwise(F.lit(0.0))


def topic_year_pivot(rows: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(year, topic, n, year_total, share, topic_rank): every year with every topic of ``base``, zeros included.

    Without ``base`` the topics are those of ``rows``, and all comes from one aggregate by year and topic.
    Years and topics are aggregates of bounded size, so their product is too.  Rows without
    topics count in ``year_total`` only; an empty table gives an empty result.
    """
    of = lambda df: df.select("year", F.explode_outer(F.array_distinct(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("topics", F.array().cast("array<string>"))))).alias("topic"))
    # the null topic stands on every row, so its count is that of the rows
    cells = of(rows).groupBy("year", "topic").agg(F.count("*").alias("n"))
    known = cells if base is None else topic_counts(base, "year")
    topics = known.where("topic is not null").groupBy("topic").agg(F.sum("n").alias("n"))
    topics = topics.select("topic", F.row_number().over(Window.orderBy(F.desc("n"), "topic")).alias("topic_rank"))
    total = cells.where("topic is null").select("year", F.col("n").alias("year_total"))
    grid = total.crossJoin(F.broadcast(topics))
    own = cells.where("topic is not null").select(F.col("year").alias("y"), F.col("topic").alias("t"), "n")
    out = grid.join(own, F.col("year").eqNullSafe(F.col("y")) & (F.col("topic") == F.col("t")), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("year", "topic", "n", "year_total", share(F.col("n"), F.col("year_total")).alias("share"), "topic_rank")


def stacked(pivot: DataFrame) -> DataFrame:
    """Where each topic's share starts and ends when a year's shares are stacked in topic order."""
    end = F.sum("n").over(Window.partitionBy("year").orderBy("topic_rank"))
    return pivot.select("year", "topic", "n", (end - F.col("n")).alias("y0"), end.alias("y1"))


def topic_deltas(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """Change of each topic's share of rows between two years, in percentage points; topics of neither year are left out."""
    rows = rows.where(F.col("year").isin(start, stop))
    at = lambda year: F.sum(F.when(F.col("year") == year, 1).otherwise(0))
    counts = topic_rows(rows, "year").groupBy("topic").agg(at(start).alias("from_n"), at(stop).alias("to_n"))
    total = rows.agg(F.coalesce(at(start), F.lit(0)).alias("from_total"), F.coalesce(at(stop), F.lit(0)).alias("to_total"))
    out = counts.crossJoin(F.broadcast(total)).where("from_n > 0 or to_n > 0")
    out = out.withColumns({"from_share": share(F.col("from_n"), F.col("from_total")), "to_share": share(F.col("to_n"), F.col("to_total"))})
    return out.withColumn("delta", F.col("to_share") - F.col("from_share"))


def adjacent_years(rows: DataFrame) -> DataFrame:
    """Each available year with the one before it, or the first two for the first; and whether the pair has topics."""
    years = rows.groupBy("year").agg(F.sum((F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0).cast("long")).alias("with_topics"))
    w = Window.orderBy("year")
    before, after = F.lag("year").over(w), F.lead("year").over(w)
    beside = F.coalesce(F.lag("with_topics").over(w), F.lead("with_topics").over(w))
    pairs = years.select("year", F.coalesce(before, F.col("year")).alias("from_year"), F.when(before.isNotNull(), F.col("year")).otherwise(after).alias("to_year"), ((F.col("with_topics") > 0) | (beside > 0)).alias("comparable"))
    return pairs.where("to_year is not null")


def latest_comparable(rows: DataFrame) -> DataFrame:
    return adjacent_years(rows).where("comparable").groupBy().agg(F.max_by(F.struct("from_year", "to_year"), "to_year").alias("p")).select("p.*")


def default_pair(rows: DataFrame, preferred: tuple[int, int] | None = None) -> DataFrame:
    """(from_year, to_year): ``preferred`` if there are rows of both, else the first and last year."""
    if preferred is None:
        return rows.agg(F.min("year").alias("from_year"), F.max("year").alias("to_year"))
    both = F.coalesce(F.bool_or(F.col("year") == preferred[0]) & F.bool_or(F.col("year") == preferred[1]), F.lit(False))
    return rows.agg(*[F.when(both, F.lit(p)).otherwise(end("year")).alias(name) for p, end, name in zip(preferred, (F.min, F.max), ("from_year", "to_year"), strict=True)])


def kpis(rows: DataFrame, matches) -> DataFrame:
    """Rows, filtered rows, topics in use and years covered of the filtered rows, in one pass."""
    out = rows.select("row_ord", "year", matches.alias("m"), F.explode_outer(F.coalesce("topics", F.array().cast("array<string>"))).alias("topic"))
    return out.agg(
        F.countDistinct("row_ord").alias("total"),
        F.countDistinct(F.when(F.col("m"), F.col("row_ord"))).alias("filtered"),
        F.countDistinct(F.when(F.col("m"), F.col("topic"))).alias("topics"),
        F.countDistinct(F.when(F.col("m"), F.col("year"))).alias("years"),
    )


def primary_and_secondary(rows: DataFrame, vocabulary: list[str], k: int = 30) -> DataFrame:
    """(kind, topic, n): how often a topic is primary, and the ``k`` most frequent further topics of the vocabulary."""
    counts = topic_rows(rows).groupBy("topic").agg(F.sum((F.col("place") == 0).cast("long")).alias("primary"), F.sum((F.col("place") > 0).cast("long")).alias("secondary"))
    first = counts.where("primary > 0").select(F.lit("primary").alias("kind"), "topic", F.col("primary").alias("n"))
    later = counts.where((F.col("secondary") > 0) & F.col("topic").isin(*vocabulary)).select(F.lit("secondary").alias("kind"), "topic", F.col("secondary").alias("n"))
    return first.unionByName(later.orderBy(F.desc("n"), "topic").limit(k))


def extent(points: DataFrame, *axes: str, pad: float = 0.06) -> DataFrame:
    """(axis, low, high): range of each axis, padded by a share of its span; [0, 1] without points, span 1 where it is 0."""
    named = F.explode(F.create_map(*[x for a in axes for x in (F.lit(a), F.col(a).cast("double"))])).alias("axis", "value")
    ends = points.select(named).groupBy("axis").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    margin = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) * pad
    low, high = F.col("lo") - margin, F.col("hi") + margin
    return ends.select("axis", F.coalesce(low, F.lit(0.0)).alias("low"), F.coalesce(high, F.lit(1.0)).alias("high"))
