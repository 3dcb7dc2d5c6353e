"""Keyed merges: last writer wins, replaced partitions with backfill, label caches, coordinates.

Null keys are keys like any other where rows are grouped, and match nothing where tables are joined.
Empty tables give empty results.  Columns beside those an operator names pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import free_name, listed, strings


def filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def _named(c: str) -> Column:
    return F.col(f"`{c}`")


def last_wins(rows: DataFrame, keys: list[str], ord: str, place: str = "place") -> DataFrame:
    """The last row of each key, with the place of its first; a hash aggregate, so hot keys combine before the shuffle.

    The column of places has the name ``place``, with an underscore where ``rows`` has that name.
    Of rows of one key and one ``ord`` any may stay; rows whose ``ord`` is null never win.
    """
    rest = [c for c in rows.columns if c not in keys]
    place, row = free_name(rows.columns, place), free_name(rows.columns, "row")
    best = rows.groupBy(*map(_named, keys)).agg(F.max_by(F.struct(*map(_named, rest)), _named(ord)).alias(row), F.min(_named(ord)).alias(place))
    return best.select(*map(_named, keys), *[F.col(row).getField(c).alias(c) for c in rest], place)


def merge_years(existing: DataFrame, incoming: DataFrame, years: list[int], fields: list[str], score: Callable[[Column], Column] | None = None) -> DataFrame:
    """``existing`` without ``years``, and ``incoming`` with empty fields filled from what stood there.

    A row's prior is looked up by (year, id), else by (year, title_key); of several the last by
    ``row_ord``.  With ``score`` the better of both authors by that column stays.  Rows of no year
    are of none of ``years`` and stay.
    """
    replaced = F.coalesce(F.col("year").isin(*years), F.lit(False)) if years else F.lit(False)
    old = existing.where(replaced)
    by_id = old.where("id is not null").groupBy("year", "id").agg(F.max_by(F.struct(*fields), "row_ord").alias("by_id"))
    by_title = old.where("title_key is not null").groupBy("year", "title_key").agg(F.max_by(F.struct(*fields), "row_ord").alias("by_title"))
    found = incoming.join(by_id, ["year", "id"], "left").join(by_title, ["year", "title_key"], "left")
    prior = {f: F.coalesce(F.col(f"by_id.{f}"), F.when(F.col("by_id").isNull(), F.col(f"by_title.{f}"))) for f in fields}
    new = {f: F.coalesce(filled(f), prior[f], F.lit("")) for f in fields}
    if score is not None and "authors" in fields:
        new["authors"] = F.when(score(F.coalesce(prior["authors"], F.lit(""))) > score(new["authors"]), prior["authors"]).otherwise(new["authors"])
    return existing.where(~replaced).unionByName(found.withColumns(new).select(*map(_named, existing.columns)))


def replace_year(existing: DataFrame, incoming: DataFrame, year: int) -> DataFrame:
    """``incoming`` in place of the rows of ``year``; rows of no year stay."""
    return incoming.unionByName(existing.where(~F.coalesce(F.col("year") == year, F.lit(False))), allowMissingColumns=True)


def pending_backfill(prior: tuple[Column, Column], pending: tuple[Column, Column]) -> tuple[Column, Column]:
    """(track, abstract): the first that is not empty, of the prior row and of the pending one."""
    return tuple(F.coalesce(filled(a), filled(b), F.lit("")) for a, b in zip(prior, pending, strict=True))


def migrate_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Labels by id alone moved to (year, id): of rows that share an id the last one owns the label, others are open again."""
    places = rows.groupBy("id").agg(F.max_by("row_key", "row_ord").alias("row_key"), (F.count("*") - 1).alias("reopened"))
    return cache.join(places, "id").select("row_key", *[_named(c) for c in cache.columns if c != "id"], "reopened")


def unlabelled(rows: DataFrame, cache: DataFrame, limit: int | None = None, refresh: bool = False) -> DataFrame:
    """Rows without a cached label, the first ``limit`` in row order (a feature of the job, applied before the costly stage)."""
    open_ = rows if refresh else rows.join(cache.select("row_key"), "row_key", "left_anti")
    return open_.orderBy("row_ord").limit(limit) if limit is not None else open_


def with_labels(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``cache`` by row key; null where there is no label."""
    return rows.join(cache, "row_key", "left")


def with_coordinates(rows: DataFrame, points: DataFrame, alias_year: int | None = None) -> DataFrame:
    """x and y by row key; with ``alias_year`` also by the alias of that year and the poster number, for rows of any year.

    Coordinates that ``rows`` has already are replaced.
    """
    rows = rows.drop("x", "y")
    own, other = free_name(rows.columns, "own"), free_name(rows.columns, "other")
    out = rows.join(points.groupBy("row_key").agg(F.max_by(F.struct("x", "y"), "row_ord").alias(own)), "row_key", "left")
    columns = [*map(_named, rows.columns)]
    if alias_year is None:
        return out.select(*columns, f"{own}.x", f"{own}.y")
    named = points.where((F.col("year") == alias_year) & filled("poster_number").isNotNull())
    out = out.join(named.groupBy("poster_number").agg(F.max_by(F.struct("x", "y"), "row_ord").alias(other)), "poster_number", "left")
    return out.select(*columns, *[F.coalesce(f"{own}.{c}", f"{other}.{c}").alias(c) for c in ("x", "y")])


def point_topics(points: DataFrame, rows: DataFrame) -> DataFrame:
    """``points`` with the sorted topics of their row, none where there is no row."""
    own = free_name(points.columns, "topics")
    return points.join(rows.groupBy("row_key").agg(F.min_by("topics", "row_ord").alias(own)), "row_key", "left").withColumn(own, F.array_sort(listed(F.col(own))))


def display_points(rows: DataFrame) -> DataFrame:
    """Rows with both coordinates."""
    return rows.where("x is not null and y is not null")


def restore_keywords(rows: DataFrame, snapshots: list[DataFrame], only_empty: bool) -> DataFrame:
    """Keywords from snapshots (year, id, keywords), later ones over earlier ones; ``only_empty`` leaves filled rows alone."""
    new = free_name(rows.columns, "restored")
    first, *rest = [s.select("year", "id", "keywords", F.lit(k).alias("nth")) for k, s in enumerate(snapshots)]
    for s in rest:
        first = first.unionByName(s)
    best = first.groupBy("year", "id").agg(F.max_by("keywords", "nth").alias(new))
    use = F.col(new).isNotNull() & (F.size(listed(F.col("keywords"))) == 0 if only_empty else F.lit(True))
    return rows.join(best, ["year", "id"], "left").withColumn("keywords", F.when(use, F.col(new)).otherwise(F.col("keywords"))).select(*map(_named, rows.columns))


def assignment(primary: Column, secondary: Column, topics: list[str], fallback: str, most: int = 4) -> Column:
    """Valid topics in order, the primary first: an invalid primary gives way to the first secondary, else to the fallback."""
    known = strings(topics)
    valid = F.array_distinct(F.filter(listed(secondary), lambda t: F.array_contains(known, t)))
    head = F.coalesce(F.when(F.array_contains(known, primary), primary), F.get(valid, 0), F.lit(fallback))
    return F.concat(F.array(head), F.slice(F.array_remove(valid, head), 1, most))


def without_catch_all(topics: Column, primary: Column, secondary: Column, catch_all: str, fallback: str) -> Column:
    """Topics rebuilt from their parts where missing, without the catch-all, never empty."""
    parts = F.array_distinct(F.concat(F.when(primary != "", F.array(primary)).otherwise(strings()), listed(secondary)))
    rebuilt = F.when(F.size(listed(topics)) > 0, topics).otherwise(parts)
    left = F.array_remove(rebuilt, catch_all)
    return F.when(F.size(left) > 0, left).otherwise(F.array(F.lit(fallback)))
