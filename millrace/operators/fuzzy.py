"""Approximate titles by sequence ratio, without a cross join."""

from __future__ import annotations

import difflib
import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Least sequence ratio of a match.
CUTOFF = 0.86


@F.pandas_udf(ArrayType(StringType()))
def _runs(keys: pd.Series) -> pd.Series:
    """Runs of three characters, each with its number among equal ones before it."""

    def own(key: str) -> list[str]:
        seen: Counter = Counter()
        out = []
        for k in range(len(key) - 2):
            run = key[k : k + 3]
            out.append(f"{run}{seen[run]}")
            seen[run] += 1
        return out

    return keys.map(own)


def _shorter(depth: int):
    """The key with up to ``depth`` characters left out, in every way."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(keys: pd.Series) -> pd.Series:
        def own(key: str) -> list[str]:
            found = level = {key}
            for _ in range(depth):
                level = {k[:i] + k[i + 1 :] for k in level for i in range(len(k))}
                found = found | level
            return sorted(found)

        return keys.map(own)

    return run


def best_titles(left: DataFrame, right: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(left_id, title_key, right_id, right_key, ratio): each left title's best right title.

    Tables are (left_id, title_key) and (right_id, right_key).  An equal title wins; among the
    rest the highest sequence ratio from ``cutoff`` on, then the greatest title, then id.

    Exact, for ``cutoff`` above 0.8: a ratio of c leaves at most u = (1 - c) T of the T characters of both
    unmatched, so what matches falls into u + 1 pieces at most and the two share at least
    c T / 2 - 2 (u + 1) runs of three, equal ones counted as often as they occur.  Pairs therefore
    meet on the rarest runs of each, as many as it can lose and one more, and must share enough.  Where that number
    is none the titles are so short that they meet once a character or two are left out.

    Null and empty titles match nothing but, if empty, each other; repeated rows match like any other.
    Empty tables give an empty result; other columns are ignored.
    """
    if not 0.8 < cutoff <= 1:
        raise ValueError("cutoff must lie above 0.8")
    left, right = left.select("left_id", "title_key").where("title_key is not null"), right.select("right_id", "right_key").where("right_key is not null")
    exact = left.join(right, left.title_key == right.right_key).select("left_id", "title_key", "right_id", "right_key", F.lit(1.0).alias("ratio"))
    # of equal titles the greatest id is the best: one row for each left title, so a title that stands often multiplies nothing
    exact = exact.groupBy("left_id", "title_key").agg(F.max(F.struct("right_id", "right_key")).alias("r")).select("left_id", "title_key", "r.right_id", "r.right_key", F.lit(1.0).alias("ratio"))
    open_ = left.join(exact.select("left_id").distinct(), "left_id", "left_anti")
    keys = right.groupBy("right_key").agg(F.max("right_id").alias("right_id"))
    asked = open_.select("title_key").distinct()

    loss = cutoff / 2 - 2 * (1 - cutoff)
    short = 1 / (1.25 * cutoff - 1)  # titles of so many characters together may share no run at all
    depth = math.floor((1 - cutoff) * short + 1e-9)
    band = cutoff / (2 - cutoff)

    def prefix(rows: DataFrame, key: str, name: str) -> DataFrame:
        """The rarest runs of each title: those it may lack to a partner of the least length, and one more.

        Runs that no asked title has come first in the order; they meet nothing, so they are only counted.
        """
        own = rows.select(F.xxhash64(key).alias(name), F.length(key).alias(f"{name}_n"), _runs(key).alias("runs")).where(F.col(f"{name}_n") * (1 + 1 / band) > short)
        each = own.select(name, f"{name}_n", F.size("runs").alias("size"), F.explode("runs").alias("run")).join(often, "run")
        ranked = each.groupBy(name, f"{name}_n", "size").agg(F.array_sort(F.collect_list(F.struct("n", "run"))).alias("p"))
        need = F.greatest(F.ceil(F.lit(loss * (1 + band)) * F.col(f"{name}_n") - 2 - 1e-9).cast("int"), F.lit(1))
        left_of = F.greatest(F.col("size") - need + 1, F.lit(1)) - (F.col("size") - F.size("p"))
        return ranked.where(left_of > 0).select(name, f"{name}_n", F.explode(F.slice(F.col("p.run"), F.lit(1), left_of)).alias("run"))

    # titles too long or too short for every asked one are not looked at; only runs of asked titles are ordered, by how often the others have them
    bounds = asked.agg(F.min(F.length("title_key")).alias("low"), F.max(F.length("title_key")).alias("high"))
    fitting = keys.select("right_key").join(F.broadcast(bounds), F.length("right_key").between(F.col("low") * F.lit(band) - 1, F.col("high") / F.lit(band) + 1)).select("right_key")
    known = asked.select(F.explode(_runs("title_key")).alias("run")).distinct()
    counted = fitting.select(F.explode(_runs("right_key")).alias("run")).join(known, "run").groupBy("run").agg(F.count("*").alias("n"))
    often = known.join(counted, "run", "left").select("run", F.coalesce("n", F.lit(0)).alias("n"))
    near = lambda a, b: F.least(a, b) >= F.greatest(a, b) * F.lit(band - 1e-9)
    met = prefix(asked, "title_key", "a").join(prefix(fitting, "right_key", "b"), "run").where(near(F.col("a_n"), F.col("b_n"))).select("a", "b").distinct()
    # names are hashes: titles that share one are all compared
    pairs = met.join(asked.withColumn("a", F.xxhash64("title_key")), "a").join(keys.select("right_key", F.xxhash64("right_key").alias("b")), "b").select("title_key", "right_key")
    few = lambda rows, key: rows.where(F.length(key) * (1 + band) <= short).select(key, F.explode(_shorter(depth)(F.col(key))).alias("less"))
    close = few(asked, "title_key").join(few(fitting, "right_key"), "less").where(near(F.length("title_key"), F.length("right_key"))).select("title_key", "right_key").distinct()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        counted: dict[str, Counter] = {}

        def runs(key: str) -> Counter:
            if key not in counted:
                counted[key] = Counter(key[k : k + 3] for k in range(len(key) - 2))
            return counted[key]

        def own(p: str, q: str) -> float:
            if (runs(p) & runs(q)).total() < loss * (len(p) + len(q)) - 2 - 1e-9:
                return 0.0
            matcher = difflib.SequenceMatcher(None, q, p)
            return matcher.ratio() if matcher.quick_ratio() >= cutoff else 0.0

        return pd.Series([own(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    scored = pairs.unionByName(close).distinct().withColumn("ratio", ratio("title_key", "right_key")).where(F.col("ratio") >= cutoff)
    top = scored.groupBy("title_key").agg(F.max(F.struct("ratio", "right_key")).alias("best")).select("title_key", "best.ratio", "best.right_key")
    found = open_.join(top, "title_key").join(keys, "right_key").select("left_id", "title_key", "right_id", "right_key", "ratio")
    once = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("ratio"), F.desc("right_key"), F.desc("right_id")))
    nth = "nth"
    return exact.unionByName(found).withColumn(nth, once).where(f"{nth} = 1").drop(nth)
