"""The nearest points of many taps, by descending a quadtree of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.tables import Work

#: Levels of the tree below its root, first level that is looked at, and points of a cell at which it need not be cut any more.
DEPTH, FIRST, FEW = 14, 2, 32


def _cell(x: Column, y: Column, level: int) -> Column:
    """A cell's number: its column and row, of 2^level each."""
    return (x * (1 << level) + y).cast("long")


def nearest_points(taps: DataFrame, points: DataFrame, k: int = 1, radius: float | None = None, tap_col: str = "tap_id", id_col: str = "vec_id") -> DataFrame:
    """(tap, rank, id, distance): for each of (tap, x, y) the ``k`` nearest of (id, x, y), exactly, within ``radius`` where one is given.

    A level of the tree is a table of cells with their counts.  All taps descend it at once: of the cells that a tap still looks at, those whose far corners are
    nearest hold ``k`` points together within some distance; cells that begin beyond it are dropped, the others
    are cut in four.  When no cell that is left holds many points, or at the lowest level, distances to the points in them decide.
    So a tap looks at a few cells around it, however dense or empty its surroundings are.

    Points of one place are kept up to the ``k`` smallest ids, taps of one place are looked up once, so neither can pile up in a cell.  Equal distances rank by id.  Points and
    taps with a null or infinite coordinate are left out; null ids come last; repeated taps each have their rows, repeated points count each.  Empty tables
    give an empty result.  Other columns are ignored.
    """
    work = Work(points.sparkSession, "quadtree")
    good = lambda df: df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1e300" for c in "xy"))
    kind = points.schema[id_col].dataType.simpleString()
    places = good(points.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in "xy"])).withColumns({c: F.col(c) + 0.0 for c in "xy"})
    own = Window.partitionBy("x", "y").orderBy(F.asc_nulls_last("id"))
    places = work.keep(places.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k).drop("n"), "places")
    low = places.agg(*[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    asked = work.keep(good(taps.select(F.col(tap_col).alias("tap"), *[F.col(c).cast("double").alias(c) for c in "xy"])).withColumns({c: F.col(c) + 0.0 for c in "xy"}), "taps")
    schema = f"`{tap_col}` {taps.schema[tap_col].dataType.simpleString()}, rank int, `{id_col}` {kind}, distance double"
    if low[0] is None:
        return points.sparkSession.createDataFrame([], schema)
    span = max(low[1] - low[0], low[3] - low[2]) or 1.0
    side = 1 << DEPTH
    at = [F.least(F.floor((F.col(c) - low[2 * j]) / span * side), F.lit(side - 1)).cast("long") for j, c in enumerate("xy")]
    leaves = work.keep(places.withColumns({"cx": at[0], "cy": at[1]}), "leaves")
    counted = work.keep(leaves.groupBy("cx", "cy").agg(F.count("*").alias("n")), "cells")

    spots = asked.select(F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    level = FIRST
    cells = lambda level: counted.groupBy(F.expr(f"cx div {side >> level}").alias("cx"), F.expr(f"cy div {side >> level}").alias("cy")).agg(F.sum("n").alias("n"))
    front = work.keep(spots.join(F.broadcast(cells(level))), "front")  # 4^FIRST cells at most
    while True:
        size = span / (1 << level)
        # corners of the cell; a hair's breadth outside, as points were dealt to cells with rounding
        near, far = [], []
        for j, (cell, tap) in enumerate((("cx", "tx"), ("cy", "ty"))):
            begin = F.col(cell) * size + low[2 * j] - size * 1e-6
            end = begin + size * (1 + 2e-6)
            near.append(F.greatest(begin - F.col(tap), F.col(tap) - end, F.lit(0.0)))
            far.append(F.greatest(F.abs(F.col(tap) - begin), F.abs(end - F.col(tap))))
        front = front.withColumns({"near": F.sqrt(near[0] * near[0] + near[1] * near[1]), "far": F.sqrt(far[0] * far[0] + far[1] * far[1])})
        if radius is not None:
            front = front.where(F.col("near") <= radius)
        within = F.sum("n").over(Window.partitionBy("tx", "ty").orderBy("far").rangeBetween(Window.unboundedPreceding, 0))
        reach = F.min(F.when(F.col("held") >= k, F.col("far"))).over(Window.partitionBy("tx", "ty"))
        front = front.withColumn("held", within).withColumn("reach", reach)
        front = work.keep(front.where(F.col("reach").isNull() | (F.col("near") <= F.col("reach"))).select("tx", "ty", "cx", "cy", "n"), "front")
        if level == DEPTH or (front.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
        level += 1
        children = cells(level).withColumns({"px": F.expr("cx div 2"), "py": F.expr("cy div 2")})
        front = front.select("tx", "ty", F.col("cx").alias("px"), F.col("cy").alias("py")).join(children, ["px", "py"]).select("tx", "ty", "cx", "cy", "n")
    shrunk = leaves.select("id", "x", "y", F.expr(f"cx div {side >> level}").alias("cx"), F.expr(f"cy div {side >> level}").alias("cy"))
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    met = front.select("tx", "ty", "cx", "cy").join(shrunk, ["cx", "cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    if radius is not None:
        met = met.where(F.col("distance") <= radius)
    first = Window.partitionBy("tx", "ty").orderBy("distance", F.asc_nulls_last("id"))
    best = work.keep(met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("tx", "ty", "rank", "id", "distance"), "best")
    rows = asked.join(best, (F.col("x") == F.col("tx")) & (F.col("y") == F.col("ty")))
    return rows.select(F.col("tap").alias(tap_col), "rank", F.col("id").alias(id_col), "distance")
