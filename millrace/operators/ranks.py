"""Places in one order over a whole table, without gathering it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import free_name
from millrace.tables import Work

#: Rows of a range, about.
RANGE = 200_000


def numbered(rows: DataFrame, keys: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 by ``keys``, which must tell all rows apart (rows they leave equal get places in any order).

    Rows are sorted into ranges, ranked inside their range, and moved by what the ranges before hold; the only
    thing sent to tasks is one number for each range.  Null keys go where the keys' order puts them.  An empty table gives an empty one;
    columns keep their names.
    """
    work = Work(rows.sparkSession, "ranks")
    part, own, start = (free_name(rows.columns, n) for n in ("part", "own", "start"))
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    spread = work.keep(rows.repartitionByRange(ranges, *keys).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = spread.groupBy(part).count()
    before = sizes.withColumn(start, F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = spread.withColumn(own, F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1)
    return ranked.join(F.broadcast(before), part).withColumn(name, (F.col(start) + F.col(own)).cast("long")).drop(part, own, start)
