"""The star-schema tables seen as an archive of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ordered(lines: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values of each order, in order of first occurrence."""
    first = lines.groupBy("l_orderkey", F.col(value).alias("v")).agg(F.min("pos").alias("pos"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return first.groupBy("l_orderkey").agg(F.transform(listed, lambda x: x.v).alias(name))


def submissions(spark: SparkSession, folder: str, keywords: bool = False, authors: bool = False) -> DataFrame:
    """Orders as submissions: part types as topics, brands as keywords, customers as authors, priorities as topic areas."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(read("part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select("l_orderkey", "p_type", F.lower("p_brand").alias("brand"), (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")).alias("pos"))
    orders = read("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("topic_area"))
    rows = orders.join(_ordered(lines, "p_type", "topics"), F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    if keywords:
        rows = rows.join(_ordered(lines, "brand", "keywords"), F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    if authors:
        rows = rows.join(read("customer").select("c_custkey", F.col("c_name").alias("authors")), F.col("o_custkey") == F.col("c_custkey"), "left").drop("c_custkey")
    return rows.withColumnRenamed("o_orderkey", "row_ord").withColumn("id", F.col("row_ord").cast("string"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as titled texts: the first line and the rest."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select("doc_id", "text", "lang", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("abstract"))
