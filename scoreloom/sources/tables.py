"""Points, scores and label tables in the engine's long form, from Parquet tables.

A point is (series_id, source_id, t, x, y) with one column for each detector score. ``t`` is
the position in a series' own order. Only the columns that a query uses are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Detector scores of the line-item points.
DETECTORS = {"qty": "l_quantity", "disc": "l_discount", "tax": "l_tax"}
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id and the source that it belongs to."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("series_id"), F.col("s_nationkey").alias("source_id"))


def unordered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without ``t``: no sort, one shuffle less where order plays no part."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("series_id"),
        F.col("l_extendedprice").alias("x"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        *(F.col(c).alias(d) for d, c in DETECTORS.items()),
    )
    return line.join(series_dim(spark, sf_dir), "series_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy(*ORDER)
    line = table(spark, sf_dir, "lineitem").withColumn("t", F.row_number().over(order) - 1)
    line = line.select(
        F.col("l_suppkey").alias("series_id"),
        "t",
        F.col("l_extendedprice").alias("x"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        *(F.col(c).alias(d) for d, c in DETECTORS.items()),
    )
    return line.join(series_dim(spark, sf_dir), "series_id")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short series of events: by user, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"),
        F.pmod(F.col("user_id"), F.lit(23)).cast("long").alias("source_id"),
        (F.row_number().over(order) - 1).alias("t"),
        F.col("value").alias("x"),
        (F.col("event_type") == "error").cast("int").alias("y"),
    )


def series_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with names in the form number_SOURCE_id_n_kind_tr_cut_1st_first.csv."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("series_id"),
        F.format_string(
            "%03d_S%d_id_%d_Kind_tr_%d_1st_%d.csv", "s_suppkey", "s_nationkey", "s_suppkey", F.col("s_suppkey") * 7 + 100, F.col("s_suppkey") * 9 + 200
        ).alias("file"),
    )
