"""The driver's tables seen as stacks, rasters, star catalogues and event streams.

Values are averages of integer cents, so that sums are exact in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean_cents(column: str):
    return F.sum(F.round(F.col(column) * 100).cast("long")) / F.count("*") / 100.0


def user_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(px, frame, v, w): a user is a pixel, a day of the month a frame; at most 31 samples a pixel, with heavy tails."""
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("px"), F.dayofmonth("ts").alias("frame"))
    return events.agg(_mean_cents("value").alias("v"), F.count("*").cast("double").alias("w"))


USER_STACK = """user_stack AS (
  SELECT user_id AS px, day(ts)::INT AS frame, sum(round(value * 100)::BIGINT) / count(*) / 100.0 AS v, count(*)::DOUBLE AS w
  FROM events GROUP BY ALL)"""


def part_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(px, frame, v): a part is a pixel, a month of shipping a frame; at most 12 samples a pixel."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("px"), F.month("l_shipdate").alias("frame"))
    return items.agg((_mean_cents("l_extendedprice") / 100000.0).alias("v"))


PART_STACK = """part_stack AS (
  SELECT l_partkey AS px, month(l_shipdate)::INT AS frame, sum(round(l_extendedprice * 100)::BIGINT) / count(*) / 100.0 / 100000.0 AS v
  FROM lineitem GROUP BY ALL)"""


def side(spark: SparkSession, sf_dir: str) -> int:
    """Height and width of the raster: it grows with the table, about eight rows a pixel of each of seven frames."""
    return max(math.isqrt(table(spark, sf_dir, "lineitem").count() // 56), 4)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, v): mean price by supplier row and part column, one frame for each line number."""
    n = side(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_linenumber").alias("frame"),
        (F.col("l_suppkey") % n).cast("int").alias("y"),
        (F.col("l_partkey") % n).cast("int").alias("x"),
    )
    return items.agg((_mean_cents("l_extendedprice") / 100000.0).alias("v"))


RASTER = """side AS (SELECT greatest(floor(sqrt(count(*) // 56)), 4)::INT AS s FROM lineitem), raster AS (
  SELECT l_linenumber AS frame, (l_suppkey % s)::INT AS y, (l_partkey % s)::INT AS x,
         sum(round(l_extendedprice * 100)::BIGINT) / count(*) / 100.0 / 100000.0 AS v
  FROM lineitem, side GROUP BY ALL)"""


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, star, x, y, flux, fwhm, snr, sharpness, peak): a nation's customers as the stars of a frame."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("frame"),
        key.alias("star"),
        (key * 7919 % 1009).cast("double").alias("x"),
        (key * 104729 % 1013).cast("double").alias("y"),
        F.round(F.col("c_acctbal") + 1000, 2).alias("flux"),
        (2.0 + key * 31 % 97 / 32.0).alias("fwhm"),
        (key * 17 % 101).cast("double").alias("snr"),
        (key * 13 % 89 / 100.0).alias("sharpness"),
        (key * 11 % 103 / 100.0).alias("peak"),
    )


STARS = """stars AS (
  SELECT c_nationkey AS frame, c_custkey AS star, (c_custkey * 7919 % 1009)::DOUBLE AS x, (c_custkey * 104729 % 1013)::DOUBLE AS y,
         round(c_acctbal + 1000, 2) AS flux, 2.0::DOUBLE + (c_custkey * 31 % 97)::DOUBLE / 32.0::DOUBLE AS fwhm,
         (c_custkey * 17 % 101)::DOUBLE AS snr, (c_custkey * 13 % 89)::DOUBLE / 100.0::DOUBLE AS sharpness,
         (c_custkey * 11 % 103)::DOUBLE / 100.0::DOUBLE AS peak
  FROM customer)"""
