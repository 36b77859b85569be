"""Exact medians of large groups, such as all pixels of a frame, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks looked at about the middle, as shares; the sketch's error is a tenth of that.
BAND, ACCURACY = 2e-3, 5000


def medians(df: DataFrame, keys: list[str], value: str | Column, name: str) -> DataFrame:
    """(keys, name): the exact median of each group; nulls don't count.

    A quantile sketch brackets the middle, for which each task keeps a bounded summary. Then the values in the bracket,
    a few thousandths of a group, are counted one by one, and those below it in all; the middle ones are read off.
    """
    return _between(df, keys, value, name, 0.5, F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)


def quantiles(df: DataFrame, keys: list[str], value: str | Column, name: str, share: float) -> DataFrame:
    """(keys, name): the value of each group that ``share`` of the others lie below, the lower one of two; nulls don't count."""
    rank = F.floor((F.col("_n") - 1) * share + 1e-9) + 1
    return _between(df, keys, value, name, share, rank, rank)


def _between(df: DataFrame, keys: list[str], value: str | Column, name: str, share: float, lower: Column, upper: Column) -> DataFrame:
    """The mean of the values at two ranks near ``share``."""
    rows = df.select(*keys, (F.col(value) if isinstance(value, str) else value).alias("_v")).filter("_v IS NOT NULL")
    bracket = F.percentile_approx("_v", [max(share - BAND, 0.0), min(share + BAND, 1.0)], ACCURACY)
    bounds = rows.groupBy(*keys).agg(bracket.alias("_b"), F.count("*").alias("_n"))
    # a row for each group; Spark broadcasts it or not by its size
    placed = rows.join(bounds, keys).filter(F.col("_v") <= F.col("_b")[1])
    counts = placed.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_b")[0], F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_r", upto)
    at = lambda rank: F.min(F.when(F.col("_r") >= rank, F.col("_v")))
    return ranked.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias(name))
