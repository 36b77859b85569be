"""Query of the distortion fit and its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distortion, stack
from ..sources import views
from .queries import query

_M = [1.01, -0.05, 4.0, 0.04, 0.99, -2.0, 0.0, 0.0, 1.0]


@query(f"""
WITH {views.STARS}, c AS (SELECT frame, avg(x) AS cx, avg(y) AS cy FROM stars GROUP BY frame HAVING count(*) >= 9), s AS (
  SELECT frame, star, u + 0.00002::DOUBLE * u * w - 0.00001::DOUBLE * u * u + cx AS fx, w + 0.000015::DOUBLE * w * w + cy AS fy
  FROM (SELECT *, x - cx AS u, y - cy AS w FROM stars JOIN c USING (frame)))
SELECT frame, star, round(1.01::DOUBLE * fx - 0.05::DOUBLE * fy + 4, 4) AS x, round(0.04::DOUBLE * fx + 0.99::DOUBLE * fy - 2, 4) AS y FROM s""")
def distortion_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars bent by a second order about their frame's middle and then moved; every eleventh was matched wrongly. The fit to the
    matches predicts where each star is seen, which the SQL knows."""
    found = views.stars(spark, sf_dir)
    middle = found.groupBy("frame").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n")).filter("n >= 9")
    u, w = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    fx, fy = u + 0.00002 * u * w - 0.00001 * u * u + F.col("cx"), w + 0.000015 * w * w + F.col("cy")
    wrong = F.when(F.col("star") % 11 == 0, 300.0).otherwise(0.0)
    seen = found.join(middle, "frame").select(
        "frame", F.col("x").alias("rx"), F.col("y").alias("ry"), (_M[0] * fx + _M[1] * fy + _M[2] + wrong).alias("tx"), (_M[3] * fx + _M[4] * fy + _M[5] - wrong).alias("ty")
    )
    linear = middle.select("frame", F.array(*map(F.lit, _M)).alias("m"))
    fits = distortion.fit_distortion(seen, linear, order=2)
    stars = found.join(middle.select("frame"), "frame", "left_semi").select("frame", "star", "x", "y")
    return stack.rounded(distortion.predicted(stars, fits, linear), "x", "y", places=4)
