"""Query of the photometric gains and its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import photometry, stack
from ..sources import views
from .queries import query


@query(f"""
WITH {views.RASTER}, seen AS (SELECT frame, y, x, v * (1 + frame / 10.0::DOUBLE) + 0.01::DOUBLE * frame AS v FROM raster), places AS (
  SELECT y, x FROM seen GROUP BY y, x HAVING count(DISTINCT frame) = (SELECT count(DISTINCT frame) FROM seen)), p AS (
  SELECT a.frame, a.v, b.v AS r FROM seen a JOIN seen b ON b.frame = 1 AND a.y = b.y AND a.x = b.x SEMI JOIN places l ON l.y = a.y AND l.x = a.x), m AS (
  SELECT frame, median(v) AS vm, median(r) AS rm FROM p GROUP BY frame), g AS (
  SELECT frame, vm, rm, CASE WHEN median(abs(v - vm)) > 1.1920929e-7 THEN median(abs(r - rm)) / median(abs(v - vm)) ELSE 1 END AS f FROM p JOIN m USING (frame) GROUP BY frame, vm, rm), o AS (
  SELECT frame, vm, rm, f, v, r, r - (v * f + rm - vm * f) AS off FROM p JOIN g USING (frame)), c AS (SELECT frame, median(off) AS om FROM o GROUP BY frame), d AS (
  SELECT frame, om, median(abs(off - om)) AS od FROM o JOIN c USING (frame) GROUP BY frame, om), s AS (
  SELECT frame, count(*) AS n, var_pop(v) AS vv, var_pop(r) AS rr, covar_pop(v, r) AS vr FROM o JOIN d USING (frame) WHERE abs(off - om) <= 4 * 1.4826022 * od GROUP BY frame), t AS (
  SELECT *, rr - vv AS delta, sqrt((rr - vv) * (rr - vv) + 4 * vr * vr) AS root FROM s), z AS (
  SELECT frame, n, rm, vm, CASE WHEN frame = 1 THEN 1 WHEN od <= 1.1920929e-7 THEN f WHEN n < 2 OR vr <= 2.220446049250313e-16 THEN 1
    WHEN delta >= 0 THEN (delta + root) / (2 * vr) ELSE 2 * vr / (root - delta) END AS gain FROM g JOIN d USING (frame) LEFT JOIN t USING (frame))
SELECT frame, coalesce(n, 0) AS n, round(gain, 5) AS gain, round(rm - vm * gain, 5) AS "offset" FROM z""")
def photometric_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames made brighter step by step, brought to the first one."""
    frame = F.col("frame")
    seen = views.raster(spark, sf_dir).withColumn("v", F.col("v") * (1 + frame / 10.0) + 0.01 * frame)
    return stack.rounded(photometry.photometric_gains(seen, 1), "gain", "offset", places=5)
