"""Queries of calibration masters, defects and local contrast, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masters, raster, stack
from ..sources import views
from .queries import query

_BAYER = [[0, 1], [1, 2]]
_COLOUR = "(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 0 WHEN y % 2 = 1 AND x % 2 = 1 THEN 2 ELSE 1 END)"
_TILE = 16

#: A sensor's frames out of the raster: the first is the dark with some pixels lit up, the second the flat with some dimmed.
_SENSOR = f"""{views.RASTER}, dark AS (
  SELECT frame, y, x, v + CASE WHEN (y * 31 + x * 17) % 97 = 0 THEN 2 ELSE 0 END AS v FROM raster WHERE frame = 1), flat AS (
  SELECT frame, y, x, v * CASE WHEN (y * 13 + x * 29) % 89 = 0 THEN 0.2::DOUBLE ELSE 1 END AS v FROM raster WHERE frame = 2)"""


def sensor(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pixels = views.raster(spark, sf_dir)
    y, x = F.col("y"), F.col("x")
    dark = pixels.filter("frame = 1").withColumn("v", F.col("v") + F.when((y * 31 + x * 17) % 97 == 0, 2).otherwise(0))
    flat = pixels.filter("frame = 2").withColumn("v", F.col("v") * F.when((y * 13 + x * 29) % 89 == 0, 0.2).otherwise(1.0))
    return dark, flat, pixels


_HOT = f"""tiles AS (
  SELECT frame, {_COLOUR} AS c, y // {_TILE} AS ty, x // {_TILE} AS tx, median(v) AS level FROM dark GROUP BY ALL), ends AS (
  SELECT max(ty) AS ly, max(tx) AS lx FROM tiles), g AS (
  SELECT *, {_COLOUR} AS c, least(greatest((y + 0.5::DOUBLE) / {_TILE} - 0.5, 0), ly) AS gy, least(greatest((x + 0.5::DOUBLE) / {_TILE} - 0.5, 0), lx) AS gx FROM dark, ends), k AS (
  SELECT frame, y, x, v, c, floor(gy)::INT + dy AS ty, floor(gx)::INT + dx AS tx,
         (CASE WHEN dy = 1 THEN gy - floor(gy) ELSE 1 - gy + floor(gy) END) * (CASE WHEN dx = 1 THEN gx - floor(gx) ELSE 1 - gx + floor(gx) END) AS w
  FROM g, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)), res AS (
  SELECT frame, y, x, c, k.v - sum(w * level) / sum(w) AS v FROM k JOIN tiles USING (frame, c, ty, tx) WHERE w > 0 GROUP BY frame, y, x, c, k.v), m AS (
  SELECT frame, c, median(v) AS m, count(*) AS n FROM res GROUP BY ALL), offs AS (SELECT frame, c, n, m, abs(v - m) AS off FROM res JOIN m USING (frame, c)), d AS (
  SELECT frame, c, m, greatest(median(off) * 1.4826022, CASE WHEN n >= 500 THEN list_sort(list(off))[((n - 1) * 99 // 100 + 1)::INT] * 0.38822448 ELSE 0 END, 1e-7) AS s
  FROM offs GROUP BY frame, c, m, n), hot AS (SELECT frame, y, x, v FROM res JOIN d USING (frame, c) WHERE v > m + 4 * s)"""
_NEIGHBOURS = "(SELECT unnest([-2, 0, 2]) AS dy) a, (SELECT unnest([-2, 0, 2]) AS dx) b WHERE dy <> 0 OR dx <> 0"
_COLD = f"""near AS (
  SELECT t.frame, t.y, t.x, t.v, median(p.v) AS near FROM (SELECT flat.*, dy, dx FROM flat, {_NEIGHBOURS}) t
  JOIN flat p ON p.y = t.y + dy AND p.x = t.x + dx GROUP BY ALL), cold AS (SELECT frame, y, x, v FROM near WHERE v < 0.5::DOUBLE * near)"""


@query(f"WITH {_SENSOR}, {_HOT} SELECT frame, y, x, round(v, 6) AS v FROM hot")
def hot_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(masters.hot_pixels(sensor(spark, sf_dir)[0], 4.0, _BAYER, _TILE), "v")


@query(f"WITH {_SENSOR}, {_COLD} SELECT frame, y, x, round(v, 6) AS v FROM cold")
def cold_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(masters.cold_pixels(sensor(spark, sf_dir)[1], _BAYER), "v")


@query(f"""
WITH {_SENSOR}, {_HOT}, {_COLD} SELECT *, round(100.0::DOUBLE * (n_hot + n_cold) / n, 6) AS percentage
FROM (SELECT count(*) AS n_hot FROM hot), (SELECT count(*) AS n_cold FROM cold), (SELECT count(*) AS n FROM (SELECT DISTINCT y, x FROM raster))""")
def defect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dark, flat, pixels = sensor(spark, sf_dir)
    found = masters.defect_summary(masters.hot_pixels(dark, 4.0, _BAYER, _TILE), masters.cold_pixels(flat, _BAYER), pixels)
    return stack.rounded(found, "percentage")


@query(f"""
WITH {_SENSOR}, {_HOT}, {_COLD}, bad AS (SELECT y, x FROM hot UNION SELECT y, x FROM cold), good AS (SELECT * FROM raster ANTI JOIN bad USING (y, x)), mended AS (
  SELECT t.frame, t.y, t.x, median(p.v) AS v FROM (SELECT raster.*, dy, dx FROM raster SEMI JOIN bad USING (y, x), {_NEIGHBOURS}) t
  JOIN good p ON p.frame = t.frame AND p.y = t.y + dy AND p.x = t.x + dx GROUP BY ALL)
SELECT frame, y, x, round(coalesce(m.v, r.v), 12) AS v FROM raster r LEFT JOIN mended m USING (frame, y, x)""")
def corrected_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames without the sensor's hot and cold pixels."""
    dark, flat, pixels = sensor(spark, sf_dir)
    hot, cold = masters.hot_pixels(dark, 4.0, _BAYER, _TILE), masters.cold_pixels(flat, _BAYER)
    return stack.rounded(masters.corrected(pixels, hot.select("y", "x").union(cold.select("y", "x")), _BAYER), "v", places=12)


@query(f"""
WITH {_SENSOR}, f AS (SELECT y, x, {_COLOUR} AS c, flat.v - 0.1::DOUBLE * coalesce(b.v, 0) AS v FROM flat LEFT JOIN (SELECT y, x, v FROM raster WHERE frame = 3) b USING (y, x)), l AS (
  SELECT c, avg(v) AS l FROM f GROUP BY c) SELECT y, x, round(greatest(v / l, 0.1), 6) AS v FROM f JOIN l USING (c)""")
def prepared_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat less its bias, each colour brought to one."""
    _, flat, pixels = sensor(spark, sf_dir)
    bias = pixels.filter("frame = 3").withColumn("v", 0.1 * F.col("v"))
    return stack.rounded(masters.prepared_flat(flat, bias, _BAYER), "v")


@query(f"""
WITH {views.RASTER} SELECT role, y, x, count(*) AS n, round(median(v), 12) AS v FROM (
  SELECT *, CASE WHEN frame <= 3 THEN 'light' WHEN frame <= 5 THEN 'dark' WHEN frame = 6 THEN 'flat' ELSE 'bias' END AS role FROM raster) GROUP BY role, y, x""")
def master_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = F.col("frame")
    role = F.when(frame <= 3, "light").when(frame <= 5, "dark").when(frame == 6, "flat").otherwise("bias")
    return stack.rounded(masters.master_frames(views.raster(spark, sf_dir).withColumn("role", role)), "v", places=12)


_BIN = "round(least(greatest(v, 0), 1) * 255)::INT"


@query(f"""
WITH {views.RASTER}, grid AS (SELECT s, t, ((s + t - 1) // t)::INT AS w FROM (SELECT s, least(4, greatest(floor(sqrt(s * s / 1024)), 1))::INT AS t FROM side)), h AS (
  SELECT frame, y // w AS ty, x // w AS tx, {_BIN} AS bin, count(*) AS n FROM raster, grid GROUP BY ALL), tile AS (
  SELECT frame, ty, tx, sum(n)::BIGINT AS n, greatest(floor(2.0::DOUBLE * sum(n) / 256), 1)::BIGINT AS most FROM h GROUP BY ALL), held AS (
  SELECT t.frame, t.ty, t.tx, t.n, b.bin, least(coalesce(h.n, 0), most) AS kept FROM tile t CROSS JOIN (SELECT unnest(range(256))::INT AS bin) b
  LEFT JOIN h ON h.frame = t.frame AND h.ty = t.ty AND h.tx = t.tx AND h.bin = b.bin), spare AS (
  SELECT frame, ty, tx, n, (n - sum(kept))::BIGINT AS spare FROM held GROUP BY frame, ty, tx, n), curve AS (
  SELECT frame, ty, tx, bin, (sum(kept) OVER (PARTITION BY frame, ty, tx ORDER BY bin) + spare // 256 * (bin + 1) + least(bin + 1, spare % 256))::DOUBLE / n AS c
  FROM held JOIN spare USING (frame, ty, tx, n)), g AS (
  SELECT frame, y, x, v, t, {_BIN} AS bin, least(greatest((y + 0.5::DOUBLE) / w - 0.5, 0), t - 1) AS gy, least(greatest((x + 0.5::DOUBLE) / w - 0.5, 0), t - 1) AS gx FROM raster, grid), k AS (
  SELECT *, floor(gy)::INT AS y0, floor(gx)::INT AS x0, least(floor(gy)::INT + 1, t - 1) AS y1, least(floor(gx)::INT + 1, t - 1) AS x1 FROM g)
SELECT k.frame, k.y, k.x, round(v + 0.8::DOUBLE * (a.c + (gx - x0) * (b.c - a.c) + (gy - y0) * (c.c + (gx - x0) * (d.c - c.c) - a.c - (gx - x0) * (b.c - a.c)) - v), 6) AS v FROM k
JOIN curve a ON a.frame = k.frame AND a.ty = y0 AND a.tx = x0 AND a.bin = k.bin JOIN curve b ON b.frame = k.frame AND b.ty = y0 AND b.tx = x1 AND b.bin = k.bin
JOIN curve c ON c.frame = k.frame AND c.ty = y1 AND c.tx = x0 AND c.bin = k.bin JOIN curve d ON d.frame = k.frame AND d.ty = y1 AND d.tx = x1 AND d.bin = k.bin""")
def local_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.side(spark, sf_dir)
    return stack.rounded(raster.local_contrast(views.raster(spark, sf_dir), n, n, tiles=4, clip=2.0, strength=0.8), "v")
