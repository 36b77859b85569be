"""Queries of the drizzle kernels and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drizzling, stack
from ..sources import views
from .queries import query

_CENTRES = f"""{views.RASTER}, maps AS (
  SELECT DISTINCT frame, 1 - frame * 0.001::DOUBLE AS a, frame * 0.01::DOUBLE AS b, frame * 0.25::DOUBLE - 1 AS c,
         frame * -0.01::DOUBLE AS d, 1 + frame * 0.002::DOUBLE AS e, 0.5 - frame * 0.125::DOUBLE AS f FROM raster), centres AS (
  SELECT frame, y, x, v, s, a, b, c, d, e, f, abs(a * e - b * d) AS area, (a * x + b * y + c + 0.5) * SCALE - 0.5 AS cx, (d * x + e * y + f + 0.5) * SCALE - 0.5 AS cy
  FROM raster JOIN maps USING (frame), side)"""

_MEANS = """kept AS (SELECT * FROM cells WHERE abs(w) > 1e-12 AND oy BETWEEN 0 AND s * SCALE - 1 AND ox BETWEEN 0 AND s * SCALE - 1), sums AS (
  SELECT oy, ox, sum(v * w) AS total, sum(w) AS weight, sum(w * w) AS squares, count(DISTINCT frame) AS coverage FROM kept GROUP BY oy, ox)
SELECT oy::INT AS y, ox::INT AS x, round(CASE WHEN weight >= 0.1 * max(weight) OVER () AND weight > 0 THEN MEAN ELSE 0 END, 6) AS v, round(weight, 6) AS weight, coverage::INT AS coverage
FROM sums"""


def _sql(cells: str, scale: int, mean: str = "total / weight") -> str:
    return f"WITH {_CENTRES}, {cells}, {_MEANS}".replace("SCALE", f"{scale}.0::DOUBLE").replace("MEAN", mean)


def _radial(far: int, weight: str) -> str:
    of = lambda c: weight.replace("@", f"(round({c}) + i - {c})")
    taps = lambda n, c: f"{n} AS (SELECT frame, y, x, unnest(range({-far}, {far + 1})) AS i, {c} FROM centres)"
    valued = lambda n, c, t: f"{n} AS (SELECT frame, y, x, round({c})::INT + i AS o, {of(c)} AS k FROM {t})"
    totals = lambda n, t: f"{n} AS (SELECT frame, y, x, sum(k) AS k FROM {t} GROUP BY ALL)"
    return ", ".join([
        taps("iy", "cy"), taps("ix", "cx"), valued("ky", "cy", "iy"), valued("kx", "cx", "ix"), totals("sy", "ky"), totals("sx", "kx"),
        """cells AS (SELECT frame, ky.o AS oy, kx.o AS ox, v, s, ky.k * kx.k / (sy.k * sx.k) / area AS w
  FROM centres JOIN ky USING (frame, y, x) JOIN kx USING (frame, y, x) JOIN sy USING (frame, y, x) JOIN sx USING (frame, y, x) WHERE abs(sy.k * sx.k) >= 1e-10)""",
    ])


_CORNERS = """ends AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM centres), sides AS (
  SELECT *, list_extract([-0.4, 0.4, 0.4, -0.4], k + 1)::DOUBLE AS dx, list_extract([-0.4, -0.4, 0.4, 0.4], k + 1)::DOUBLE AS dy,
         list_extract([0.4, 0.4, -0.4, -0.4], k + 1)::DOUBLE AS tx, list_extract([-0.4, 0.4, 0.4, -0.4], k + 1)::DOUBLE AS ty FROM ends), outline AS (
  SELECT frame, y, x, v, s, area, k, (a * (x + dx) + b * (y + dy) + c + 0.5) * SCALE - 0.5 AS x1, (d * (x + dx) + e * (y + dy) + f + 0.5) * SCALE - 0.5 AS y1,
         (a * (x + tx) + b * (y + ty) + c + 0.5) * SCALE - 0.5 AS x2, (d * (x + tx) + e * (y + ty) + f + 0.5) * SCALE - 0.5 AS y2 FROM sides), boxes AS (
  SELECT frame, y, x, unnest(range(round(min(y1))::INT, round(max(y1))::INT + 1)) AS oy, round(min(x1))::INT AS left_, round(max(x1))::INT AS right_ FROM outline GROUP BY frame, y, x), places AS (
  SELECT frame, y, x, oy, unnest(range(left_, right_ + 1)) AS ox FROM boxes), moved AS (
  SELECT frame, y, x, v, s, area, oy, ox, x1 - ox + 0.5 AS x1, x2 - ox + 0.5 AS x2, y1 - oy + 0.5 AS y1, (y2 - y1) / (x2 - x1) AS m FROM outline JOIN places USING (frame, y, x) WHERE abs(x2 - x1) > 1e-14), cut AS (
  SELECT *, greatest(least(x1, 1), 0) AS p, greatest(least(x2, 1), 0) AS q FROM moved), heights AS (SELECT *, y1 + m * (p - x1) AS lo, y1 + m * (q - x1) AS hi FROM cut), under AS (
  SELECT *, CASE WHEN lo <= 0 THEN 0 WHEN lo < 1 THEN lo * lo / 2 ELSE lo - 0.5 END AS g, CASE WHEN hi <= 0 THEN 0 WHEN hi < 1 THEN hi * hi / 2 ELSE hi - 0.5 END AS h FROM heights), cells AS (
  SELECT frame, oy, ox, v, s, abs(sum((q - p) * CASE WHEN abs(hi - lo) > 4e-8 THEN (h - g) / (hi - lo) ELSE greatest(least((lo + hi) / 2, 1), 0) END)) / (area * (0.8::DOUBLE * SCALE) * (0.8::DOUBLE * SCALE)) AS w
  FROM under GROUP BY frame, y, x, v, s, area, oy, ox)"""


def _laid(spark: SparkSession, sf_dir: str, kernel: str, scale: float = 2.0, drop: float = 0.8) -> DataFrame:
    """The raster's frames, each by a map of its own."""
    n, pixels, frame = views.side(spark, sf_dir), views.raster(spark, sf_dir), F.col("frame")
    maps = {"a": 1 - frame * 0.001, "b": frame * 0.01, "c": frame * 0.25 - 1, "d": frame * -0.01, "e": 1 + frame * 0.002, "f": 0.5 - frame * 0.125}
    found = drizzling.drizzled(pixels, pixels.select("frame").distinct().withColumns(maps), n, n, kernel, scale, drop)
    return stack.rounded(found.select("y", "x", "v", "weight", "coverage"), "v", "weight")


@query(_sql(_CORNERS, 2))
def drizzled_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "square")


@query(_sql("cells AS (SELECT frame, round(cy)::INT AS oy, round(cx)::INT AS ox, v, s, 1 / area AS w FROM centres)", 2))
def drizzled_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "point")


@query(_sql(_radial(3, "exp(-@ * @ / (2 * (1.6::DOUBLE / 2.3548::DOUBLE) * (1.6::DOUBLE / 2.3548::DOUBLE)))"), 2))
def drizzled_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "gaussian")


@query(_sql(_radial(3, "CASE WHEN @ = 0 THEN 1 WHEN abs(@) < 3 THEN 3 * sin(pi() * @) * sin(pi() * @ / 3) / (pi() * pi() * @ * @) ELSE 0 END"), 1, "greatest(total / weight, 0)"))
def drizzled_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _laid(spark, sf_dir, "lanczos3", 1.0, 1.0)
