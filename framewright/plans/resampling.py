"""Queries of the warp kernels and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import resampling, stack
from ..sources import views
from .queries import query

_M = [0.998, 0.06, -1.3, -0.06, 0.998, 1.7]
_SX, _SY = (f"({a!r}::DOUBLE * x + {b!r}::DOUBLE * y + {c!r}::DOUBLE)" for a, b, c in (_M[:3], _M[3:]))


def _taps(weight, a: int, of: str) -> str:
    """Sums over the taps that meet a pixel of the places of ``of``."""
    return f"""SELECT o.frame, o.y, o.x, sum(w * p.v) AS total, sum(w) AS held, sum(w * w) AS squares, count(*) AS n FROM (
  SELECT frame, y, x, floor(sy)::INT + j AS py, floor(sx)::INT + i AS px, ({weight(f"abs(sy - floor(sy) - j)")}) * ({weight(f"abs(sx - floor(sx) - i)")}) AS w
  FROM {of}, (SELECT unnest(range({1 - a}, {a + 1})) AS j), (SELECT unnest(range({1 - a}, {a + 1})) AS i)) o
  JOIN raster p ON p.frame = o.frame AND p.y = o.py AND p.x = o.px WHERE w <> 0 GROUP BY ALL"""


def _cubic(d: str) -> str:
    return f"CASE WHEN {d} <= 1 THEN (1.5::DOUBLE * {d} - 2.5::DOUBLE) * {d} * {d} + 1 WHEN {d} < 2 THEN ((-0.5::DOUBLE * {d} + 2.5::DOUBLE) * {d} - 4) * {d} + 2 ELSE 0 END"


def _sinc(d: str) -> str:
    t = f"(floor({d} * 4096 + 0.5::DOUBLE) / 4096)"
    return f"CASE WHEN {t} = 0 THEN 1 WHEN {t} < 3 THEN 3 * sin(pi() * {t}) * sin(pi() * {t} / 3) / (pi() * pi() * {t} * {t}) ELSE 0 END"


_PLACES = f"""{views.RASTER}, places AS (SELECT frame, y, x, sx, sy FROM (SELECT frame, y, x, {_SX} AS sx, {_SY} AS sy, s FROM raster, side)
  WHERE sx BETWEEN -0.5 AND s - 0.5::DOUBLE AND sy BETWEEN -0.5 AND s - 0.5::DOUBLE)"""


@query(f"""
WITH {_PLACES}, t AS ({_taps(_cubic, 2, "places")})
SELECT frame, y, x, round(CASE WHEN abs(held) >= 1e-10 THEN total / held ELSE 0 END, 6) AS v, round(coalesce(CASE WHEN abs(held) >= 1e-10 THEN squares / (held * held) END, 0), 6) AS noise_gain
FROM raster LEFT JOIN t USING (frame, y, x)""".replace("round(CASE WHEN abs(held)", "round(CASE WHEN held IS NOT NULL AND abs(held)"))
def warped_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.side(spark, sf_dir)
    found = resampling.warped(views.raster(spark, sf_dir), _M, n, n, "bicubic")
    return stack.rounded(found.select("frame", "y", "x", "v", "noise_gain"), "v", "noise_gain")


@query(f"""
WITH {_PLACES}, every AS (SELECT frame, y, x, sum((CASE WHEN ({_sinc("abs(sy - floor(sy) - j)")}) * ({_sinc("abs(sx - floor(sx) - i)")}) <> 0 THEN 1 ELSE 0 END)) AS wanted
  FROM places, (SELECT unnest(range(-2, 4)) AS j), (SELECT unnest(range(-2, 4)) AS i) GROUP BY ALL), t AS ({_taps(_sinc, 3, "places")}), clamped AS (
  SELECT frame, y, x, sx, sy FROM places), b AS ({_taps(lambda d: f"greatest(1 - {d}, 0)", 1, "clamped")})
SELECT r.frame, r.y, r.x, round(coalesce(CASE WHEN t.n = wanted THEN t.total / t.held WHEN b.held >= 1e-10 THEN b.total / b.held END, 0), 6) AS v
FROM raster r LEFT JOIN every USING (frame, y, x) LEFT JOIN t USING (frame, y, x) LEFT JOIN b USING (frame, y, x)""")
def warped_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.side(spark, sf_dir)
    found = resampling.warped(views.raster(spark, sf_dir), _M, n, n, "lanczos3")
    return stack.rounded(found.select("frame", "y", "x", "v"), "v")
