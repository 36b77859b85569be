"""Queries of the star measurements and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import measurement, stack
from ..sources import views
from .queries import query

_FWHM = 3.0
_R = measurement.stamp_radius(_FWHM)
_SIDE = 2 * _R + 1
_SIGMA = min(max(_FWHM / 2.354820045 * 0.8, 1.0), _R * 0.5)

#: Pixels with the mean and the deviation of their frame as sky and noise, and bright pixels as peaks.
_LIT = f"""{views.RASTER}, lit AS (
  SELECT r.frame, r.y, r.x, v, sky, noise FROM raster r JOIN (SELECT frame, avg(v) AS sky, stddev_pop(v) AS noise FROM raster GROUP BY frame) USING (frame)), peaks AS (
  SELECT frame, (y * 100000 + x)::BIGINT AS star, y, x FROM raster WHERE v > 0.6)"""


def lit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pixels = views.raster(spark, sf_dir)
    levels = pixels.groupBy("frame").agg(F.avg("v").alias("sky"), F.stddev_pop("v").alias("noise"))
    star = (F.col("y") * 100000 + F.col("x")).cast("long")
    peaks = pixels.filter("v > 0.6").select("frame", star.alias("star"), F.col("y").alias("py"), F.col("x").alias("px"))
    return pixels.join(F.broadcast(levels), "frame"), peaks  # a row for each frame


def _stamp(to: str, of: str) -> str:
    """Pixels of the whole stamps about the places (x, y) of ``of``."""
    return f"""{to} AS (
  SELECT * FROM (SELECT c.frame, c.star, c.x AS cx, c.y AS cy, p.x - c.x AS dx, p.y - c.y AS dy, p.x - floor(c.x + 0.5) AS ix, p.y - floor(c.y + 0.5) AS iy, v, v - sky AS s,
    greatest(v - sky, 0) AS l, noise, count(*) OVER (PARTITION BY c.frame, c.star) AS n
  FROM {of} c JOIN lit p ON p.frame = c.frame AND abs(p.x - floor(c.x + 0.5)) <= {_R} AND abs(p.y - floor(c.y + 0.5)) <= {_R}) WHERE n = {_SIDE * _SIDE})"""


def _step(to: str, of: str) -> str:
    w = f"l * exp(-dy * dy / {2 * _SIGMA * _SIGMA!r}::DOUBLE) * exp(-dx * dx / {2 * _SIGMA * _SIGMA!r}::DOUBLE)"
    return f"""{_stamp(to + "p", of)}, {to} AS (
  SELECT frame, star, cx + sx AS x, cy + sy AS y FROM (SELECT frame, star, cx, cy, sum({w}) AS t, sum({w} * dx) / sum({w}) AS sx, sum({w} * dy) / sum({w}) AS sy FROM {to}p GROUP BY ALL)
  WHERE t >= 2.220446049250313e-16 AND abs(sx) <= {_SIDE / 4} AND abs(sy) <= {_SIDE / 4})"""


def _window(k: int) -> str:
    w = "s * exp(-dy * dy / (2 * w)) * exp(-dx * dx / (2 * w))"
    return f"""o{k} AS (
  SELECT frame, star, w, moving, bxx, byy, bxy, sum({w}) AS t, sum({w} * dx * dx) / sum({w}) AS xx, sum({w} * dy * dy) / sum({w}) AS yy, sum({w} * dx * dy) / sum({w}) AS xy
  FROM w{k - 1} JOIN stamp USING (frame, star) GROUP BY ALL), i{k} AS (
  SELECT *, xx * yy - xy * xy AS d, yy / (xx * yy - xy * xy) - 1 / w AS ixx, xx / (xx * yy - xy * xy) - 1 / w AS iyy, -xy / (xx * yy - xy * xy) AS ixy FROM o{k}), c{k} AS (
  SELECT *, ixx * iyy - ixy * ixy AS e, iyy / (ixx * iyy - ixy * ixy) AS cxx, ixx / (ixx * iyy - ixy * ixy) AS cyy, -ixy / (ixx * iyy - ixy * ixy) AS cxy FROM i{k}), n{k} AS (
  SELECT *, moving AND t >= 2.220446049250313e-16 AND abs(d) >= 1e-12 AND abs(e) >= 1e-12 AND cxx * cyy - cxy * cxy > 0 AND cxx + cyy > 0 AS ok,
         least(greatest((cxx + cyy) / 2, 0.25), 100) AS nw FROM c{k}), w{k} AS (
  SELECT frame, star, CASE WHEN ok THEN nw ELSE w END AS w, ok AND NOT abs(nw - w) < 1e-3 * w AS moving, CASE WHEN ok THEN cxx ELSE bxx END AS bxx,
         CASE WHEN ok THEN cyy ELSE byy END AS byy, CASE WHEN ok THEN cxy ELSE bxy END AS bxy FROM n{k})"""


@query(f"""
WITH {_LIT}, {_step("c1_", "peaks")}, {_step("c2_", "c1_")}, {_stamp("stamp", "c2_")}, m AS (
  SELECT frame, star, cx AS x, cy AS y, sum(l) AS flux, sum(l * dx * dx) / sum(l) AS xx, sum(l * dy * dy) / sum(l) AS yy, sum(l * dx * dy) / sum(l) AS xy, max(v) AS peak,
         max(l) AS top, sum(l) FILTER (abs(ix) <= 1 AND abs(iy) <= 1) AS core, avg(noise) FILTER (ix * ix + iy * iy > {(_R - 2) ** 2}) AS noise,
         sum(l) FILTER (ix < 0) AS west, sum(l) FILTER (ix > 0) AS east, sum(l) FILTER (iy < 0) AS north, sum(l) FILTER (iy > 0) AS south
  FROM stamp GROUP BY ALL HAVING sum(l) >= 2.220446049250313e-16), hx AS (
  SELECT frame, star, max(h) AS hx FROM (SELECT frame, star, ix, sum(l) AS h FROM stamp GROUP BY ALL) GROUP BY ALL), hy AS (
  SELECT frame, star, max(h) AS hy FROM (SELECT frame, star, iy, sum(l) AS h FROM stamp GROUP BY ALL) GROUP BY ALL), w0 AS (
  SELECT frame, star, least(greatest((xx + yy) / 2, 0.25), 100) AS w, true AS moving, NULL::DOUBLE AS bxx, NULL::DOUBLE AS byy, NULL::DOUBLE AS bxy FROM m),
{_window(1)}, {_window(2)}, {_window(3)}, {_window(4)}, z AS (
  SELECT m.*, hx, hy, coalesce(bxx, xx) AS a, coalesce(byy, yy) AS b, coalesce(bxy, xy) AS c FROM m JOIN hx USING (frame, star) JOIN hy USING (frame, star) JOIN w4 USING (frame, star)), q AS (
  SELECT *, a + b AS tr, sqrt(greatest((a + b) * (a + b) - 4 * (a * b - c * c), 0)) AS root FROM z)
SELECT frame, star, round(x, 5) AS x, round(y, 5) AS y, round(flux, 6) AS flux, round(2.354820045::DOUBLE * sqrt(greatest(tr / 2, 0)), 4) AS fwhm,
       round(CASE WHEN tr + root > 4.440892098500626e-16 THEN least(sqrt(greatest(1 - (tr - root) / (tr + root), 0)), 1) ELSE 0 END, 4) AS eccentricity,
       round(flux / sqrt(greatest({_SIDE * _SIDE} * noise * noise, 1.1920929e-7)), 6) AS snr, round(peak, 6) AS peak,
       round(least(greatest(top / core, 0), 1), 6) AS sharpness, round((hx - hy) / (hx + hy), 6) AS ground,
       round(least(sqrt(((east - west) / (east + west)) ** 2 + ((south - north) / (south + north)) ** 2), 1), 6) AS sround FROM q""")
def star_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright pixels' surroundings measured as stars, with two steps of the centroid."""
    found = measurement.measured_stars(*lit(spark, sf_dir), fwhm=_FWHM, steps=2)
    found = stack.rounded(found, "flux", "snr", "peak", "sharpness", "ground", "sround")
    return stack.rounded(stack.rounded(found, "x", "y", places=5), "fwhm", "eccentricity", places=4)
