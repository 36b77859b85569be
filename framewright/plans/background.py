"""Queries of the background operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import background, stack
from ..sources import views
from .queries import query

_TILE = 8

#: Tiles of the raster, simply as mean and deviation; the wholes of frames that miss no tile.
_TILES = f"""{views.RASTER}, tiles AS (SELECT frame, y // {_TILE} AS ty, x // {_TILE} AS tx, avg(v) AS sky, stddev_pop(v) AS sigma FROM raster GROUP BY ALL)"""


def tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    pixels = views.raster(spark, sf_dir)
    place = lambda c: F.floor(F.col(c) / _TILE).cast("int").alias(f"t{c}")
    found = pixels.groupBy("frame", place("y"), place("x")).agg(F.avg("v").alias("sky"), F.stddev_pop("v").alias("sigma"))
    return pixels, found, views.side(spark, sf_dir)


def _bent(to: str, of: str, along: str, value: str) -> str:
    """Second derivatives of the natural splines through ``value`` along an axis: one sweep up, one down."""
    other = "tx" if along == "ty" else "ty"
    return f"""{to}l AS (
  SELECT frame, {other}, list(c ORDER BY {along}) AS c, list({value} ORDER BY {along}) AS v, count(*) AS n FROM (
    SELECT *, ({along} * {_TILE} + least({along} * {_TILE} + {_TILE}, s) - 1) / 2.0::DOUBLE AS c FROM {of}, side) GROUP BY ALL), {to}u AS (
  SELECT frame, {other}, c, v, n, 0 AS k, []::DOUBLE[] AS p, []::DOUBLE[] AS d FROM {to}l UNION ALL
  SELECT frame, {other}, c, v, n, k + 1, list_append(p, (c[k + 3] - c[k + 2]) / size), list_append(d, (6 * ((v[k + 3] - v[k + 2]) / (c[k + 3] - c[k + 2]) - (v[k + 2] - v[k + 1]) / (c[k + 2] - c[k + 1]))
    - CASE WHEN k > 0 THEN (c[k + 2] - c[k + 1]) * d[k] ELSE 0 END) / size)
  FROM (SELECT *, 2 * (c[k + 3] - c[k + 1]) - CASE WHEN k > 0 THEN (c[k + 2] - c[k + 1]) * p[k] ELSE 0 END AS size FROM {to}u WHERE k < n - 2)), {to}d AS (
  SELECT frame, {other}, n, p, d, greatest(n - 2, 0) AS k, [0.0::DOUBLE] AS x FROM {to}u WHERE k = greatest(n - 2, 0) UNION ALL
  SELECT frame, {other}, n, p, d, k - 1, list_prepend(d[k] - p[k] * x[1], x) FROM {to}d WHERE k > 0), {to} AS (
  SELECT frame, {other}, unnest(range(n)) AS {along}, unnest(CASE WHEN n = 1 THEN [0.0::DOUBLE] ELSE list_prepend(0.0::DOUBLE, x) END) AS {to} FROM {to}d WHERE k = 0)"""


def _along(f0: str, f1: str, d0: str, d1: str, h: str, t: str) -> str:
    return f"((1 - {t}) * {f0} + {t} * {f1} + {h} * {h} / 6 * (((1 - {t}) ** 3 - (1 - {t})) * {d0} + ({t} ** 3 - {t}) * {d1}))"


def _bicubic(c: str) -> str:
    line = lambda i, n: _along(f"n{i}0.{n}", f"n{i}1.{n}", f"n{i}0.{n}_x", f"n{i}1.{n}_x", "w", "u")
    return _along(line(0, c), line(1, c), line(0, f"{c}_y"), line(1, f"{c}_y"), "h", "t")


@query(f"""
WITH RECURSIVE {_TILES}, {_bent("sky_y", "tiles", "ty", "sky")}, {_bent("sky_x", "tiles", "tx", "sky")}, ty_ AS (SELECT * FROM tiles JOIN sky_y USING (frame, ty, tx)),
{_bent("sky_y_x", "ty_", "tx", "sky_y")}, nodes AS (SELECT * FROM tiles JOIN sky_y USING (frame, ty, tx) JOIN sky_x USING (frame, ty, tx) JOIN sky_y_x USING (frame, ty, tx)), c AS (
  SELECT s, ((s + {_TILE} - 1) // {_TILE})::INT AS m, (least({_TILE}, s) - 1) / 2.0::DOUBLE AS first, (((s + {_TILE} - 1) // {_TILE} - 1) * {_TILE} + s - 1) / 2.0::DOUBLE AS last FROM side), a AS (
  SELECT frame, y, x, v, s, m, first, last, greatest(least(floor((least(greatest(y, first), last) - first) / {_TILE}), m - 2), 0)::INT AS cy,
         greatest(least(floor((least(greatest(x, first), last) - first) / {_TILE}), m - 2), 0)::INT AS cx FROM raster, c), b AS (
  SELECT *, CASE WHEN cy = m - 2 THEN last - (first + cy * {_TILE}) ELSE {_TILE} END::DOUBLE AS h, CASE WHEN cx = m - 2 THEN last - (first + cx * {_TILE}) ELSE {_TILE} END::DOUBLE AS w FROM a), p AS (
  SELECT frame, y, x, v, cy, cx, h, w, (least(greatest(y, first), last) - first - cy * {_TILE}) / h AS t, (least(greatest(x, first), last) - first - cx * {_TILE}) / w AS u, m FROM b)
SELECT p.frame, y, x, round({_bicubic("sky")}, 6) AS sky FROM p
JOIN nodes n00 ON n00.frame = p.frame AND n00.ty = cy AND n00.tx = cx JOIN nodes n01 ON n01.frame = p.frame AND n01.ty = cy AND n01.tx = least(cx + 1, m - 1)
JOIN nodes n10 ON n10.frame = p.frame AND n10.ty = least(cy + 1, m - 1) AND n10.tx = cx JOIN nodes n11 ON n11.frame = p.frame AND n11.ty = least(cy + 1, m - 1) AND n11.tx = least(cx + 1, m - 1)""")
def spline_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, found, n = tiles(spark, sf_dir)
    return stack.rounded(background.spline_planes(pixels, found, _TILE, n, n).select("frame", "y", "x", "sky"), "sky")


_PLANE = """SELECT frame, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * z) AS xz, sum(y * z) AS yz"""
_SOLVED = """SELECT frame, n, (sz - b * sx - c * sy) / n AS a, b, c FROM (
  SELECT *, (p * s - q * r) / (o * s - q * q) AS b, (o * r - q * p) / (o * s - q * q) AS c FROM (
    SELECT *, xx - sx * sx / n AS o, xy - sx * sy / n AS q, yy - sy * sy / n AS s, xz - sx * sz / n AS p, yz - sy * sz / n AS r FROM {of}))"""


@query(f"""
WITH {_TILES}, places AS (
  SELECT frame, 2.0::DOUBLE * ((tx * {_TILE} + least(tx * {_TILE} + {_TILE}, s) - 1) / 2.0::DOUBLE) / (s - 1) - 1 AS x,
         2.0::DOUBLE * ((ty * {_TILE} + least(ty * {_TILE} + {_TILE}, s) - 1) / 2.0::DOUBLE) / (s - 1) - 1 AS y, sky AS z FROM tiles, side), s1 AS (
  {_PLANE} FROM places GROUP BY frame), f1 AS ({_SOLVED.format(of="s1")}), r1 AS (SELECT p.*, z - (a + b * x + c * y) AS r FROM places p JOIN f1 USING (frame)), m1 AS (
  SELECT frame, median(r) AS m FROM r1 GROUP BY frame), d1 AS (SELECT frame, 2 * 1.4826022 * median(abs(r - m)) AS bound FROM r1 JOIN m1 USING (frame) GROUP BY frame), k1 AS (
  SELECT frame, x, y, z, abs(r) <= bound AS keep FROM r1 JOIN d1 USING (frame) WHERE bound > 0), go AS (
  SELECT frame FROM k1 GROUP BY frame HAVING count(*) FILTER (keep) < count(*) AND count(*) FILTER (keep) >= 3), s2 AS (
  {_PLANE} FROM k1 SEMI JOIN go USING (frame) WHERE keep GROUP BY frame), f2 AS ({_SOLVED.format(of="s2")}), f AS (
  SELECT * FROM f2 UNION ALL SELECT * FROM f1 ANTI JOIN go USING (frame))
SELECT frame, y, x, round(v - (a + b * (2.0::DOUBLE * x / (s - 1) - 1) + c * (2.0::DOUBLE * y / (s - 1) - 1)), 6) AS v FROM raster JOIN f USING (frame), side""")
def plane_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame less the plane through its tiles, after one round of clipping at two deviations."""
    pixels, found, n = tiles(spark, sf_dir)
    fits = background.fit_surfaces(found, _TILE, n, n, degree=1, sigmas=2.0, rounds=1)
    return stack.rounded(background.surface_removed(pixels, fits, n, n), "v")


@query()
def refined_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splines through tiles that leave bright pixels out, in two rounds; the tests plant objects that it must leave out."""
    pixels, _, n = tiles(spark, sf_dir)
    found = background.refined_background(pixels, _TILE, n, n, sigmas=2.0)
    return stack.rounded(found.select("frame", "y", "x", "sky", "noise"), "sky", "noise")
