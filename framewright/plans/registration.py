"""Queries of the registration operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registration, stack
from ..sources import views
from .queries import query

#: A frame's stars seen again: turned, scaled, shifted and disturbed by up to a twentieth of a pixel; each catalogue misses some.
_TURNED = """{stars}, a_side AS (SELECT * FROM stars WHERE star % 7 <> 0), b_side AS (
  SELECT frame, star + 1000000000 AS star, 1.02 * (0.995 * x - 0.1 * y) + 12.5 + (star % 11 - 5) / 100.0::DOUBLE AS x,
         1.02 * (0.1 * x + 0.995 * y) - 7.25 + (star % 13 - 6) / 120.0::DOUBLE AS y, flux, fwhm FROM stars WHERE star % 9 <> 0)"""
TURNED = _TURNED.format(stars=views.STARS)


def turned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = views.stars(spark, sf_dir)
    x, y, star = F.col("x"), F.col("y"), F.col("star")
    moved = {
        "x": 1.02 * (0.995 * x - 0.1 * y) + 12.5 + (star % 11 - 5) / 100.0,
        "y": 1.02 * (0.1 * x + 0.995 * y) - 7.25 + (star % 13 - 6) / 120.0,
        "star": star + 1000000000,
    }
    return found.filter("star % 7 <> 0"), found.filter("star % 9 <> 0").withColumns(moved)


def _triangles(to: str, of: str) -> str:
    """Triangles of the 20 brightest stars with their k nearest."""
    return f"""{to}_few AS (SELECT frame, star, x, y FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY flux DESC, star) AS r FROM {of}) WHERE r <= 20), {to}_near AS (
  SELECT frame, p, px, py, q, qx, qy FROM (
    SELECT p.frame, p.star AS p, p.x AS px, p.y AS py, q.star AS q, q.x AS qx, q.y AS qy,
           row_number() OVER (PARTITION BY p.frame, p.star ORDER BY (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), q.star) AS r
    FROM {to}_few p JOIN {to}_few q ON p.frame = q.frame AND p.star <> q.star) JOIN k USING (frame) WHERE r <= k), {to}_three AS (
  SELECT DISTINCT a.frame, list_sort([{{'s': a.p, 'x': a.px, 'y': a.py}}, {{'s': a.q, 'x': a.qx, 'y': a.qy}}, {{'s': b.q, 'x': b.qx, 'y': b.qy}}]) AS c
  FROM {to}_near a JOIN {to}_near b ON a.frame = b.frame AND a.p = b.p AND a.q < b.q), {to}_sides AS (
  SELECT frame, list_sort([
    {{'d': sqrt((c[1].x - c[2].x) * (c[1].x - c[2].x) + (c[1].y - c[2].y) * (c[1].y - c[2].y)), 's': c[3].s, 'x': c[3].x, 'y': c[3].y}},
    {{'d': sqrt((c[2].x - c[3].x) * (c[2].x - c[3].x) + (c[2].y - c[3].y) * (c[2].y - c[3].y)), 's': c[1].s, 'x': c[1].x, 'y': c[1].y}},
    {{'d': sqrt((c[1].x - c[3].x) * (c[1].x - c[3].x) + (c[1].y - c[3].y) * (c[1].y - c[3].y)), 's': c[2].s, 'x': c[2].x, 'y': c[2].y}}]) AS s FROM {to}_three), {to} AS (
  SELECT frame, s[1].s AS v0, s[2].s AS v1, s[3].s AS v2, s[1].d / s[3].d AS r0, s[2].d / s[3].d AS r1, turn > 0 AS ccw FROM (
    SELECT *, (s[1].d + s[2].d + s[3].d) / 2 AS h, (s[2].x - s[1].x) * (s[3].y - s[1].y) - (s[2].y - s[1].y) * (s[3].x - s[1].x) AS turn FROM {to}_sides)
  WHERE s[1].d >= 1e-10 AND s[3].d / s[1].d <= 10 AND h * (h - s[1].d) * (h - s[2].d) * (h - s[3].d) >= 1e-6 AND abs(turn) >= 1e-10 * s[3].d * s[3].d)"""


_K = """k AS (SELECT frame, greatest(least(least(n, m, 20) // 3, 10), 5)::INT AS k FROM (SELECT frame, count(*) AS n FROM a_side GROUP BY frame)
  JOIN (SELECT frame, count(*) AS m FROM b_side GROUP BY frame) USING (frame) WHERE n >= 3 AND m >= 3)"""
_VOTES = """votes AS (SELECT frame, a, b, count(*) AS votes FROM (
  SELECT ta.frame, unnest([ta.v0, ta.v1, ta.v2]) AS a, unnest([tb.v0, tb.v1, tb.v2]) AS b
  FROM ta JOIN tb ON ta.frame = tb.frame AND ta.ccw = tb.ccw AND abs(ta.r0 - tb.r0) < 0.01 AND abs(ta.r1 - tb.r1) < 0.01) GROUP BY ALL)"""
_AMONG = 20


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left, right = turned(spark, sf_dir)
    counts = registration.neighbour_counts(left, right, _AMONG)
    return registration.triangles(left, counts, _AMONG), registration.triangles(right, counts, _AMONG)


@query(f"""WITH {TURNED}, {_K}, {_triangles("ta", "a_side")} SELECT frame, v0, v1, v2, round(r0, 9) AS r0, round(r1, 9) AS r1, ccw FROM ta""")
def triangle_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of each frame's brightest stars with their nearest, and their shapes."""
    return stack.rounded(_both(spark, sf_dir)[0], "r0", "r1", places=9)


@query(f"""WITH {TURNED}, {_K}, {_triangles("ta", "a_side")}, {_triangles("tb", "b_side")}, {_VOTES} SELECT frame, a, b, votes FROM votes""")
def triangle_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.triangle_votes(*_both(spark, sf_dir))


@query(f"""
WITH RECURSIVE {TURNED}, {_K}, {_triangles("ta", "a_side")}, {_triangles("tb", "b_side")}, {_VOTES}, o AS (
  SELECT frame, list({{'a': a, 'b': b, 'v': votes}} ORDER BY votes DESC, a, b) AS l FROM votes WHERE votes >= 3 GROUP BY frame), r AS (
  SELECT frame, l, 1 AS k, l[1:0] AS taken FROM o UNION ALL
  SELECT frame, l, k + 1, CASE WHEN len(list_filter(taken, lambda z: z.a = l[k].a OR z.b = l[k].b)) = 0 THEN list_append(taken, l[k]) ELSE taken END FROM r WHERE k <= len(l))
SELECT frame, z.a AS a, z.b AS b, z.v AS votes, round(z.v / max(z.v) OVER (PARTITION BY frame), 9) AS confidence
FROM (SELECT frame, unnest(taken) AS z FROM r WHERE k = len(l) + 1)""")
def voted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(registration.matches_by_votes(registration.triangle_votes(*_both(spark, sf_dir))), "confidence", places=9)


#: Each star and where it is seen again; of ten stars four are seen anywhere.
_SEEN = """{stars}, seen AS (
  SELECT frame, star, x AS rx, y AS ry, star % 10 < 6 AS good,
         CASE WHEN star % 10 < 6 THEN {tx} ELSE star * 31 % 997 END::DOUBLE AS tx, CASE WHEN star % 10 < 6 THEN {ty} ELSE star * 37 % 991 END::DOUBLE AS ty FROM stars)"""


def seen(spark: SparkSession, sf_dir: str, tx, ty) -> DataFrame:
    x, y, star = F.col("x"), F.col("y"), F.col("star")
    good = star % 10 < 6
    wrong = lambda k, n: (star * k % n).cast("double")
    return views.stars(spark, sf_dir).select(
        "frame", star.alias("a"), star.alias("b"), x.alias("rx"), y.alias("ry"),
        F.when(good, tx(x, y)).otherwise(wrong(31, 997)).alias("tx"), F.when(good, ty(x, y)).otherwise(wrong(37, 991)).alias("ty"),
    )


_AFFINE_X, _AFFINE_Y = "1.01 * x - 0.08 * y + 5.5", "0.07 * x + 0.98 * y - 3.25"


@query(f"""
WITH {_SEEN.format(stars=views.STARS, tx=_AFFINE_X, ty=_AFFINE_Y)}, c AS (
  SELECT frame, count(*) AS n, avg(rx) AS ax, avg(ry) AS ay, avg(tx) AS bx, avg(ty) AS by_ FROM seen GROUP BY frame), s AS (
  SELECT frame, n, ax, ay, bx, by_, sum((rx - ax) * (rx - ax)) AS xx, sum((rx - ax) * (ry - ay)) AS xy, sum((ry - ay) * (ry - ay)) AS yy,
         sum((rx - ax) * (tx - bx)) AS xu, sum((ry - ay) * (tx - bx)) AS yu, sum((rx - ax) * (ty - by_)) AS xv, sum((ry - ay) * (ty - by_)) AS yv
  FROM seen JOIN c USING (frame) GROUP BY ALL), m AS (
  SELECT *, (yy * xu - xy * yu) / (xx * yy - xy * xy) AS m0, (xx * yu - xy * xu) / (xx * yy - xy * xy) AS m1,
         (yy * xv - xy * yv) / (xx * yy - xy * xy) AS m3, (xx * yv - xy * xv) / (xx * yy - xy * xy) AS m4 FROM s)
SELECT frame, n, round(m0, 6) AS m0, round(m1, 6) AS m1, round(bx - m0 * ax - m1 * ay, 4) AS m2, round(m3, 6) AS m3, round(m4, 6) AS m4,
       round(by_ - m3 * ax - m4 * ay, 4) AS m5 FROM m""")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares over all, outliers included."""
    pairs = seen(spark, sf_dir, lambda x, y: 1.01 * x - 0.08 * y + 5.5, lambda x, y: 0.07 * x + 0.98 * y - 3.25)
    return _numbers(registration.fitted(pairs, "affine"), "frame", "n", count=6)


def _numbers(found: DataFrame, *keep: str, count: int) -> DataFrame:
    """The transform's numbers as columns; shifts to four places, the others to six (nine for a homography's last two)."""
    places = lambda i: 9 if i > 5 else 4 if i in (2, 5) else 6
    return found.select(*keep, *(F.round(F.get("m", F.lit(i)), places(i)).alias(f"m{i}") for i in range(count)))


@query(f"""
WITH {_SEEN.format(stars=views.STARS, tx=_AFFINE_X, ty=_AFFINE_Y)}
SELECT frame, count(*) AS n, 1.01::DOUBLE AS m0, -0.08::DOUBLE AS m1, 5.5::DOUBLE AS m2, 0.07::DOUBLE AS m3, 0.98::DOUBLE AS m4, -3.25::DOUBLE AS m5
FROM seen GROUP BY frame HAVING count(*) FILTER (good) >= 3""")
def affine_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform that six of ten stars were moved by, found among the others; the SQL knows it."""
    pairs = seen(spark, sf_dir, lambda x, y: 1.01 * x - 0.08 * y + 5.5, lambda x, y: 0.07 * x + 0.98 * y - 3.25)
    return _numbers(registration.consensus(pairs, "affine", 1.0, seed=7), "frame", "n", count=6)


@query(f"""
WITH {_SEEN.format(stars=views.STARS, tx="(0.99 * x + 0.02 * y + 4) / (1 + 0.00002 * x - 0.00001 * y)", ty="(1.01 * y - 0.03 * x - 6) / (1 + 0.00002 * x - 0.00001 * y)")}
SELECT frame, 'homography' AS model, 0.99::DOUBLE AS m0, 0.02::DOUBLE AS m1, 4::DOUBLE AS m2, -0.03::DOUBLE AS m3, 1.01::DOUBLE AS m4, -6::DOUBLE AS m5,
       0.00002::DOUBLE AS m6, -0.00001::DOUBLE AS m7 FROM seen GROUP BY frame HAVING count(*) FILTER (good) >= 4""")
def ladder_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projective motion, which no simpler model fits; the SQL knows it."""
    w = lambda x, y: 1 + 0.00002 * x - 0.00001 * y
    pairs = seen(spark, sf_dir, lambda x, y: (0.99 * x + 0.02 * y + 4) / w(x, y), lambda x, y: (1.01 * y - 0.03 * x - 6) / w(x, y))
    return _numbers(registration.model_ladder(pairs, 1.0, bar=0.05, seed=7), "frame", "model", count=8)


@query(f"""
WITH {TURNED} SELECT a.frame, a.star AS a, b.star AS b FROM a_side a JOIN b_side b ON a.frame = b.frame AND b.star = a.star + 1000000000""")
def recovered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stars that both catalogues have, from matches of every fifth one; places are disturbed by less than the threshold
    and lie farther apart than it, so the SQL knows the matches."""
    left, right = turned(spark, sf_dir)
    some = left.filter("star % 5 = 0").select("frame", F.col("star").alias("a"), (F.col("star") + 1000000000).alias("b"))
    known = registration.with_places(some, left, right)
    start = registration.fitted(known, "similarity")
    known = known.join(start.select("frame"), "frame", "left_semi")
    return registration.recovered(left, right, start, known, 0.5, "similarity")[1]


@query(f"""
WITH {views.STARS} SELECT frame, star, CASE WHEN star % 50 = 3 THEN 'position' ELSE 'fwhm' END AS fault FROM stars WHERE star % 50 IN (3, 4)""")
def catalogue_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars whose place or width was taken away."""
    star = F.col("star")
    spoiled = {"x": F.when(star % 50 == 3, None).otherwise(F.col("x")), "fwhm": F.when(star % 50 == 4, float("nan")).otherwise(F.col("fwhm"))}
    return registration.valid_catalogue(views.stars(spark, sf_dir).withColumns(spoiled))
