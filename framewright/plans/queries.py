"""Registered queries of the library's own operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import imaging, robust, scalar
from ..operators import catalog, raster, regions, stack
from ..sources import views
from ..streaming import events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT l_orderkey, l_linenumber, l_quantity + l_discount AS added, l_quantity - l_tax AS subtracted, l_quantity * l_discount AS multiplied,
  CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity / l_discount, 6) END AS quotient,
  CASE WHEN l_discount = 0 THEN NULL ELSE round(l_quantity % l_discount, 6) END AS remainder, l_discount = 0 AS unbounded,
  round(pow(l_quantity, 1 + l_tax), 6) AS powered, round(sqrt(l_quantity), 6) AS root, round(sin(l_quantity), 6) AS sine, round(cos(l_quantity), 6) AS cosine,
  round(tan(l_tax), 6) AS tangent, round(asin(l_discount), 6) AS arcsine, round(acos(l_discount), 6) AS arccosine, round(atan(l_quantity), 6) AS arctangent,
  round(ln(l_quantity) / ln(10.0::DOUBLE), 6) AS logarithm, trunc(l_extendedprice)::BIGINT AS whole, l_tax <> 0 AS truth
FROM lineitem""")
def math_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    quotient, remainder = scalar.divide(q, d)
    shown = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, 6))
    six = lambda c: F.round(c, 6)
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (q + d).alias("added"), (q - t).alias("subtracted"), (q * d).alias("multiplied"),
        shown(quotient).alias("quotient"), shown(remainder).alias("remainder"), (F.isnan(quotient) | (F.abs(quotient) == float("inf"))).alias("unbounded"),
        six(F.pow(q, 1 + t)).alias("powered"), six(F.sqrt(q)).alias("root"), six(F.sin(q)).alias("sine"), six(F.cos(q)).alias("cosine"),
        six(F.tan(t)).alias("tangent"), six(F.asin(d)).alias("arcsine"), six(F.acos(d)).alias("arccosine"), six(F.atan(q)).alias("arctangent"),
        six(scalar.logarithm(q, F.lit(10.0))).alias("logarithm"), scalar.to_integer(F.col("l_extendedprice")).alias("whole"), scalar.to_boolean(t).alias("truth"),
    )


@query("""
SELECT o_orderkey, regexp_replace(round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR, '\\.?0+$', '') || o_orderstatus AS label,
       o_orderkey::VARCHAR || ' items' AS counted, (o_totalprice > 200000)::VARCHAR AS large
FROM orders""")
def text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = scalar.double_text(F.round("o_totalprice", 2))
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalar.concat_text(price, F.col("o_orderstatus")).alias("label"),
        scalar.concat_text(F.col("o_orderkey").cast("string"), F.lit(" items")).alias("counted"),
        (F.col("o_totalprice") > 200000).cast("string").alias("large"),
    )


_GATHERED = "g AS (SELECT px, list_sort(list(v)) AS a, count(*) AS n FROM user_stack GROUP BY px)"


@query(f"""
WITH {views.USER_STACK}, {_GATHERED}, m AS (
  SELECT px, n, a, a[n // 2 + 1] AS upper, list_aggregate(a, 'median') AS middle FROM g)
SELECT px, n, round(upper, 6) AS median_fast, round(middle, 6) AS median_exact,
       round(list_sort(list_transform(a, lambda x: abs(x - upper)))[n // 2 + 1], 6) AS mad_fast,
       round(1.4826022 * list_aggregate(list_transform(a, lambda x: abs(x - middle)), 'median'), 6) AS sigma
FROM m""")
def robust_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    both = stack.gathered(views.user_stack(spark, sf_dir)).withColumns({"u": robust.median_fast(a), "m": robust.median(a)})
    found = both.select("px", F.size(a).cast("long").alias("n"), F.col("u").alias("median_fast"), F.col("m").alias("median_exact"), robust.mad_fast(a, F.col("u")).alias("mad_fast"), (robust.MAD_TO_SIGMA * robust.mad(a, F.col("m"))).alias("sigma"))
    return stack.rounded(found, "median_fast", "median_exact", "mad_fast", "sigma")


def _clip_pass(to: str, of: str, low: str, high: str, screen: float | None) -> str:
    """A rejection pass in DuckDB: from lists ``a`` in ``of`` to ``to``; ``done`` rows stay as they are."""
    clean = "false"
    if screen is not None:
        m, s = "(list_sum(a) - a[1] - a[-1])", "(list_sum(list_transform(a, lambda x: x * x)) - a[1] * a[1] - a[-1] * a[-1])"
        var = f"(({s} - {m} * {m} / (len(a) - 2)) / (len(a) - 3))"
        reach = f"greatest(abs(a[-1] - {m} / (len(a) - 2)), abs(a[1] - {m} / (len(a) - 2)))"
        clean = f"CASE WHEN len(a) >= 10 THEN {var} < 1.1920929e-7 OR {reach} <= {screen} * sqrt(greatest({var}, 0)) ELSE false END"
    return f"""{to} AS (
  SELECT px, n, CASE WHEN clean OR d < 1.1920929e-7 THEN a ELSE list_filter(a, lambda x: x >= c - {low} * d AND x <= c + {high} * d) END AS a
  FROM (SELECT *, 1.4826022 * list_sort(list_transform(a, lambda x: abs(x - c)))[len(a) // 2 + 1] AS d
        FROM (SELECT px, n, a, a[len(a) // 2 + 1] AS c, len(a) <= 2 OR {clean} AS clean FROM {of})))"""


_SURVIVORS = "SELECT px, n AS n_samples, len(a)::BIGINT AS n_survivors, round(list_sum(a) / len(a), 6) AS value"


@query(f"""
WITH {views.USER_STACK}, {_GATHERED}, {_clip_pass("p1", "g", "2.5", "2.5", 2.5)}, {_clip_pass("p2", "p1", "2.5", "2.5", 2.5)},
{_clip_pass("p3", "p2", "2.5", "2.5", 2.5)} {_SURVIVORS} FROM p3""")
def stack_sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(stack.rejected_stack(views.user_stack(spark, sf_dir), "sigma"), "value")


@query(f"""
WITH {views.USER_STACK}, {_GATHERED}, p AS (
  SELECT px, n, CASE WHEN n < 3 THEN a WHEN floor(n * 0.1)::INT >= n - floor(n * 0.2)::INT THEN [a[n // 2 + 1]]
                ELSE a[floor(n * 0.1)::INT + 1:n - floor(n * 0.2)::INT] END AS a FROM g)
{_SURVIVORS} FROM p""")
def stack_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(stack.rejected_stack(views.user_stack(spark, sf_dir), "percentile", low=10.0, high=20.0), "value")


def _line_pass(to: str, of: str) -> str:
    return f"""{to}l AS (
  SELECT px, n, a, c, sy, (c * sxy - sx * sy) / (c * sxx - sx * sx) AS b FROM (
    SELECT px, n, a, len(a)::DOUBLE AS c, list_sum(a) AS sy, len(a) * (len(a) - 1) / 2 AS sx, (len(a) - 1) * len(a) * (2 * len(a) - 1) / 6 AS sxx,
           list_sum(list_transform(a, lambda x, i: x * (i - 1))) AS sxy FROM {of})),
{to} AS (
  SELECT px, n, CASE WHEN len(a) <= 3 OR d < 1.1920929e-7 THEN a ELSE
         list_filter(a, lambda x, i: x >= o + b * (i - 1) - 3.0 * d AND x <= o + b * (i - 1) + 3.0 * d) END AS a
  FROM (SELECT *, list_sum(list_transform(a, lambda x, i: abs(x - (o + b * (i - 1))))) / c AS d
        FROM (SELECT *, (sy - b * (c * (c - 1) / 2)) / c AS o FROM {to}l)))"""


@query(f"""
WITH {views.USER_STACK}, {_GATHERED}, {_clip_pass("p1", "(FROM g WHERE n >= 4)", "3.0", "3.0", None)}, {_line_pass("p2", "p1")}, {_line_pass("p3", "p2")}
{_SURVIVORS} FROM (FROM p3 UNION ALL SELECT px, n, a FROM g WHERE n < 4)""")
def stack_linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(stack.rejected_stack(views.user_stack(spark, sf_dir), "linear_fit"), "value")


_WINSORIZED_D = "CASE WHEN len(s) <= 1 THEN 0.0 ELSE 1.134 * sqrt(list_sum(list_transform(s, lambda x: (x - c) * (x - c))) / (len(s) - 1)) END"


@query(f"""
WITH RECURSIVE {views.USER_STACK}, {_GATHERED}, w AS (
  SELECT px, n, 0 AS i, s, c, d, d < 1.1920929e-7 AS done FROM (SELECT *, {_WINSORIZED_D} AS d FROM (SELECT px, n, a AS s, a[n // 2 + 1] AS c FROM g))
  UNION ALL
  SELECT px, n, i + 1, s, c, e, abs(e - d) <= d * 0.0005 OR e < 1.1920929e-7 FROM (
    SELECT *, {_WINSORIZED_D} AS e FROM (SELECT px, n, i, d, s, s[n // 2 + 1] AS c FROM (
      SELECT px, n, i, d, list_transform(s, lambda x: least(greatest(x, c - 1.5 * d), c + 1.5 * d)) AS s FROM w WHERE NOT done AND i < 50)))), e AS (
  SELECT px, arg_max(c, i) AS c, arg_max(d, i) AS d FROM w GROUP BY px), p AS (
  SELECT px, n, CASE WHEN n < 3 OR d < 1.1920929e-7 THEN a ELSE list_filter(a, lambda x: x >= c - 2.5 * d AND x <= c + 2.5 * d) END AS a FROM g JOIN e USING (px))
{_SURVIVORS} FROM p""")
def stack_winsorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(stack.rejected_stack(views.user_stack(spark, sf_dir), "winsorized"), "value")


_CRITICAL = ", ".join(f"({m}, {stack.esd_critical(m)!r}::DOUBLE)" for m in range(3, 32))  # a month has at most 31 frames


@query(f"""
WITH RECURSIVE {views.USER_STACK}, {_GATHERED}, critical(m, bound) AS (VALUES {_CRITICAL}), e AS (
  SELECT px, n, a AS s, 0 AS i, least(n // 4, CASE WHEN n < 25 THEN 2 ELSE 10 END, n - 3) AS most, false AS over FROM g WHERE n >= 4
  UNION ALL
  SELECT px, n, s[:far - 1] || s[far + 1:], i + 1, most, s[far] - centre > bound * d OR centre - s[far] > bound * d FROM (
    SELECT *, list_position(list_transform(s, lambda x: abs(x - centre)), list_max(list_transform(s, lambda x: abs(x - centre)))) AS far FROM (
      SELECT *, sqrt(list_sum(list_transform(s, lambda x: (x - centre) * (x - centre))) / (len(s) - 1)) AS d FROM (
        SELECT *, list_sum(s) / len(s) AS centre FROM e WHERE i < most))) JOIN critical ON m = len(s) WHERE d > 0), k AS (
  SELECT px, arg_max(s, i) AS s FROM e WHERE over GROUP BY px), p AS (SELECT px, n, coalesce(s, a) AS a FROM g LEFT JOIN k USING (px))
{_SURVIVORS} FROM p""")
def stack_esd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(stack.esd_stack(views.user_stack(spark, sf_dir)), "value")


@query(f"""
WITH {views.USER_STACK}
SELECT px, count(*) AS n_samples, round(sum(v * w) / sum(w), 6) AS value, sum(w) AS weight, round(sum(w * w) / (sum(w) * sum(w)), 6) AS linear_variance
FROM user_stack GROUP BY px""")
def stack_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(stack.mean_stack(views.user_stack(spark, sf_dir)), "value", "linear_variance")


@query(f"WITH {views.PART_STACK} SELECT px, count(*) AS n_samples, round(median(v), 12) AS value FROM part_stack GROUP BY px")
def stack_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(stack.median_stack(views.part_stack(spark, sf_dir)), "value", places=12)


_LEVELS = """levels AS (
  SELECT frame, median(v) AS m FROM part_stack GROUP BY frame), spreads AS (
  SELECT frame, m, median(abs(v - m)) AS d FROM part_stack JOIN levels USING (frame) GROUP BY frame, m), ref AS (
  SELECT d AS rd, m AS rm FROM spreads ORDER BY d, frame LIMIT 1), gains AS (
  SELECT frame, rd / d AS gain, rm - m * (rd / d) AS offset_, 1 / pow(rd / d * d * 1.4826022, 2) AS raw FROM spreads, ref), normed AS (
  SELECT frame, gain, offset_, raw / (SELECT sum(raw) FROM gains) AS w FROM gains)"""


@query(f"WITH {views.PART_STACK}, {_LEVELS} SELECT frame, round(gain, 6) AS gain, round(offset_, 6) AS offset_, round(w, 6) AS w FROM normed")
def frame_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stack.gains(stack.frame_levels(views.part_stack(spark, sf_dir))).withColumnRenamed("offset", "offset_")
    return stack.rounded(found, "gain", "offset_", "w")


@query(f"""
WITH {views.PART_STACK}, {_LEVELS}, applied AS (
  SELECT px, v * gain + offset_ AS v, w FROM part_stack JOIN normed USING (frame)), g AS (
  SELECT px, list_sort(list(v)) AS a, count(*) AS n FROM applied GROUP BY px),
{_clip_pass("p1", "g", "2.5", "2.5", 2.5)}, {_clip_pass("p2", "p1", "2.5", "2.5", 2.5)}, {_clip_pass("p3", "p2", "2.5", "2.5", 2.5)}
SELECT p.px, p.n AS n_samples, count(*) AS n_survivors, round(sum(v * w) / sum(w), 6) AS value
FROM p3 p JOIN applied s ON s.px = p.px AND s.v >= p.a[1] AND s.v <= p.a[-1] GROUP BY p.px, p.n""")
def stack_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(stack.normalised_stack(views.part_stack(spark, sf_dir)), "value")


@query(f"""
WITH {views.RASTER}, levels AS (SELECT frame, median(v) AS m FROM raster GROUP BY frame), spreads AS (
  SELECT frame, m, median(abs(v - m)) * 1.4826022 AS d FROM raster JOIN levels USING (frame) GROUP BY frame, m), cut AS (
  SELECT frame, m, least(greatest(m - 1.5 * d, 0), 1) AS black FROM spreads), scaled AS (
  SELECT frame, black, least(greatest((m - black) / (1 - black), 0), 1) AS r FROM cut), mids AS (
  SELECT frame, black, least(greatest(CASE WHEN r <= 0 THEN 0 WHEN r >= 1 THEN 1 ELSE (0.2::DOUBLE - 1) * r / ((2 * 0.2::DOUBLE - 1) * r - 0.2::DOUBLE) END, 1e-4), 1 - 1e-4) AS mid FROM scaled), lit AS (
  SELECT raster.frame, y, x, (v - black) / (1 - black) AS v, mid FROM raster JOIN mids USING (frame))
SELECT frame, y, x, round(CASE WHEN v <= 0 THEN 0 WHEN v >= 1 THEN 1 ELSE (mid - 1) * v / ((2 * mid - 1) * v - mid) END, 6) AS v FROM lit""")
def auto_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(raster.auto_stretch(views.raster(spark, sf_dir)), "v")


@query(f"""
WITH {views.RASTER}, rgb AS (
  SELECT y, x, max(v) FILTER (frame = 1) AS r, max(v) FILTER (frame = 2) AS g, max(v) FILTER (frame = 3) AS b FROM raster WHERE frame <= 3 GROUP BY y, x)
SELECT y, x, round(least(greatest(asinh(r / 0.1) / asinh(10.0), 0), 1), 12) AS stretched, round(least(g, (r + b) / 2), 12) AS neutral,
       round(g * 0.5 * (1 - least(r + b, 1)) + least(r + b, 1) * g, 12) AS masked, round((r + g + b) / 3, 12) AS intensity
FROM rgb WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL""")
def colour_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers 1 to 3 are the channels of one image."""
    channels = views.raster(spark, sf_dir).groupBy("y", "x").pivot("frame", [1, 2, 3]).agg(F.max("v")).dropna()
    r, g, b = (F.col(f"`{c}`") for c in (1, 2, 3))
    found = channels.select("y", "x", raster.asinh_stretch(r, 0.1).alias("stretched"), raster.neutral_green(r, g, b).alias("neutral"), raster.masked_green(r, g, b).alias("masked"), ((r + g + b) / 3).alias("intensity"))
    return stack.rounded(found, "stretched", "neutral", "masked", "intensity", places=12)


@query(f"""
WITH {views.RASTER}, flat AS (SELECT y, x, greatest(v / (SELECT avg(v) FROM raster WHERE frame = 7), 0.1) AS f FROM raster WHERE frame = 7)
SELECT l.frame, l.y, l.x, round((l.v - coalesce(d.v, 0)) / coalesce(f, 1), 6) AS v
FROM raster l LEFT JOIN (FROM raster WHERE frame = 6) d ON l.y = d.y AND l.x = d.x LEFT JOIN flat ON l.y = flat.y AND l.x = flat.x
WHERE l.frame <= 5""")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line number 6 is the dark frame, 7 the flat, the others are lights."""
    frames = views.raster(spark, sf_dir)
    found = raster.calibrate(frames.filter("frame <= 5"), frames.filter("frame = 6"), frames.filter("frame = 7"))
    return stack.rounded(found, "v")


@query(f"""
WITH {views.RASTER} SELECT c.frame, c.y, c.x, round(median(n.v), 12) AS v
FROM raster c JOIN raster n ON n.frame = c.frame AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL""")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(raster.median_3x3(views.raster(spark, sf_dir)), "v", places=12)


_KERNEL = [(dy, dx, (2 - abs(dy)) * (2 - abs(dx)) / 16) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


@query(f"""
WITH {views.RASTER}, k AS (SELECT c.frame, c.y, c.x, n.v, (2 - abs(c.y - n.y)) * (2 - abs(c.x - n.x)) / 16 AS w
FROM raster c JOIN raster n ON n.frame = c.frame AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1)
SELECT frame, y, x, round(sum(v * w) / sum(w) + 1e-9, 6) AS v FROM k GROUP BY ALL""")
def smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.convolve(views.raster(spark, sf_dir), _KERNEL)
    return stack.rounded(found.withColumn("v", F.col("v") + 1e-9), "v")  # off the ties of rounding


_TAPS = "taps(d, k) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))"


def _smooth(to: str, of: str, step: int) -> str:
    """B3 smoothing with holes in DuckDB, mirrored at the borders, along x and then y."""

    def along(name: str, source: str, axis: str, other: str) -> str:
        return f"""{name} AS (
  SELECT a.frame, a.y, a.x, sum(b.v * k / 16) AS v FROM (
    SELECT frame, y, x, k, CASE WHEN q >= s THEN 2 * s - 2 - q ELSE q END AS p FROM (
      SELECT frame, y, x, k, s, (({axis} + {step} * d) % (2 * s - 2) + 2 * s - 2) % (2 * s - 2) AS q FROM {source}, taps, side)) a
  JOIN {source} b ON b.frame = a.frame AND b.{other} = a.{other} AND b.{axis} = a.p GROUP BY ALL)"""

    return along(f"{to}x", of, "x", "y") + ", " + along(to, f"{to}x", "y", "x")


@query(f"""
WITH {views.RASTER}, {_TAPS}, {_smooth("down", "raster", 2)}
SELECT frame, y, x, round(d.v, 6) AS smooth, round(r.v - d.v, 6) AS detail FROM raster r JOIN down d USING (frame, y, x)""")
def wavelet_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.side(spark, sf_dir)
    return stack.rounded(raster.wavelet_plane(views.raster(spark, sf_dir), 2, n, n), "smooth", "detail")


@query(f"""
WITH {views.RASTER}, counts AS (
  SELECT frame, y // 8 AS ty, x // 8 AS tx, least(greatest(floor(v * 256), 0), 255)::INT AS bin, count(*) AS n FROM raster GROUP BY ALL)
SELECT frame, ty, tx, bin, n, round(sum(n) OVER (PARTITION BY frame, ty, tx ORDER BY bin) / sum(n) OVER (PARTITION BY frame, ty, tx), 6) AS share FROM counts""")
def tile_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(raster.tile_histogram(views.raster(spark, sf_dir), 8), "share")


def _tile_pass(k: int) -> str:
    """A clipping pass in DuckDB over the sorted samples ``s`` of a tile."""
    return f"""t{k} AS (
  SELECT frame, ty, tx, CASE WHEN stay OR flat OR len(kept) = len(s) THEN s ELSE kept END AS s, CASE WHEN stay THEN done ELSE flat OR len(kept) = len(s) END AS done,
         CASE WHEN stay THEN c ELSE centre END AS c, CASE WHEN stay THEN d WHEN flat THEN 0 ELSE e END AS d FROM (
    SELECT *, e * 1.4826022 <= abs(centre) * 1.1920929e-7 AS flat, list_filter(s, lambda x: abs(x - centre) <= 3.0 * 1.4826022 * e) AS kept FROM (
      SELECT *, list_sort(list_transform(s, lambda x: abs(x - centre)))[len(s) // 2 + 1] AS e FROM (
        SELECT *, done OR len(s) < 3 AS stay, s[len(s) // 2 + 1] AS centre FROM t{k - 1}))))"""


_TILES = f"""t0 AS (SELECT frame, y // 8 AS ty, x // 8 AS tx, list_sort(list(v)) AS s, false AS done, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM raster GROUP BY ALL),
{_tile_pass(1)}, {_tile_pass(2)}, {_tile_pass(3)}, m AS (
  SELECT *, CASE WHEN done THEN c ELSE list_aggregate(s, 'median') END AS m, list_sum(s) / len(s) AS mean FROM t3), z AS (
  SELECT *, 1.4826022 * CASE WHEN done THEN d ELSE list_aggregate(list_transform(s, lambda x: abs(x - m)), 'median') END AS sigma FROM m), tiles AS (
  SELECT frame, ty, tx, sigma, CASE WHEN abs(mean - m) < 0.3 * sigma THEN 2.5 * m - 1.5 * mean ELSE m END AS sky FROM z)"""


@query(f"WITH {views.RASTER}, {_TILES} SELECT frame, ty, tx, round(sky, 6) AS sky, round(sigma, 6) AS sigma FROM tiles")
def tile_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(raster.tile_background(views.raster(spark, sf_dir), 8), "sky", "sigma")


@query(f"""
WITH {views.RASTER}, {_TILES} SELECT r.frame, y, x, round(v, 6) AS v FROM raster r JOIN tiles t ON t.frame = r.frame AND ty = y // 8 AND tx = x // 8
WHERE v > sky + 1.5 * greatest(sigma, 1e-6)""")
def bright_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = views.raster(spark, sf_dir)
    return stack.rounded(raster.above_background(pixels, raster.tile_background(pixels, 8), 8, 1.5), "v")


def _level_pass(k: int) -> str:
    return f"""m{k} AS (SELECT frame, low, high, median(v) AS m FROM raster JOIN b{k - 1} USING (frame) WHERE v BETWEEN low AND high GROUP BY ALL), b{k} AS (
  SELECT frame, m, greatest(low, m - d) AS low, least(high, m + d) AS high FROM (
    SELECT frame, m, low, high, median(abs(v - m)) * 1.4826022 * 2.5 AS d FROM raster JOIN m{k} USING (frame) WHERE v BETWEEN low AND high GROUP BY ALL))"""


@query(f"""
WITH {views.RASTER}, b0 AS (SELECT DISTINCT frame, -1e300 AS low, 1e300 AS high FROM raster), {", ".join(map(_level_pass, range(1, 6)))}
SELECT frame, y, x, round(v + (SELECT min(m) FROM b5) - m + 1e-9, 6) AS v FROM raster JOIN b5 USING (frame)""")
def neutral_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.neutralised(views.raster(spark, sf_dir))
    return stack.rounded(found.withColumn("v", F.col("v") + 1e-9), "v")  # off the ties of rounding


@query(f"""
WITH {views.RASTER}, o AS (SELECT frame, y, x, x + 3 - 0.25::DOUBLE AS sx, y - 2 + 0.5::DOUBLE AS sy FROM raster), i AS (
  SELECT frame, y, x, least(greatest(sx, 0), s - 1) AS cx, least(greatest(sy, 0), s - 1) AS cy FROM o, side WHERE sx BETWEEN -0.5 AND s - 0.5 AND sy BETWEEN -0.5 AND s - 0.5), k AS (
  SELECT i.frame, i.y, i.x, sum(s.v * (1 - abs(cx - s.x)) * (1 - abs(cy - s.y))) AS v
  FROM i JOIN raster s ON s.frame = i.frame AND abs(cx - s.x) < 1 AND abs(cy - s.y) < 1 GROUP BY ALL)
SELECT r.frame, r.y, r.x, round(coalesce(k.v, 0), 6) AS v FROM raster r LEFT JOIN k USING (frame, y, x)""")
def warped(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.side(spark, sf_dir)
    moved = raster.warp_bilinear(views.raster(spark, sf_dir), [1.0, 0.0, 2.75, 0.0, 1.0, -1.5], n, n)
    return stack.rounded(moved, "v")


@query(f"""
WITH {views.RASTER}, p AS (SELECT v, (x + 0.25::DOUBLE + 0.5) * 2 - 0.5 AS cx, (y - 0.5::DOUBLE + 0.5) * 2 - 0.5 AS cy FROM raster), c AS (
  SELECT v, cx, cy, oy, unnest(range(floor(cx - 0.3)::INT, floor(cx + 1.3)::INT + 1)) AS ox
  FROM (SELECT v, cx, cy, unnest(range(floor(cy - 0.3)::INT, floor(cy + 1.3)::INT + 1)) AS oy FROM p)), w AS (
  SELECT oy, ox, v, greatest(least(cx + 0.8, ox + 0.5) - greatest(cx - 0.8, ox - 0.5), 0) * greatest(least(cy + 0.8, oy + 0.5) - greatest(cy - 0.8, oy - 0.5), 0) / 2.56 AS w FROM c)
SELECT oy::INT AS oy, ox::INT AS ox, round(sum(v * w) / sum(w), 6) AS v, round(sum(w), 6) AS weight FROM w WHERE w > 1e-9 GROUP BY oy, ox""")
def drizzled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(raster.drizzle(views.raster(spark, sf_dir), 0.25, -0.5).filter("weight > 1e-9"), "v", "weight")


@query(f"""
WITH {views.STARS} SELECT frame, CASE WHEN peak > 0.95 THEN 'saturated' WHEN snr < 10 THEN 'low_snr' WHEN sharpness > 0.7 THEN 'sharp' WHEN fwhm > 4.8 THEN 'wide' ELSE 'kept' END AS reason, count(*) AS n
FROM stars GROUP BY ALL""")
def star_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.star_cascade(views.stars(spark, sf_dir))


@query(f"""
WITH {views.STARS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY flux DESC, star) AS rank, count(*) OVER (PARTITION BY frame) AS many FROM stars), h AS (
  SELECT * FROM r WHERE rank <= greatest(many // 2, 5)), m AS (SELECT frame, median(fwhm) AS m FROM h GROUP BY frame), d AS (
  SELECT frame, m, median(abs(fwhm - m)) AS d FROM h JOIN m USING (frame) GROUP BY frame, m)
SELECT frame, star, fwhm FROM r JOIN d USING (frame) WHERE many < 5 OR fwhm <= m + 3.0 * greatest(d, m * 0.1)""")
def width_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.width_outliers(views.stars(spark, sf_dir))


@query(f"WITH {views.STARS} SELECT frame, count(*) AS n FROM stars GROUP BY frame ORDER BY n DESC, frame DESC LIMIT 1")
def reference_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reference(views.stars(spark, sf_dir))


@query(f"""
WITH {views.STARS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY flux DESC, star) AS r FROM stars) WHERE r <= 50), p AS (
  SELECT a.frame, a.star, b.star AS other, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM f a JOIN f b ON a.frame = b.frame AND a.star <> b.star), k AS (
  SELECT *, row_number() OVER (PARTITION BY frame, star ORDER BY d2, other) AS rank FROM p)
SELECT frame, star, other, rank::INT AS rank, round(sqrt(d2), 6) AS distance FROM k WHERE rank <= 5""")
def nearest_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(catalog.nearest(views.stars(spark, sf_dir)), "distance")


_NEAR = "p AS (SELECT a.frame, a.star AS a, b.star AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance, a.flux AS fa, b.flux AS fb FROM stars a JOIN stars b ON a.frame = b.frame AND a.star <> b.star)"


@query(f"WITH {views.STARS}, {_NEAR} SELECT frame, a, b, round(distance, 6) AS distance FROM p WHERE distance <= 25 AND a < b")
def stars_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.stars(spark, sf_dir)
    return stack.rounded(catalog.within(found, found, 25.0).filter("a < b"), "distance")


@query(f"""
WITH RECURSIVE {views.STARS}, {_NEAR}, o AS (
  SELECT frame, list({{'d': distance, 'a': a, 'b': b}} ORDER BY distance, a, b) AS l FROM p WHERE distance <= 25 AND a % 2 = 0 AND b % 2 = 1 GROUP BY frame), r AS (
  SELECT frame, l, 1 AS k, l[1:0] AS taken FROM o UNION ALL
  SELECT frame, l, k + 1, CASE WHEN len(list_filter(taken, lambda z: z.a = l[k].a OR z.b = l[k].b)) = 0 THEN list_append(taken, l[k]) ELSE taken END FROM r WHERE k <= len(l))
SELECT frame, z.a AS a, z.b AS b, round(z.d, 6) AS distance FROM (SELECT frame, unnest(taken) AS z FROM r WHERE k = len(l) + 1)""")
def matched_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even stars matched with odd ones of their frame."""
    found = views.stars(spark, sf_dir)
    pairs = catalog.within(found, found, 25.0).filter("a % 2 = 0 AND b % 2 = 1")
    return stack.rounded(catalog.greedy_match(pairs), "distance")


@query(f"""
WITH RECURSIVE {views.STARS}, o AS (SELECT frame, list({{'x': x, 'y': y, 'star': star, 'flux': flux}} ORDER BY flux DESC, star) AS l FROM stars GROUP BY frame), r AS (
  SELECT frame, l, 1 AS k, l[1:0] AS kept FROM o UNION ALL
  SELECT frame, l, k + 1, CASE WHEN len(list_filter(kept, lambda z: sqrt((z.x - l[k].x) ** 2 + (z.y - l[k].y) ** 2) < 25)) = 0 THEN list_append(kept, l[k]) ELSE kept END
  FROM r WHERE k <= len(l))
SELECT frame, z.star AS star, z.flux AS flux FROM (SELECT frame, unnest(kept) AS z FROM r WHERE k = len(l) + 1)""")
def distinct_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.without_duplicates(views.stars(spark, sf_dir), 25.0).select("frame", "star", "flux")


@query(f"""
WITH {views.STARS}, m AS (
  SELECT frame, x AS rx, y AS ry, 1.02 * (cos(0.1) * x - sin(0.1) * y) + 3 + (snr - 50) / 100 AS tx, 1.02 * (sin(0.1) * x + cos(0.1) * y) - 2 + (sharpness - 0.4) AS ty FROM stars), c AS (
  SELECT frame, count(*) AS n, avg(rx) AS ax, avg(ry) AS ay, avg(tx) AS bx, avg(ty) AS by_ FROM m GROUP BY frame), s AS (
  SELECT frame, n, ax, ay, bx, by_, sum((rx - ax) * (tx - bx)) + sum((ry - ay) * (ty - by_)) AS c, sum((rx - ax) * (ty - by_)) - sum((ry - ay) * (tx - bx)) AS s,
         sum((rx - ax) ** 2) + sum((ry - ay) ** 2) AS var FROM m JOIN c USING (frame) GROUP BY ALL), a AS (
  SELECT *, atan2(s, c) AS angle, (c * cos(atan2(s, c)) + s * sin(atan2(s, c))) / var AS scale FROM s)
SELECT frame, n, round(angle, 6) AS angle, round(scale, 6) AS scale, round(bx - scale * (cos(angle) * ax - sin(angle) * ay), 4) AS dx,
       round(by_ - scale * (sin(angle) * ax + cos(angle) * ay), 4) AS dy FROM a""")
def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's stars against their own turned, scaled, shifted and disturbed places."""
    x, y, cos, sin = F.col("x"), F.col("y"), F.cos(F.lit(0.1)), F.sin(F.lit(0.1))
    matches = views.stars(spark, sf_dir).select(
        "frame", x.alias("rx"), y.alias("ry"),
        (1.02 * (cos * x - sin * y) + 3 + (F.col("snr") - 50) / 100).alias("tx"),
        (1.02 * (sin * x + cos * y) - 2 + (F.col("sharpness") - 0.4)).alias("ty"),
    )
    found = stack.rounded(catalog.similarity(matches), "angle", "scale")
    return stack.rounded(found, "dx", "dy", places=4)


@query("""
SELECT user_id, event_id, row_number() OVER w AS frame_no, round(coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 6) AS delta
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def frame_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(events.frame_ticks(views.table(spark, sf_dir, "events")), "delta")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (
  SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, burst""")
def debounced_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.debounced(views.table(spark, sf_dir, "events"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.select("user_id", micros("first_ts").alias("first_us"), micros("last_ts").alias("last_us"), "n")


@query(f"""
WITH RECURSIVE {views.RASTER}, mask AS (SELECT frame, y, x, v FROM raster WHERE v > 0.58), reach AS (
  SELECT frame, y, x, y * 100000 + x AS seed FROM mask UNION
  SELECT m.frame, m.y, m.x, r.seed FROM reach r JOIN mask m ON m.frame = r.frame AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1), region AS (
  SELECT frame, y, x, min(seed) AS seed FROM reach GROUP BY frame, y, x), p AS (
  SELECT r.*, v, row_number() OVER (PARTITION BY r.frame, seed ORDER BY v DESC, r.y, r.x) AS k FROM region r JOIN mask USING (frame, y, x))
SELECT frame, (seed // 100000)::INT AS y0, (seed % 100000)::INT AS x0, count(*) AS area, min(x) AS x_from, max(x) + 1 AS x_to, min(y) AS y_from, max(y) + 1 AS y_to,
       round(max(v), 6) AS peak, max(y) FILTER (k = 1) AS peak_y, max(x) FILTER (k = 1) AS peak_x
FROM p GROUP BY frame, seed""")
def bright_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = views.raster(spark, sf_dir)
    found = regions.region_stats(pixels, regions.label_regions(pixels.filter("v > 0.58")))
    return stack.rounded(found, "peak")


@query(f"""
WITH {views.RASTER}, {_TAPS}, {_smooth("s1", "raster", 1)}, {_smooth("s2", "s1", 2)}, details AS (
  SELECT 1 AS j, frame, y, x, r.v - s.v AS w FROM raster r JOIN s1 s USING (frame, y, x) UNION ALL
  SELECT 2, frame, y, x, r.v - s.v FROM s1 r JOIN s2 s USING (frame, y, x)), centres AS (SELECT j, frame, median(w) AS m FROM details GROUP BY ALL), levels AS (
  SELECT j, frame, median(abs(w - m)) * 1.4826022 * 2.5 AS t FROM details JOIN centres USING (j, frame) GROUP BY ALL), lost AS (
  SELECT frame, y, x, sum(w - sign(w) * greatest(abs(w) - t, 0)) AS d FROM details JOIN levels USING (j, frame) GROUP BY ALL)
SELECT frame, y, x, round(v - 0.85 * d, 6) AS v FROM raster JOIN lost USING (frame, y, x)""")
def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.side(spark, sf_dir)
    return stack.rounded(regions.denoise(views.raster(spark, sf_dir), n, n), "v")


@query(f"""
WITH {views.RASTER}, {_TAPS}, {_smooth("s1", "raster", 1)}, {_smooth("s2", "s1", 2)}, {_smooth("s3", "s2", 4)}, means AS (SELECT frame, avg(v) AS m FROM s3 GROUP BY frame)
SELECT frame, y, x, round(r.v - 0.5 * (s.v - m), 6) AS v FROM raster r JOIN s3 s USING (frame, y, x) JOIN means USING (frame)""")
def range_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.side(spark, sf_dir)
    return stack.rounded(regions.compress_range(views.raster(spark, sf_dir), n, n, scales=3), "v")


@query(f"""
WITH {views.RASTER}
SELECT frame, y, x, round(least(greatest((v * 65535 - 512) / 65023, 0), 1), 6) AS normalised,
       CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 'R' WHEN y % 2 = 1 AND x % 2 = 1 THEN 'B' ELSE 'G' END AS colour,
       round(least(greatest(CASE WHEN v < 0.5 THEN -ln(1 + 4 * (0.5 - v)) ELSE ln(1 + 4 * (v - 0.5)) END / (2 * ln(3.0::DOUBLE)) + 0.5, 0), 1), 6) AS stretched,
       round(v / sqrt(greatest(9 * 0.02::DOUBLE * 0.02::DOUBLE, 1.1920929e-7)) + 1e-9, 6) AS snr
FROM raster""")
def sample_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    found = views.raster(spark, sf_dir).select(
        "frame", "y", "x", imaging.normalised(v * 65535, 512.0, 65535.0).alias("normalised"),
        imaging.mosaic_colour(F.col("y"), F.col("x"), [["R", "G"], ["G", "B"]]).alias("colour"),
        imaging.hyperbolic_stretch(v, 4.0, -1.0, 0.5).alias("stretched"),
        (imaging.signal_to_noise(v, F.lit(0.02), F.lit(9)) + 1e-9).alias("snr"),  # off the ties of rounding
    )
    return stack.rounded(found, "normalised", "stretched", "snr")


@query(f"""
WITH {views.STARS}, {_NEAR}, m AS (SELECT frame, distance FROM p WHERE distance <= 40 AND a < b)
SELECT frame, count(*) AS n, round(sqrt(sum(distance * distance) / count(*)), 6) AS rms, round(max(distance), 6) AS largest,
       round(CASE WHEN count(*) < 4 THEN 0 ELSE exp(-sqrt(sum(distance * distance) / count(*)) / 2) * least(count(*) / 20, 1) END, 9) AS quality
FROM m GROUP BY frame""")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring stars judged as if they were matches."""
    found = views.stars(spark, sf_dir)
    pairs = catalog.within(found, found, 40.0).filter("a < b").groupBy("frame")
    sums = pairs.agg(F.count("*").alias("n"), F.sum(F.col("distance") ** 2).alias("ss"), F.max("distance").alias("largest"))
    judged = sums.select("frame", "n", F.sqrt(F.col("ss") / F.col("n")).alias("rms"), "largest", imaging.registration_quality(F.col("n"), F.col("ss")).alias("quality"))
    return stack.rounded(stack.rounded(judged, "rms", "largest"), "quality", places=9)


def _hyperbolic(area: str, slope: str, low: float, high: float, centre: float) -> str:
    """The stretch in DuckDB from the area and slope at a distance ``a``."""
    def under(v: str) -> str:
        inner = f"least(greatest({v}, {low}), {high})"
        a = f"abs({inner} - {centre})"
        return f"(CASE WHEN {inner} < {centre} THEN -1 ELSE 1 END * {area.replace('@', a)} + ({v} - {inner}) * {slope.replace('@', a)})"

    return f"round(least(greatest(({under('v')} - {under('0.0::DOUBLE')}) / ({under('1.0::DOUBLE')} - {under('0.0::DOUBLE')}), 0), 1), 6)"


@query(f"""
WITH {views.RASTER}
SELECT frame, y, x, {_hyperbolic("(1 - pow(1 + 6 * @, -0.5)) / 3", "pow(1 + 6 * @, -1.5)", 0.1, 0.9, 0.4)} AS hyperbolic,
       {_hyperbolic("(1 - exp(-5.0 * @)) / 5", "exp(-5.0 * @)", 0.2, 0.8, 0.5)} AS exponential,
       {_hyperbolic("(pow(1 + 0.5 * 4 * @, -1.0) - 1) / (-1.0 * 2)", "pow(1 + 0.5 * 4 * @, -2.0)", 0.0, 0.7, 0.3)} AS half,
       {_hyperbolic("(pow(1 + 2 * 3 * @, 0.5) - 1) / 3", "pow(1 + 2 * 3 * @, -0.5)", 0.1, 1.0, 0.6)} AS steep
FROM raster""")
def hyperbolic_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretch for all kinds of shape: above zero, zero, between -1 and 0, below -1."""
    v = F.col("v")
    found = views.raster(spark, sf_dir).select(
        "frame", "y", "x",
        imaging.hyperbolic_stretch(v, 3.0, 2.0, 0.4, 0.1, 0.9).alias("hyperbolic"),
        imaging.hyperbolic_stretch(v, 5.0, 0.0, 0.5, 0.2, 0.8).alias("exponential"),
        imaging.hyperbolic_stretch(v, 4.0, -0.5, 0.3, 0.0, 0.7).alias("half"),
        imaging.hyperbolic_stretch(v, 3.0, -2.0, 0.6, 0.1, 1.0).alias("steep"),
    )
    return stack.rounded(found, "hyperbolic", "exponential", "half", "steep")


@query(f"""
WITH {views.PART_STACK}, whole AS (SELECT px FROM part_stack GROUP BY px HAVING count(*) = (SELECT count(DISTINCT frame) FROM part_stack)), shared AS (
  SELECT * FROM part_stack SEMI JOIN whole USING (px)), levels AS (SELECT frame, median(v) AS m FROM shared GROUP BY frame), spreads AS (
  SELECT frame, m, median(abs(v - m)) AS d FROM shared JOIN levels USING (frame) GROUP BY frame, m), ref AS (SELECT m AS rm FROM spreads ORDER BY d, frame LIMIT 1), g AS (
  SELECT px, list_sort(list(v * CASE WHEN m <= 1.1920929e-7 THEN 1 ELSE rm / m END)) AS a, count(*) AS n FROM part_stack JOIN spreads USING (frame), ref GROUP BY px),
{_clip_pass("p1", "g", "2.5", "2.5", 2.5)}, {_clip_pass("p2", "p1", "2.5", "2.5", 2.5)}, {_clip_pass("p3", "p2", "2.5", "2.5", 2.5)}
SELECT px, n AS n_samples, round(list_sum(a) / len(a), 6) AS value FROM p3""")
def stack_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames brought to the reference's median, which is measured where all frames cover, then sigma-clipped."""
    samples = views.part_stack(spark, sf_dir)
    gains = stack.multiplicative_gains(stack.frame_levels(stack.common_domain(samples)))
    level = samples.join(F.broadcast(gains), "frame").select("px", "frame", (F.col("v") * F.col("gain")).alias("v"))  # a row a frame
    return stack.rounded(stack.stacked(level, "sigma"), "value")


@query(f"""
WITH {views.PART_STACK}, c AS (SELECT *, (px * 7 + frame * 13) % 50 / 1000.0 AS coverage FROM part_stack WHERE frame <= 4), k AS (
  SELECT px, count(*) AS n, median(v) AS value FROM c WHERE coverage > 0.001 GROUP BY px)
SELECT p_partkey AS px, coalesce(n, 0)::BIGINT AS n_samples, round(coalesce(value, 0), 12) AS value FROM part LEFT JOIN k ON px = p_partkey""")
def stack_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four frames, too few for a rejection, with a coverage; parts without any covered sample are 0."""
    samples = views.part_stack(spark, sf_dir).filter("frame <= 4")
    samples = samples.withColumn("coverage", (F.col("px") * 7 + F.col("frame") * 13) % 50 / 1000.0)
    grid = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("px"))
    return stack.rounded(stack.on_grid(stack.stacked(stack.covered(samples), "sigma"), grid), "value", places=12)


@query(f"""
WITH RECURSIVE {views.RASTER}, m AS (SELECT frame, median(v) AS m FROM raster GROUP BY frame), h AS (
  SELECT frame, m, 0 AS i, -5.0::DOUBLE AS lo, 5.0::DOUBLE AS hi FROM m UNION ALL
  SELECT frame, m, i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT *, asinh(m / pow(10.0, mid)) / asinh(1 / pow(10.0, mid)) > 0.7 AS up FROM (SELECT *, (lo + hi) / 2 AS mid FROM h WHERE i < 50))), b AS (
  SELECT frame, pow(10.0, (lo + hi) / 2) AS beta FROM h WHERE i = 50)
SELECT frame, y, x, round(least(greatest(asinh(v / beta) / asinh(1 / beta), 0), 1), 6) AS v FROM raster JOIN b USING (frame)""")
def auto_asinh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(raster.auto_asinh(views.raster(spark, sf_dir), 0.7), "v")


@query(f"""
WITH {views.RASTER}, rgb AS (
  SELECT y, x, max(v) FILTER (frame = 1) AS r, max(v) FILTER (frame = 2) AS g, max(v) FILTER (frame = 3) AS b FROM raster WHERE frame <= 3 GROUP BY y, x), i AS (
  SELECT *, (r + g + b) / 3 AS i FROM rgb WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL), k AS (
  SELECT *, least(greatest(asinh(i / 0.05) / asinh(20.0), 0), 1) / i AS gain FROM i), c AS (
  SELECT *, gain / greatest(gain * greatest(r, g, b), 1) AS capped FROM k)
SELECT y, x, round(r * capped, 6) AS r, round(g * capped, 6) AS g, round(b * capped, 6) AS b FROM c""")
def colour_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers 1 to 3 are the channels; the asinh curve acts on their mean."""
    channels = views.raster(spark, sf_dir).groupBy("y", "x").pivot("frame", [1, 2, 3]).agg(F.max("v")).dropna()
    bent = imaging.colour_preserving(*(F.col(f"`{c}`") for c in (1, 2, 3)), lambda v: raster.asinh_stretch(v, 0.05))
    return stack.rounded(channels.select("y", "x", *(c.alias(n) for c, n in zip(bent, "rgb", strict=True))), "r", "g", "b")


@query(f"""
WITH {views.STARS}, m AS (
  SELECT frame, x AS rx, y AS ry, cos(0.1) * x - sin(0.1) * y + 3 + (snr - 50) / 100 AS tx, sin(0.1) * x + cos(0.1) * y - 2 + (sharpness - 0.4) AS ty FROM stars), c AS (
  SELECT frame, count(*) AS n, avg(rx) AS ax, avg(ry) AS ay, avg(tx) AS bx, avg(ty) AS by_ FROM m GROUP BY frame), s AS (
  SELECT frame, n, ax, ay, bx, by_, atan2(sum((rx - ax) * (ty - by_)) - sum((ry - ay) * (tx - bx)), sum((rx - ax) * (tx - bx)) + sum((ry - ay) * (ty - by_))) AS angle
  FROM m JOIN c USING (frame) GROUP BY ALL)
SELECT frame, n, round(bx - ax, 4) AS shift_x, round(by_ - ay, 4) AS shift_y, round(angle, 6) AS angle,
       round(bx - (cos(angle) * ax - sin(angle) * ay), 4) AS dx, round(by_ - (sin(angle) * ax + cos(angle) * ay), 4) AS dy FROM s""")
def rigid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation, and turn and translation, of each frame's stars to turned, shifted and disturbed places."""
    x, y, cos, sin = F.col("x"), F.col("y"), F.cos(F.lit(0.1)), F.sin(F.lit(0.1))
    matches = views.stars(spark, sf_dir).select(
        "frame", x.alias("rx"), y.alias("ry"),
        (cos * x - sin * y + 3 + (F.col("snr") - 50) / 100).alias("tx"),
        (sin * x + cos * y - 2 + (F.col("sharpness") - 0.4)).alias("ty"),
    )
    found = stack.rounded(catalog.rigid(matches), "angle")
    return stack.rounded(found, "shift_x", "shift_y", "dx", "dy", places=4)


@query(f"""
WITH {views.RASTER}, {_TILES}, w AS (SELECT frame, median(sigma) AS sigma FROM tiles WHERE sigma > 0 GROUP BY frame), k AS (
  SELECT frame, 1 / (sigma * sigma) AS raw FROM w), n AS (SELECT frame, raw / (SELECT sum(raw) FROM k) AS w FROM k)
SELECT y, x, round(sum(v * w) / sum(w), 6) AS v FROM raster JOIN n USING (frame) GROUP BY y, x""")
def combined_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as channels, weighted by the inverse variance of their background."""
    pixels = views.raster(spark, sf_dir)
    return stack.rounded(raster.combine_channels(pixels, raster.tile_background(pixels, 8)), "v")


@query(f"""
WITH {views.RASTER}, {_TILES}, n AS (
  SELECT a.frame, a.ty, a.tx, median(b.sky) AS sky, median(b.sigma) AS sigma FROM tiles a JOIN tiles b
  ON a.frame = b.frame AND abs(a.ty - b.ty) <= 1 AND abs(a.tx - b.tx) <= 1 GROUP BY ALL)
SELECT t.frame, t.ty, t.tx, round(CASE WHEN s <= 16 THEN t.sky ELSE n.sky END, 6) AS sky, round(CASE WHEN s <= 16 THEN t.sigma ELSE n.sigma END, 6) AS sigma
FROM tiles t JOIN n USING (frame, ty, tx), side""")
def smooth_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(raster.smoothed_tiles(raster.tile_background(views.raster(spark, sf_dir), 8)), "sky", "sigma")


@query(f"""
WITH {views.RASTER}, {_TILES}
SELECT frame, round(greatest(1e-4 * coalesce(median(sigma) FILTER (sigma > 0), median(abs(sky))), 1e-12), 12) AS floor FROM tiles GROUP BY frame""")
def noise_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(raster.noise_floor(raster.tile_background(views.raster(spark, sf_dir), 8)), "floor", places=12)


@query(f"""
WITH {views.RASTER}, {_TILES}, lit AS (
  SELECT r.frame, y, x, v - sky AS v, sigma FROM raster r JOIN tiles t ON t.frame = r.frame AND ty = y // 8 AND tx = x // 8), f AS (
  SELECT a.frame, a.y, a.x, a.sigma, sum(b.v * (2 - abs(a.y - b.y)) * (2 - abs(a.x - b.x)) / 16) / (6.0::DOUBLE / 16) AS f FROM lit a JOIN lit b
  ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
SELECT frame, y, x, round(f, 6) AS v FROM f WHERE f > 1.5 * sigma""")
def matched_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = views.raster(spark, sf_dir)
    return stack.rounded(raster.matched_filter(pixels, raster.tile_background(pixels, 8), 8, _KERNEL, 1.5), "v")


@query(f"""
WITH {views.STARS}, k AS (SELECT *, NOT (peak > 0.95 OR snr < 10 OR sharpness > 0.7 OR fwhm > 4.8) AS kept FROM stars)
SELECT frame, count(*) AS n, count(*) FILTER (kept) AS n_kept, round(median(fwhm) FILTER (kept), 6) AS width, round(median(snr) FILTER (kept), 6) AS snr FROM k GROUP BY frame""")
def star_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(catalog.diagnostics(views.stars(spark, sf_dir)), "width", "snr")


@query(f"""
WITH {views.STARS}, g AS (SELECT frame, fwhm FROM stars WHERE NOT (peak > 0.95 OR snr < 10 OR sharpness > 0.7 OR fwhm > 4.8)), m AS (
  SELECT frame, median(fwhm) AS m FROM g GROUP BY frame), d AS (SELECT frame, m, median(abs(fwhm - m)) AS d FROM g JOIN m USING (frame) GROUP BY frame, m), n AS (
  SELECT frame, count(*) AS n, median(fwhm) AS w FROM g JOIN d USING (frame) WHERE abs(fwhm - m) <= 3.0 * greatest(d, m * 0.1) GROUP BY frame)
SELECT frame, coalesce(n, 0)::BIGINT AS n, round(coalesce(w, 4.0), 6) AS width FROM (SELECT DISTINCT frame FROM stars) LEFT JOIN n USING (frame)""")
def typical_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.rounded(catalog.typical_width(views.stars(spark, sf_dir)), "width")


_PROJECTIVE = [1.1, -0.2, 5.0, 0.3, 0.9, -4.0, 1e-4, 2e-4, 1.0]


@query(f"""
WITH {views.STARS}, w AS (SELECT frame, star, x, y, 1e-4 * x + 2e-4 * y + 1 AS w FROM stars)
SELECT frame, star, round((1.1 * x - 0.2 * y + 5) / w, 6) AS px, round((0.3 * x + 0.9 * y - 4) / w, 6) AS py, round(x, 6) AS bx, round(y, 6) AS by_ FROM w""")
def moved_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places under a projective transform, and brought back by its inverse after a composition with no effect."""
    there = catalog.transformed(views.stars(spark, sf_dir), _PROJECTIVE)
    same = catalog.composed(catalog.inverse(_PROJECTIVE), catalog.composed(_PROJECTIVE, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]))
    back = catalog.transformed(catalog.transformed(there, catalog.inverse(_PROJECTIVE)), same)
    both = there.select("frame", "star", F.col("x").alias("px"), F.col("y").alias("py"))
    found = both.join(back.select("frame", "star", F.col("x").alias("bx"), F.col("y").alias("by_")), ["frame", "star"])
    return stack.rounded(found, "px", "py", "bx", "by_")


@query(f"""
WITH RECURSIVE {views.RASTER}, mask AS (SELECT frame, y, x FROM raster WHERE v > 0.58), reach AS (
  SELECT frame, y, x, y * 100000 + x AS seed FROM mask UNION
  SELECT m.frame, m.y, m.x, r.seed FROM reach r JOIN mask m ON m.frame = r.frame AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1), p AS (
  SELECT frame, y, x, min(seed) AS seed FROM reach GROUP BY frame, y, x), g AS (
  SELECT frame, seed, count(*) AS area, min(x) AS x_from, max(x) + 1 AS x_to, min(y) AS y_from, max(y) + 1 AS y_to FROM p GROUP BY frame, seed)
SELECT frame, (seed // 100000)::INT AS y0, (seed % 100000)::INT AS x0, area FROM g, side
WHERE area BETWEEN 2 AND 20 AND x_from >= 2 AND x_to <= s - 2 AND y_from >= 2 AND y_to <= s - 2""")
def usable_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, pixels = views.side(spark, sf_dir), views.raster(spark, sf_dir)
    found = regions.region_stats(pixels, regions.label_regions(pixels.filter("v > 0.58")))
    return regions.usable_regions(found, n, n, 2, 20, 2).select("frame", "y0", "x0", "area")


@query(f"""
WITH {views.PART_STACK}, o AS (SELECT frame, CASE WHEN px % 11 = 0 THEN NULL WHEN px % 7 = 0 THEN 'nan'::DOUBLE WHEN px % 13 = 0 THEN 'inf'::DOUBLE ELSE v END AS v FROM part_stack)
SELECT frame, count(*) AS n, count(*) FILTER (v IS NULL) AS n_missing, count(*) FILTER (isnan(v) OR isinf(v)) AS n_not_finite FROM o GROUP BY frame""")
def sample_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part stack with some samples spoilt."""
    spoilt = F.when(F.col("px") % 11 == 0, None).when(F.col("px") % 7 == 0, float("nan")).when(F.col("px") % 13 == 0, float("inf")).otherwise(F.col("v"))
    return stack.sample_faults(views.part_stack(spark, sf_dir).withColumn("v", spoilt))


@query(f"""
WITH {views.RASTER}, rgb AS (
  SELECT y, x, max(v) FILTER (frame = 1) AS r, max(v) FILTER (frame = 2) AS g, max(v) FILTER (frame = 3) AS b FROM raster WHERE frame <= 3 GROUP BY y, x), i AS (
  SELECT *, (r + g + b) / 3 AS i FROM rgb WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL), c AS (
  SELECT *, sqrt(i) / i / greatest(sqrt(i) / i * greatest(r, g, b), 1) AS gain FROM i)
SELECT y, x, round(r * gain, 6) AS r, round(g * gain, 6) AS g, round(b * gain, 6) AS b FROM c""")
def intensity_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers 1 to 3 are the channels; their mean becomes its square root."""
    channels = views.raster(spark, sf_dir).groupBy("y", "x").pivot("frame", [1, 2, 3]).agg(F.max("v")).dropna()
    r, g, b = (F.col(f"`{c}`") for c in (1, 2, 3))
    bent = imaging.remapped(r, g, b, F.sqrt((r + g + b) / 3))
    return stack.rounded(channels.select("y", "x", *(c.alias(n) for c, n in zip(bent, "rgb", strict=True))), "r", "g", "b")
