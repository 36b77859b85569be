"""The library's operators on hand-made rows and against plain NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import imaging, robust, scalar
from framewright.operators import catalog, levels, raster, stack
from framewright.streaming import events


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("r")).first()["r"]


def arrays(spark, lists, column):
    rows = spark.createDataFrame([(i, sorted(map(float, a))) for i, a in enumerate(lists)], "i long, a array<double>")
    return [r["r"] for r in rows.select("i", column.alias("r")).orderBy("i").collect()]


def test_scalar_nodes(spark):
    a, b = F.col("a"), F.col("b")
    q, r = scalar.divide(a, b)
    assert one(spark, q, a=7.0, b=3.0) == 7 / 3 and one(spark, r, a=7.0, b=3.0) == 1
    assert one(spark, q, a=-1.0, b=0.0) == -math.inf and math.isnan(one(spark, r, a=1.0, b=0.0)) and math.isnan(one(spark, q, a=0.0, b=0.0))
    assert one(spark, scalar.logarithm(a, b), a=2.0, b=3.0) == pytest.approx(0.6309297535714574)
    assert one(spark, scalar.logarithm(a, b), a=0.0, b=10.0) == -math.inf and math.isnan(one(spark, scalar.logarithm(a, b), a=-1.0, b=10.0))
    for value, whole in ((3.9, 3), (-3.9, -3), (math.nan, 0), (1e300, 2**63 - 1), (-1e300, -(2**63))):
        assert one(spark, scalar.to_integer(a), a=value) == whole
    for value, text in ((1.0, "1"), (1.5, "1.5"), (1e20, "100000000000000000000"), (1e-7, "0.0000001"), (math.nan, "NaN"), (-math.inf, "-inf"), (42.0, "42")):
        assert one(spark, scalar.double_text(a), a=value) == text


def test_medians(spark):
    a = F.col("a")
    assert arrays(spark, [[1, 2, 3, 10]], robust.median_fast(a)) == [3]
    assert arrays(spark, [[1, 2, 3, 10], [5, 1, 2]], robust.median(a)) == [2.5, 2]
    assert arrays(spark, [[1, 2, 3, 10]], robust.mad_fast(a, F.lit(3.0))) == [2]


def clip_reference(a, low, high, passes):
    a = sorted(a)

    def clean(s):
        if len(s) < 10:
            return False
        t = np.array(s[1:-1])
        return t.var(ddof=1) < robust.EPSILON or max(abs(s[-1] - t.mean()), abs(s[0] - t.mean())) <= min(low, high) * t.std(ddof=1)

    for _ in range(passes):
        if len(a) <= 2 or clean(a):
            break
        c = a[len(a) // 2]
        d = robust.MAD_TO_SIGMA * sorted(abs(x - c) for x in a)[len(a) // 2]
        if d < robust.EPSILON:
            break
        a = [x for x in a if c - low * d <= x <= c + high * d]
    return a


def winsorized_reference(a, low, high):
    a = sorted(a)
    if len(a) < 3:
        return a
    s, before = list(a), None
    for i in range(51):
        c = s[len(s) // 2]
        d = 1.134 * math.sqrt(sum((x - c) ** 2 for x in s) / (len(s) - 1))
        if d < robust.EPSILON:
            return a
        if before is not None and abs(d - before) <= before * 0.0005:
            break
        before = d
        if i < 50:
            s = [min(max(x, c - 1.5 * d), c + 1.5 * d) for x in s]
    return [x for x in a if c - low * d <= x <= c + high * d]


@pytest.fixture(scope="module")
def samples():
    pick = random.Random(4)
    lists = [[pick.gauss(0, 1) for _ in range(n)] + [pick.uniform(5, 90) for _ in range(n // 6)] for n in range(1, 40)]
    return [*lists, [1.0] * 12, [1.0] * 11 + [9.0], [0.0, 1.0]]


def test_sigma_clip(spark, samples):
    for got, a in zip(arrays(spark, samples, robust.sigma_clip(F.col("a"))), samples, strict=True):
        assert got == clip_reference(a, 2.5, 2.5, 3)


def test_winsorized(spark, samples):
    for got, a in zip(arrays(spark, samples, robust.winsorized_clip(F.col("a"))), samples, strict=True):
        assert got == winsorized_reference(a, 2.5, 2.5)


def test_percentile_and_line(spark):
    a = F.col("a")
    assert arrays(spark, [range(10), [1, 2], range(3)], robust.percentile_clip(a)) == [list(range(1, 9)), [1, 2], [0, 1, 2]]
    assert arrays(spark, [range(4)], robust.percentile_clip(a, 50, 50)) == [[2]]
    line = [float(x) for x in range(20)]
    assert arrays(spark, [line, [*line, 60.0], [1, 2, 3]], robust.linear_fit_clip(a)) == [line, line, [1, 2, 3]]


def test_extreme_deviates():
    pick = np.random.default_rng(1)
    a = np.append(pick.normal(0, 1, 40), [30.0, -25.0])
    assert set(a) - set(stack.esd_survivors(a)) == {30.0, -25.0}
    assert stack.student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert stack.student_quantile(0.975, 7) == pytest.approx(2.364624, abs=1e-5)


def test_clipped_stats_end_two_ways(spark):
    settled, short = arrays(spark, [[1, 2, 3, 4], [1, 2]], robust.clipped_stats(F.col("a")))
    assert (settled["median"], short["median"]) == (3, 1.5)


def test_stack_outputs(spark):
    rows = [(1, 1, 1.0, 1.0), (1, 2, 3.0, 3.0), (2, 1, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "px long, frame int, v double, w double")
    got = {r["px"]: r for r in stack.mean_stack(df).collect()}
    assert got[1]["value"] == 2.5 and got[1]["linear_variance"] == 10 / 16 and got[2]["value"] == 0
    assert stack.mean_stack(df.filter("false")).count() == 0


def frame(spark, values):
    rows = [(0, y, x, float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "frame int, y int, x int, v double")


def grid(df, h, w, column="v"):
    out = np.zeros((h, w))
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


def test_stencils(spark):
    a = np.random.default_rng(3).random((6, 7))
    pad = np.pad(a, 1, constant_values=np.nan)
    expected = np.array([[np.nanmedian(pad[y : y + 3, x : x + 3]) for x in range(7)] for y in range(6)])
    assert np.allclose(grid(raster.median_3x3(frame(spark, a)), 6, 7), expected)
    plane = raster.wavelet_plane(frame(spark, np.ones((6, 7))), 2, 6, 7)
    assert np.allclose(grid(plane, 6, 7, "smooth"), 1) and np.allclose(grid(plane, 6, 7, "detail"), 0)


def test_warp_goes_to_the_source_and_drizzle_from_it(spark):
    """A shift by +3, -2 tells the two directions apart."""
    a = np.arange(80, dtype=float).reshape(8, 10)
    moved = grid(raster.warp_bilinear(frame(spark, a), [1, 0, 3, 0, 1, -2], 8, 10), 8, 10)
    assert moved[5, 2] == a[3, 5] and moved[0, 0] == 0
    dropped = raster.drizzle(frame(spark, a), 3.0, -2.0, scale=1.0, drop=1.0)
    got = {(r["oy"], r["ox"]): r["v"] for r in dropped.collect()}
    assert got[(1, 8)] == a[3, 5]


def test_greedy_matches_one_by_one(spark):
    pick = random.Random(8)
    pairs = [(0, a, b, float(pick.randint(1, 30))) for a in range(12) for b in range(12) if pick.random() < 0.5]
    used_a, used_b, expected = set(), set(), set()
    for _, a, b, d in sorted(pairs, key=lambda p: (p[3], p[1], p[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            expected.add((a, b))
    df = spark.createDataFrame(pairs, "frame int, a long, b long, distance double")
    assert {(r["a"], r["b"]) for r in catalog.greedy_match(df).collect()} == expected


def test_duplicates_keep_the_far_end_of_a_chain(spark):
    rows = [(0, 1, 0.0, 0.0, 9.0), (0, 2, 5.0, 0.0, 8.0), (0, 3, 10.0, 0.0, 7.0), (0, 4, 50.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "frame int, star long, x double, y double, flux double")
    assert sorted(r["star"] for r in catalog.without_duplicates(df, 8.0).collect()) == [1, 3, 4]


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_duplicates_one_by_one(spark, few):
    pick = random.Random(3)
    rows = [(pick.choice([1, 2, None]), k, pick.uniform(-30, 30), pick.uniform(-30, 30), pick.choice([None, 1.0, 2.5, float("nan"), float(k % 40)])) for k in range(400)]
    rows += [(1, 900 + k, 100.0 + 7.9 * k, 5.0, 50.0 - k) for k in range(20)] + [(1, 950, None, 5.0, 99.0), (2, 951, float("inf"), 5.0, 99.0), (2, 952, float("nan"), 0.0, 99.0)]
    df = spark.createDataFrame(rows, "frame int, star long, x double, y double, flux double")
    falling = lambda r: (r[4] is None, not r[4] != r[4] if r[4] is not None else True, -(r[4] or 0) if r[4] == r[4] else 0, r[1])
    kept = []
    for r in sorted(rows, key=falling):
        near = lambda q, r=r: r[2] is not None and q[2] is not None and q[0] == r[0] and ((q[2] - r[2]) ** 2 + (q[3] - r[3]) ** 2) ** 0.5 < 8
        if not any(near(q) for q in kept):
            kept.append(r)
    got = sorted(r["star"] for r in catalog.without_duplicates(df, 8.0, few=few).collect())
    assert got == sorted(r[1] for r in kept)


def test_dense_stars_are_not_paired(spark):
    """5,000 stars within one separation: 12 million pairs, of which one star stays."""
    from framewright.sources import shared

    df = spark.range(5000).selectExpr("1 AS frame", "id AS star", "cast(id % 71 AS double) / 10 AS x", "cast(id % 67 AS double) / 10 AS y", "cast(id * 37 % 5003 AS double) AS flux")
    before = len(shared._written)
    assert [r["star"] for r in catalog.without_duplicates(df, 20.0, few=0).collect()] == [df.orderBy("flux", ascending=False).first()["star"]]
    assert sum(spark.read.parquet(path).count() for path in shared._written[before:]) < 6000


def test_stream_of_bursts(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-02 00:00:00"), (1, "2024-01-05 00:00:00")]
    source = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    out = events.debounced_stream(stream).writeStream.format("memory").queryName("bursts").outputMode("append")
    run = out.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("bursts").collect()) == [1, 2]  # the last burst is still open
    assert sorted(r["n"] for r in events.debounced(source).collect()) == [1, 1, 2]


def test_regions(spark):
    lines = ["##..#", "..#..", "#...#", "##.##"]
    a = [[1.0 if c == "#" else 0.0 for c in line] for line in lines]
    pixels = frame(spark, a)
    mask = pixels.filter("v > 0")
    from framewright.operators import regions

    found = regions.region_stats(pixels, regions.label_regions(mask)).collect()
    assert sorted((r["y0"], r["x0"], r["area"], r["x_from"], r["x_to"], r["y_to"]) for r in found) == [(0, 0, 3, 0, 3, 2), (0, 4, 1, 4, 5, 1), (2, 0, 3, 0, 2, 4), (2, 4, 3, 3, 5, 4)]
    straight = regions.region_stats(pixels, regions.label_regions(mask, diagonal=False)).collect()
    assert len(straight) == 5


def test_scales_add_up(spark):
    from framewright.operators import regions

    a = np.random.default_rng(2).random((6, 6))
    details, rest = regions.planes(frame(spark, a), 2, 6, 6)
    assert np.allclose(sum(grid(d, 6, 6, "w") for d in details) + grid(rest, 6, 6), a)
    assert np.allclose(grid(regions.denoise(frame(spark, a), 6, 6, strength=0.0), 6, 6), a)
    flat = grid(regions.compress_range(frame(spark, np.full((6, 6), 0.3)), 6, 6, scales=2), 6, 6)
    assert np.allclose(flat, 0.3)


def test_imaging_formulas(spark):
    from framewright.functions import imaging

    a = F.col("a")
    assert one(spark, imaging.sexagesimal(a), a="-00:30:00") == -0.5 and one(spark, imaging.sexagesimal(a), a=" 12 30 36 ") == 12.51
    assert one(spark, imaging.sexagesimal(a), a="12 30") is None and one(spark, imaging.sexagesimal(a), a="x y z") is None
    for b in (-2.0, -1.0, 0.0, 3.0):
        curve = [one(spark, imaging.hyperbolic_stretch(a, 5.0, b, 0.3, 0.1, 0.9), a=x) for x in (0.0, 0.2, 0.3, 0.5, 0.95, 1.0)]
        assert curve == sorted(curve) and curve[0] == 0 and curve[-1] == pytest.approx(1)
    assert one(spark, imaging.hyperbolic_stretch(a, 0.0, 1.0, 0.3), a=0.4) == 0.4


def test_critical_values_are_those_of_the_tables():
    for m, bound in ((10, 2.290), (20, 2.709), (30, 2.908)):
        assert abs(stack.esd_critical(m) - bound) < 2e-3


@pytest.mark.parametrize("b", [-3.0, -1.0, -0.4, 0.0, 0.7, 4.0])
def test_hyperbolic_stretch_is_the_area_under_its_slope(spark, b):
    d, centre, low, high = 3.0, 0.35, 0.1, 0.8

    def slope(x):
        u = abs(min(max(x, low), high) - centre)
        if b == 0:
            return math.exp(-d * u)
        return (1 + b * d * u) ** (-(1 + b) / b) if b > 0 else (1 - b * d * u) ** (1 / b)

    n = 20_000
    area = np.concatenate([[0], np.cumsum([slope((i + 0.5) / n) for i in range(n)])])
    places = [0.0, 0.05, 0.1, 0.3, 0.35, 0.5, 0.8, 0.95, 1.0]
    df = spark.createDataFrame([(x,) for x in places], "x double")
    got = [r[0] for r in df.select(imaging.hyperbolic_stretch(F.col("x"), d, b, centre, low, high)).collect()]
    assert np.allclose(got, [area[round(x * n)] / area[-1] for x in places], atol=1e-6)


def test_small_stacks_coverage_and_the_grid(spark):
    rows = [(p, f, float(f + p), 0.0005 if (p, f) == (1, 2) else 1.0) for p in (1, 2) for f in (1, 2, 3, 9)]
    samples = spark.createDataFrame(rows, "px long, frame long, v double, coverage double")
    found = stack.stacked(stack.covered(samples), "sigma")  # four frames: the median
    grid = spark.createDataFrame([(1,), (2,), (7,)], "px long")
    got = {r["px"]: (r["n_samples"], r["value"]) for r in stack.on_grid(found, grid).collect()}
    assert got == {1: (3, 4.0), 2: (4, 4.5), 7: (0, 0.0)}
    assert stack.stacked(samples, None).filter("px = 1").first()["value"] == 4.75
    assert stack.stacked(samples.filter("false"), "sigma").count() == 0


def test_common_domain_and_multiplicative_gains(spark):
    rows = [(p, f, p * (1.0 + f)) for p in range(1, 8) for f in (0, 1)] + [(99, 0, 1e6)]
    shared = stack.common_domain(spark.createDataFrame(rows, "px long, frame long, v double"))
    assert {r["px"] for r in shared.collect()} == set(range(1, 8))
    gains = {r["frame"]: r["gain"] for r in stack.multiplicative_gains(stack.frame_levels(shared)).collect()}
    assert gains == {0: 1.0, 1: 0.5}


def test_auto_softening_brings_the_median_to_its_target(spark):
    pixels = spark.createDataFrame([(0, 0, i, 0.01 * (i + 1)) for i in range(9)], "frame long, y int, x int, v double")
    got = sorted(r["v"] for r in raster.auto_asinh(pixels, 0.6).collect())
    assert abs(got[4] - 0.6) < 1e-9


def test_colours_keep_their_ratios(spark):
    df = spark.createDataFrame([(0.2, 0.1, 0.3), (0.0, 0.0, 0.0), (0.9, 0.1, 0.1)], "r double, g double, b double")
    bent = imaging.colour_preserving(F.col("r"), F.col("g"), F.col("b"), lambda v: raster.asinh_stretch(v, 0.05))
    got = [tuple(r) for r in df.select(*bent).collect()]
    assert got[1] == (0.0, 0.0, 0.0) and max(map(max, got)) <= 1.0 + 1e-12
    assert np.allclose(np.array(got[0]) / got[0][1], (2, 1, 3)) and math.isclose(got[2][0], 1.0)


def test_rigid_fit_finds_turn_and_shift(spark):
    pick = np.random.default_rng(1)
    places = pick.uniform(0, 100, (20, 2))
    a = 0.3
    rows = [(0, float(x), float(y), float(math.cos(a) * x - math.sin(a) * y + 5), float(math.sin(a) * x + math.cos(a) * y - 7)) for x, y in places]
    r = catalog.rigid(spark.createDataFrame(rows, "frame long, rx double, ry double, tx double, ty double")).first()
    assert np.allclose((r["angle"], r["dx"], r["dy"]), (a, 5, -7))
    shift = np.array([[t[3] - t[1], t[4] - t[2]] for t in rows]).mean(axis=0)
    assert np.allclose((r["shift_x"], r["shift_y"]), shift)


def test_noisy_channels_count_less(spark):
    rows = [(f, y, x, f + 0.1 * (f + 1) * ((-1) ** (x + y))) for f in (0, 1) for y in range(8) for x in range(8)]
    pixels = spark.createDataFrame(rows, "frame long, y int, x int, v double")
    tiles = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 2.0), (1, 0, 1, 0.0)], "frame long, ty int, tx int, sigma double")
    got = {(r["y"], r["x"]): r["v"] for r in raster.combine_channels(pixels, tiles).collect()}
    assert math.isclose(got[(0, 0)], (0.1 * 1 + 1.2 * 0.25) / 1.25)


def test_bracketed_medians_are_exact(spark):
    pick = random.Random(7)
    groups = {g: [round(pick.gauss(0, 1), 2 if g % 2 else 9) for _ in range(n)] for g, n in enumerate((1, 2, 3, 4, 999, 1000, 30_000, 30_001))}
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]]
    got = {r["g"]: r["m"] for r in levels.medians(spark.createDataFrame(rows, "g int, v double").repartition(4), ["g"], "v", "m").collect()}
    assert got == pytest.approx({g: float(np.median(values)) for g, values in groups.items()}, abs=1e-15)


def test_transforms_compose_and_invert():
    m, k = [1.1, -0.2, 5.0, 0.3, 0.9, -4.0, 1e-4, 2e-4, 1.0], [0.5, 0.1, -3.0, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0]
    a, b = np.array(m).reshape(3, 3), np.array(k).reshape(3, 3)
    assert np.allclose(catalog.composed(m, k), (a @ b).ravel()) and np.allclose(catalog.inverse(m), np.linalg.inv(a).ravel())
    with pytest.raises(ValueError):
        catalog.inverse([1.0] * 9)
