"""Star measurements on planted stars."""

import numpy as np
import pytest

from framewright.operators import measurement


def sky(spark, stars, shape, size=96, noise=0.0, background=0.1, seed=4):
    """A frame with stars (x, y, amplitude), its pixels, and the stars' brightest pixels as peaks."""
    pick = np.random.default_rng(seed)
    gy, gx = np.mgrid[0:size, 0:size].astype(float)
    image = background + noise * pick.normal(size=(size, size))
    for x, y, a in stars:
        image = image + a * shape(gx - x, gy - y)
    rows = [(1, int(y), int(x), float(image[y, x]), background, max(noise, 1e-3)) for y in range(size) for x in range(size)]
    pixels = spark.createDataFrame(rows, "frame int, y int, x int, v double, sky double, noise double")
    peaks = spark.createDataFrame([(1, k, round(y), round(x)) for k, (x, y, _) in enumerate(stars)], "frame int, star int, py int, px int")
    return pixels, peaks


STARS = [(20.3, 30.7, 1.0), (55.45, 40.1, 0.6), (70.0, 70.5, 0.3), (33.9, 66.2, 0.8)]
ROUND = lambda dx, dy: np.exp(-(dx * dx + dy * dy) / (2 * 1.7**2))
LONG = lambda dx, dy: np.exp(-(dx * dx / (2 * 2.2**2) + dy * dy / (2 * 1.4**2)))
MOFFAT = lambda dx, dy: (1 + (dx * dx + dy * dy) / 2.4**2) ** -2.5


@pytest.mark.parametrize(("method", "shape", "noise", "near"), [("moments", ROUND, 0.0, 0.02), ("gaussian", ROUND, 0.0005, 0.01), ("gaussian", LONG, 0.0005, 0.01), ("moffat", MOFFAT, 0.0005, 0.01)])
def test_places_of_planted_stars(spark, method, shape, noise, near):
    pixels, peaks = sky(spark, STARS, shape, noise=noise)
    rows = {r["star"]: r for r in measurement.measured_stars(pixels, peaks, 4.0, method=method).collect()}
    assert len(rows) == len(STARS)
    for k, (x, y, a) in enumerate(STARS):
        assert np.hypot(rows[k]["x"] - x, rows[k]["y"] - y) < near
    if shape is ROUND:
        assert all(abs(r["fwhm"] - 1.7 * 2.354820045) < 0.06 and r["eccentricity"] < 0.15 for r in rows.values())
        assert rows[0]["flux"] == pytest.approx(2 * np.pi * 1.7**2, rel=0.02) or noise
    if shape is LONG:
        assert all(abs(r["eccentricity"] - np.sqrt(1 - (1.4 / 2.2) ** 2)) < 0.02 for r in rows.values())
    if shape is MOFFAT:
        width = 2 * 2.4 * np.sqrt(2 ** (1 / 2.5) - 1)
        assert all(abs(r["fwhm"] - width) < 0.05 for r in rows.values())


def test_windowed_covariance_of_a_long_star(spark):
    pixels, peaks = sky(spark, STARS, LONG)
    for r in measurement.measured_stars(pixels, peaks, 4.5).collect():
        assert abs(r["eccentricity"] - np.sqrt(1 - (1.4 / 2.2) ** 2)) < 0.02
        assert abs(r["fwhm"] - 2.354820045 * np.sqrt((2.2**2 + 1.4**2) / 2)) < 0.05
        assert r["ground"] < -0.1  # wide along x


def test_stars_at_the_border_and_without_light(spark):
    stars = [(4.0, 40.0, 1.0), (40.0, 40.0, 1.0), (60.0, 60.0, 0.0)]
    pixels, peaks = sky(spark, stars, ROUND)
    assert [r["star"] for r in measurement.measured_stars(pixels, peaks, 4.0).collect()] == [1]
    assert measurement.measured_stars(pixels.filter("NOT (y = 41 AND x = 41)"), peaks, 4.0).count() == 0  # a pixel is missing
    assert measurement.measured_stars(pixels.filter("false"), peaks, 4.0).count() == 0
    assert measurement.measured_stars(pixels, peaks.filter("false"), 4.0).count() == 0


def test_ring_takes_the_local_sky(spark):
    """The pixels' own sky is wrong by a tenth; the ring around the star knows better."""
    pixels, peaks = sky(spark, [(48.2, 47.8, 1.0)], ROUND, background=0.2, noise=0.001)
    low = pixels.withColumn("sky", pixels["sky"] - 0.1)
    flux = {ring: measurement.measured_stars(low, peaks, 4.0, ring=ring).first()["flux"] for ring in (True, False)}
    assert flux[True] == pytest.approx(2 * np.pi * 1.7**2, rel=0.03) and flux[False] > 1.8 * flux[True] * 0.9


def test_a_peak_at_every_pixel_moves_tiles_only(spark):
    pixels, _ = sky(spark, STARS, ROUND, size=80, noise=0.01)
    every = pixels.selectExpr("frame", "y * 1000 + x AS star", "y AS py", "x AS px")
    found = {t: measurement.measured_stars(pixels, every.union(every), 3.0, steps=2, tile=t) for t in (32, 100)}
    assert "collect_list" not in found[32]._jdf.queryExecution().toString()
    small, large = (sorted(map(tuple, df.collect())) for df in found.values())
    assert small == large and len(small) > 3000
    few = every.filter("star % 97 = 0")
    alone = sorted(map(tuple, measurement.measured_stars(pixels, few, 3.0, steps=2).collect()))
    assert alone == [r for r in small if r[1] % 97 == 0]


def test_unknown_method(spark):
    pixels, peaks = sky(spark, STARS, ROUND, size=16)
    with pytest.raises(ValueError):
        measurement.measured_stars(pixels, peaks, 4.0, method="other")
