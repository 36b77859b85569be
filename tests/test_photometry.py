"""Photometric gains and distortion polynomials on planted frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import distortion, photometry


def frames(spark, outliers=0.1, noise=0.01, size=40, seed=3):
    pick = np.random.default_rng(seed)
    base = pick.gamma(3.0, 1.0, size=(size, size))
    rows = []
    for frame, (gain, offset) in enumerate([(1.0, 0.0), (0.5, 0.3), (2.0, -1.0)], 1):
        seen = base / gain - offset / gain + noise / gain * pick.normal(size=base.shape)
        wrong = pick.random(base.shape) < (outliers if frame > 1 else 0)
        seen = np.where(wrong, seen + 20, seen)
        rows += [(frame, y, x, float(v)) for (y, x), v in np.ndenumerate(seen)]
    return spark.createDataFrame(rows, "frame int, y int, x int, v double")


def test_planted_gains_among_outliers(spark):
    got = {r["frame"]: r for r in photometry.photometric_gains(frames(spark), 1).collect()}
    for frame, gain, offset in ((1, 1.0, 0.0), (2, 0.5, 0.3), (3, 2.0, -1.0)):
        assert got[frame]["gain"] == pytest.approx(gain, rel=0.01) and got[frame]["offset"] == pytest.approx(offset, abs=0.7)  # medians meet, outliers among them
    assert got[2]["n"] < 1600


def test_common_pixels_only(spark):
    df = frames(spark, outliers=0, noise=0)
    holes = df.filter("NOT (frame = 2 AND y < 10)").union(df.filter("false"))
    assert photometry.common_pixels(holes).count() == 3 * 30 * 40
    got = {r["frame"]: r["gain"] for r in photometry.photometric_gains(holes, 1).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.5, 3: 2.0})


def test_flat_frames_keep_their_gain(spark):
    df = frames(spark).withColumn("v", F.lit(0.25))
    assert {r["gain"] for r in photometry.photometric_gains(df, 1).collect()} == {1.0}
    assert photometry.photometric_gains(df.filter("false"), 1).count() == 0


def test_noise_ratio_turns_the_slope(spark):
    """A frame much noisier than the reference: all errors lie on its side."""
    pick = np.random.default_rng(5)
    base = pick.normal(size=3000)
    rows = [(1, 0, k, float(v)) for k, v in enumerate(base)] + [(2, 0, k, float(v + e)) for k, (v, e) in enumerate(zip(base, pick.normal(size=3000)))]
    df = spark.createDataFrame(rows, "frame int, y int, x int, v double")
    noise = spark.createDataFrame([(1, 0.0001), (2, 1.0)], "frame int, variance double")
    told = {r["frame"]: r["gain"] for r in photometry.photometric_gains(df, 1, noise).collect()}[2]
    plain = {r["frame"]: r["gain"] for r in photometry.photometric_gains(df, 1).collect()}[2]
    assert told == pytest.approx(1.0, abs=0.15) and plain == pytest.approx((5**0.5 - 1) / 2, abs=0.1)


M = [1.02, -0.03, 5.0, 0.05, 0.98, -3.0, 0.0, 0.0, 1.0]


def bent(x, y, order):
    u, w = (x - 500) / 500, (y - 400) / 500
    f = x + 3.0 * u * u - 2.0 * u * w + (1.5 * u**3 - w**3 if order > 2 else 0)
    g = y + 1.0 * w * w + (0.8 * u * u * w if order > 2 else 0)
    return M[0] * f + M[1] * g + M[2], M[3] * f + M[4] * g + M[5]


def matches(spark, n, order, outliers=0.0, seed=1):
    pick = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x, y = pick.uniform(0, 1000), pick.uniform(0, 800)
        tx, ty = bent(x, y, order)
        rows.append((1, k, x, y, tx + 60 * (k < n * outliers), ty))
    return spark.createDataFrame(rows, "frame int, star long, rx double, ry double, tx double, ty double")


@pytest.mark.parametrize(("order", "outliers"), [(2, 0.0), (3, 0.15)])
def test_planted_distortion(spark, order, outliers):
    pairs = matches(spark, 120, order, outliers)
    linear = spark.createDataFrame([(1, M)], "frame int, m array<double>")
    fits = distortion.fit_distortion(pairs, linear, order)
    r = fits.first()
    assert r["order"] == order and r["n"] == 120 - int(120 * outliers) and len(r["a"]) == len(distortion.terms(order))
    seen = distortion.predicted(pairs.select("frame", "star", F.col("rx").alias("x"), F.col("ry").alias("y")), fits, linear)
    for s in seen.collect():
        m = pairs.filter(F.col("star") == s["star"]).first() if s["star"] in (30, 60, 119) else None
        if m is not None:  # linear and constant parts of the bend stay with the transform, about the matches' own middle
            assert np.hypot(s["x"] - m["tx"], s["y"] - m["ty"]) < 0.6


def test_order_by_the_number_of_matches(spark):
    linear = spark.createDataFrame([(1, M)], "frame int, m array<double>")
    for n, order in ((8, None), (9, 2), (200, 5)):
        rows = distortion.fit_distortion(matches(spark, n, 2), linear, 5).collect()
        assert [r["order"] for r in rows] == ([] if order is None else [order])
    stars = spark.createDataFrame([(1, 1, 2.0, 3.0)], "frame int, star long, x double, y double")
    none = distortion.fit_distortion(matches(spark, 4, 2), linear, 3)
    assert distortion.undistorted(stars, none).first()["x"] == 2.0
    with pytest.raises(ValueError):
        distortion.fit_distortion(matches(spark, 9, 2), linear, 6)
