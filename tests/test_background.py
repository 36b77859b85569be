"""Splines, refinement and polynomial surfaces against dense solves and planted skies."""

import numpy as np
import pytest

from framewright.operators import background


def frame_of(spark, image, frame=1):
    rows = [(frame, y, x, float(v)) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "frame int, y int, x int, v double")


def image_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


def dense_spline(values, at, where):
    """A natural cubic spline through one line by a dense solve of all its conditions."""
    n = len(at)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        h0, h1 = at[i] - at[i - 1], at[i + 1] - at[i]
        a[i, i - 1 : i + 2] = h0, 2 * (h0 + h1), h1
        b[i] = 6 * ((values[i + 1] - values[i]) / h1 - (values[i] - values[i - 1]) / h0)
    m = np.linalg.solve(a, b) if n > 2 else np.zeros(n)
    p = np.clip(where, at[0], at[-1])
    k = np.clip(np.searchsorted(at, p, "right") - 1, 0, max(n - 2, 0))
    if n == 1:
        return np.full(len(p), values[0])
    h = at[k + 1] - at[k]
    t = (p - at[k]) / h
    return (1 - t) * values[k] + t * values[k + 1] + h * h / 6 * (((1 - t) ** 3 - (1 - t)) * m[k] + (t**3 - t) * m[k + 1])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
def test_second_derivatives(n):
    pick = np.random.default_rng(n)
    at, values = np.cumsum(pick.uniform(1, 5, n)), pick.normal(size=(3, n))
    for line, bent in zip(values, background.natural_spline(values, at)):
        where = np.linspace(at[0], at[-1], 50)
        if n > 1:
            k = np.clip(np.searchsorted(at, where, "right") - 1, 0, n - 2)
            h, t = at[k + 1] - at[k], (where - at[k]) / (at[k + 1] - at[k])
            got = (1 - t) * line[k] + t * line[k + 1] + h * h / 6 * (((1 - t) ** 3 - (1 - t)) * bent[k] + (t**3 - t) * bent[k + 1])
            assert np.allclose(got, dense_spline(line, at, where))


@pytest.mark.parametrize("shape", [(50, 37), (16, 40), (9, 9), (33, 20)])
def test_planes_against_dense_solves(spark, shape):
    """Bicubic splines as one-dimensional ones along both axes, with a smaller last tile, few tiles, or one."""
    height, width = shape
    ys, xs = (np.array(background.centres(n, 16)) for n in shape)
    sky = np.random.default_rng(1).normal(size=(len(ys), len(xs)))
    tiles = spark.createDataFrame([(1, i, j, float(v), 1.0) for (i, j), v in np.ndenumerate(sky)], "frame int, ty int, tx int, sky double, sigma double")
    lines = np.array([dense_spline(row, xs, np.arange(width)) for row in sky])
    want = np.array([dense_spline(col, ys, np.arange(height)) for col in lines.T]).T
    planes = background.spline_planes(frame_of(spark, np.zeros(shape)), tiles, 16, height, width)
    assert np.allclose(image_of(planes, "sky", shape), want, atol=1e-9) and np.allclose(image_of(planes, "noise", shape), 1)


def test_refinement_leaves_objects_out(spark):
    pick = np.random.default_rng(2)
    gy, gx = np.mgrid[0:48, 0:48].astype(float)
    sky = 0.2 + 0.001 * gy
    image = sky + pick.normal(scale=0.004, size=sky.shape) + 0.5 * np.exp(-((gx - 20) ** 2 + (gy - 22) ** 2) / 30)
    pixels = frame_of(spark, image)
    once = background.refined_background(pixels, 16, 48, 48, rounds=0)
    again = background.refined_background(pixels, 16, 48, 48, rounds=3, dilation=2)
    # between the middles of the outer tiles
    errors = [np.abs(image_of(df, "sky", sky.shape) - sky)[8:40, 8:40].max() for df in (once, again)]
    assert errors[1] < 0.01 and errors[1] < errors[0] / 3


def test_one_round_finds_the_wings(spark):
    """An object that lifts the sky and noise of its own tile is masked as a whole at once, for several noises."""
    gy, gx = np.mgrid[0:48, 0:48].astype(float)
    sky = 0.2 + 0.001 * gy
    images = [sky + np.random.default_rng(k).normal(scale=0.004, size=sky.shape) + 0.5 * np.exp(-((gx - 20) ** 2 + (gy - 22) ** 2) / 30) for k in range(4)]
    pixels = frame_of(spark, images[0], 0)
    for k in (1, 2, 3):
        pixels = pixels.union(frame_of(spark, images[k], k))
    found = background.refined_background(pixels.coalesce(2), 16, 48, 48, rounds=1, dilation=2).toPandas()
    found = found[found.y.between(8, 39) & found.x.between(8, 39)]
    worst = (found.sky - 0.2 - 0.001 * found.y).abs().groupby(found.frame).max()
    assert len(worst) == 4 and worst.max() < 0.015


@pytest.mark.parametrize("degree", [1, 2, 3, 4])
def test_planted_sky_is_removed(spark, degree):
    size, tile = 64, 8
    gy, gx = np.meshgrid(np.linspace(-1, 1, size), np.linspace(-1, 1, size), indexing="ij")
    pick = np.random.default_rng(degree)
    terms = background._terms(degree)
    planted = pick.normal(size=len(terms))
    sky = sum(c * gx**i * gy**j for c, (i, j) in zip(planted, terms)) + 10
    at = np.array(background.centres(size, tile))
    unit = 2 * at / (size - 1) - 1
    rows = [(1, a, b, float(sum(c * unit[b] ** i * unit[a] ** j for c, (i, j) in zip(planted, terms)) + 10)) for a in range(8) for b in range(8)]
    rows[19] = (*rows[19][:3], rows[19][3] + 50.0)  # a tile on an object
    tiles = spark.createDataFrame(rows, "frame int, ty int, tx int, sky double")
    fits = background.fit_surfaces(tiles, tile, size, size, degree)
    found = fits.first()
    planted[0] += 10
    assert np.allclose(found["coefficients"], planted, atol=1e-8) and found["n"] == 63
    assert found["mean"] == pytest.approx(sky.mean())
    pixels = frame_of(spark, sky + 0.25)
    assert np.allclose(image_of(background.surface_removed(pixels, fits, size, size), "v", sky.shape), 0.25, atol=1e-7)
    divided = image_of(background.surface_removed(pixels, fits, size, size, divide=True), "v", sky.shape)
    assert np.allclose(divided, (sky + 0.25) / np.maximum(sky / sky.mean(), 0.1))


def test_noisy_tiles_equal_a_dense_fit(spark):
    size, tile = 40, 8
    pick = np.random.default_rng(7)
    z = pick.normal(size=(5, 5))
    tiles = spark.createDataFrame([(1, a, b, float(v)) for (a, b), v in np.ndenumerate(z)], "frame int, ty int, tx int, sky double")
    unit = 2 * np.array(background.centres(size, tile)) / (size - 1) - 1
    design = np.array([[unit[b] ** i * unit[a] ** j for i, j in background._terms(3)] for a in range(5) for b in range(5)])
    want = np.linalg.lstsq(design, z.ravel(), rcond=None)[0]
    assert np.allclose(background.fit_surfaces(tiles, tile, size, size, 3, rounds=0).first()["coefficients"], want, atol=1e-9)


def test_few_tiles_lower_the_degree(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 1, 4.0)], "frame int, ty int, tx int, sky double")
    assert len(background.fit_surfaces(tiles, 8, 16, 16, 4).first()["coefficients"]) == 3
    assert background.fit_surfaces(tiles.filter("ty = 0"), 8, 16, 16, 1).count() == 0  # no plane
    assert background.fit_surfaces(tiles.filter("false"), 8, 16, 16, 1).count() == 0
    with pytest.raises(ValueError):
        background.fit_surfaces(tiles, 8, 16, 16, 5)
