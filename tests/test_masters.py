"""Hot and cold pixels, their correction, flats by colour and local contrast against planted defects and plain NumPy."""

import numpy as np
import pytest

from framewright.operators import masters, raster

BAYER = [[0, 1], [1, 2]]
XTRANS = [[1, 2, 1, 1, 0, 1], [0, 1, 0, 2, 1, 2], [1, 2, 1, 1, 0, 1], [1, 0, 1, 1, 2, 1], [2, 1, 2, 0, 1, 0], [1, 0, 1, 1, 2, 1]]


def frame_of(spark, image):
    return spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(image)], "frame int, y int, x int, v double")


def sensor(size=64, seed=1):
    """A glow that rises to one corner, a level for each colour, and noise."""
    pick = np.random.default_rng(seed)
    gy, gx = np.mgrid[0:size, 0:size]
    colours = np.array(BAYER)[gy % 2, gx % 2]
    return 0.1 + 0.05 * (gy * gx) / size**2 + 0.02 * colours + pick.normal(scale=0.002, size=(size, size))


def test_hot_pixels_on_a_glow(spark):
    image = sensor()
    planted = {(5, 7), (20, 21), (20, 23), (22, 21), (40, 63), (63, 0)}  # three of them neighbours of one colour
    for y, x in planted:
        image[y, x] += 0.05
    found = {(r["y"], r["x"]) for r in masters.hot_pixels(frame_of(spark, image), 6.0, BAYER, 16).collect()}
    assert found == planted
    assert masters.hot_pixels(frame_of(spark, np.ones((16, 16))), 5.0, BAYER, 8).count() == 0  # even darks have none
    assert masters.hot_pixels(frame_of(spark, image).filter("false"), 5.0, BAYER, 16).count() == 0


@pytest.mark.parametrize("pattern", [masters.MONO, BAYER, XTRANS])
def test_cold_pixels_and_correction(spark, pattern):
    size = 24
    gy, gx = np.mgrid[0:size, 0:size]
    colours = np.array(pattern)[gy % len(pattern), gx % len(pattern[0])]
    flat = 1.0 + colours + 0.01 * gy
    planted = {(0, 0), (10, 11), (23, 5)}
    for y, x in planted:
        flat[y, x] *= 0.1
    pixels = frame_of(spark, flat)
    cold = masters.cold_pixels(pixels, pattern)
    assert {(r["y"], r["x"]) for r in cold.collect()} == planted
    mended = {(r["y"], r["x"]): r["v"] for r in masters.corrected(pixels, cold, pattern).collect()}
    assert len(mended) == size * size
    offsets = masters.same_colour_offsets(pattern)
    for (y, x), v in mended.items():
        if (y, x) not in planted:
            assert v == flat[y, x]
            continue
        near = [(y + dy, x + dx) for dy, dx in offsets[y % len(pattern), x % len(pattern[0])]]
        good = [flat[p] for p in near if 0 <= p[0] < size and 0 <= p[1] < size and p not in planted]
        assert v == pytest.approx(np.median(good)) and all(colours[p] == colours[y, x] for p in near if 0 <= p[0] < size and 0 <= p[1] < size)


def test_a_cluster_draws_on_good_pixels_only(spark):
    image = np.ones((9, 9))
    image[3:6, 3:6] = 9.0
    bad = spark.createDataFrame([(y, x) for y in range(3, 6) for x in range(3, 6)], "y int, x int")
    mended = {(r["y"], r["x"]): r["v"] for r in masters.corrected(frame_of(spark, image), bad).collect()}
    assert mended[4, 4] == 9.0  # none of its eight neighbours is good
    assert all(v == 1.0 for p, v in mended.items() if p != (4, 4))


def test_summary_and_flat(spark):
    image = np.where(np.add.outer(np.arange(4), np.arange(4)) % 2, 4.0, 2.0)
    pixels = frame_of(spark, image)
    two, none = pixels.filter("y = 0 AND x < 2"), pixels.filter("false")
    assert tuple(masters.defect_summary(two, none, pixels).first()) == (2, 0, 16, 12.5)
    assert tuple(masters.defect_summary(none, none, none).first()) == (0, 0, 0, 0.0)
    mono = {r["v"] for r in masters.prepared_flat(pixels).collect()}
    assert mono == {2 / 3, 4 / 3}
    by_colour = masters.prepared_flat(pixels, pixels.filter("y = 3").withColumn("v", pixels["v"] * 0.99), BAYER).collect()
    assert min(r["v"] for r in by_colour) == 0.1 and max(r["v"] for r in by_colour) > 1


def brute_contrast(image, n, clip, strength):
    bins, (h, w) = raster.BINS, image.shape
    th, tw = -(-h // n), -(-w // n)
    which = np.floor(np.clip(image, 0, 1) * (bins - 1) + 0.5).astype(int)
    curves = np.empty((n, n, bins))
    for i in range(n):
        for j in range(n):
            part = which[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel()
            held = np.bincount(part, minlength=bins)
            most = max(int(clip * len(part) / bins), 1)
            spare = np.maximum(held - most, 0).sum()
            held = np.minimum(held, most) + spare // bins + (np.arange(bins) < spare % bins)
            curves[i, j] = np.cumsum(held) / len(part)
    out = np.empty_like(image)
    for y in range(h):
        for x in range(w):
            gy, gx = np.clip((y + 0.5) / th - 0.5, 0, n - 1), np.clip((x + 0.5) / tw - 0.5, 0, n - 1)
            y0, x0 = int(gy), int(gx)
            y1, x1, b = min(y0 + 1, n - 1), min(x0 + 1, n - 1), which[y, x]
            top = curves[y0, x0, b] + (gx - x0) * (curves[y0, x1, b] - curves[y0, x0, b])
            bottom = curves[y1, x0, b] + (gx - x0) * (curves[y1, x1, b] - curves[y1, x0, b])
            out[y, x] = image[y, x] + strength * (top + (gy - y0) * (bottom - top) - image[y, x])
    return out


@pytest.mark.parametrize(("tiles", "clip", "strength"), [(2, 3.0, 1.0), (2, 1.0, 0.4), (8, 40.0, 1.0)])
def test_local_contrast(spark, tiles, clip, strength):
    image = np.random.default_rng(3).beta(2, 5, size=(70, 66)) * 1.1
    got = np.empty_like(image)
    for r in raster.local_contrast(frame_of(spark, image), *image.shape, tiles, clip, strength).collect():
        got[r["y"], r["x"]] = r["v"]
    n = min(tiles, int((image.size / (4 * raster.BINS)) ** 0.5))
    assert np.allclose(got, brute_contrast(image, n, clip, strength))
