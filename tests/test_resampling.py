"""Warp kernels against plain NumPy and exact cases."""

import numpy as np
import pytest

from framewright.operators import resampling


def frame_of(spark, image):
    return spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(image)], "frame int, y int, x int, v double")


def images(df, shape):
    out = {c: np.full(shape, np.nan) for c in ("v", "coverage", "noise_gain")}
    for r in df.collect():
        for c in out:
            out[c][r["y"], r["x"]] = r[c]
    return out


def kernel_at(kernel, d):
    d = abs(d)
    if kernel == "bilinear":
        return max(1 - d, 0)
    if kernel == "bicubic":
        return 1.5 * d**3 - 2.5 * d * d + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d * d - 4 * d + 2 if d < 2 else 0
    a, d = int(kernel[-1]), np.floor(d * 4096 + 0.5) / 4096
    return np.sinc(d) * np.sinc(d / a) if d < a else 0


def brute(image, sx, sy, kernel):
    h, w = image.shape
    a = resampling.KERNELS[kernel]
    total = held = 0.0
    whole = True
    for py in range(int(np.floor(sy)) - a + 1, int(np.floor(sy)) + a + 1):
        for px in range(int(np.floor(sx)) - a + 1, int(np.floor(sx)) + a + 1):
            k = kernel_at(kernel, sy - py) * kernel_at(kernel, sx - px)
            if 0 <= py < h and 0 <= px < w:
                total += k * image[py, px]
                held += k
            else:
                whole &= k == 0
    if kernel.startswith("lanczos") and not whole:
        return brute(image, sx, sy, "bilinear")
    return total / held if abs(held) > 1e-10 else 0.0


@pytest.mark.parametrize("kernel", ["bilinear", "bicubic", "lanczos2", "lanczos3", "lanczos4"])
def test_kernels_across_tiles(spark, kernel):
    shape = (70, 68)  # more than one tile
    image = np.random.default_rng(1).normal(size=shape)
    m = [0.97, 0.11, -2.3, -0.08, 1.02, 3.1, 1e-4, -5e-5, 1.0]
    got = images(resampling.warped(frame_of(spark, image), m, *shape, kernel, border=-9.0), shape)
    for y in range(0, shape[0], 3):
        for x in range(0, shape[1], 3):
            w = m[6] * x + m[7] * y + 1
            sx, sy = (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w
            if not (-0.5 <= sx <= shape[1] - 0.5 and -0.5 <= sy <= shape[0] - 0.5):
                assert got["v"][y, x] == -9.0 and got["coverage"][y, x] == 0
                continue
            if kernel == "bilinear":
                sx, sy = np.clip(sx, 0, shape[1] - 1), np.clip(sy, 0, shape[0] - 1)
            assert got["v"][y, x] == pytest.approx(brute(image, sx, sy, kernel), abs=1e-9), (y, x)
    inner = got["coverage"][20:50, 20:50]
    assert np.allclose(inner, 1) and (got["noise_gain"][20:50, 20:50] > 0).all()


@pytest.mark.parametrize("kernel", list(resampling.KERNELS))
def test_no_motion_changes_nothing(spark, kernel):
    image = np.random.default_rng(2).normal(size=(20, 30))
    got = images(resampling.warped(frame_of(spark, image), [1, 0, 0, 0, 1, 0], 20, 30, kernel), image.shape)
    assert np.allclose(got["v"], image) and np.allclose(got["coverage"], 1) and np.allclose(got["noise_gain"], 1)


def test_constant_frames_stay_constant(spark):
    ones = frame_of(spark, np.ones((16, 16)))
    for kernel in ("bicubic", "lanczos3"):
        got = images(resampling.warped(ones, [1, 0, 0.37, 0, 1, -0.21], 16, 16, kernel), (16, 16))
        assert np.allclose(got["v"][got["coverage"] > 0], 1)


def test_missing_pixels_fall_away(spark):
    image = np.arange(64.0).reshape(8, 8)
    holes = frame_of(spark, image).filter("NOT (y = 4 AND x = 4)")
    got = images(resampling.warped(holes, [1, 0, 0.5, 0, 1, 0], 8, 8, "bilinear"), (8, 8))
    assert got["v"][4, 3] == image[4, 3] and got["coverage"][4, 3] == 0.5 and got["v"][2, 2] == image[2, 2] + 0.5
    assert np.isnan(got["v"][4, 4])  # the output has the places of the input
    assert resampling.warped(holes.filter("false"), [1, 0, 0, 0, 1, 0], 8, 8).count() == 0
    with pytest.raises(ValueError):
        resampling.warped(holes, [1, 0, 0, 0, 1, 0], 8, 8, "other")
