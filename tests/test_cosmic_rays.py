"""Cosmic ray hits: planted ones found, stars kept, and the whole frame at once as the measure of the tiles."""

import numpy as np
import pytest

from framewright.operators import cosmic_rays


def pixels_of(spark, frames):
    rows = [(f, y, x, None if np.isnan(v) and f == 9 else float(v)) for f, image in frames.items() for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "frame int, y int, x int, v double")


def images(df, frame, shape):
    v, hit = np.full(shape, np.nan), np.zeros(shape, dtype=bool)
    for r in df.filter(f"frame = {frame}").collect():
        v[r["y"], r["x"]], hit[r["y"], r["x"]] = np.nan if r["v"] is None else r["v"], r["hit"]
    return v, hit


def sky(seed, size=60):
    """Stars with wide profiles on noise, and hits of one pixel and of a track."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    image = 0.1 + r.normal(0, 0.003, (size, size))
    stars = [(12, 14), (40, 22), (25, 48)]
    for cy, cx in stars:
        image += 0.4 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * 2.2**2))
    hits = [(5, 40), (31, 31), (0, 0), (50, 50), (51, 51), (52, 52), (20, 5), (20, 6)]
    for c in hits:
        image[c] += 0.5
    return image, stars, hits


def whole(image, clip=4.5, contrast=5.0, grow=0.3, rounds=4, camera=None):
    a, hit = image.copy(), np.zeros(image.shape, dtype=bool)
    for _ in range(rounds):
        level = np.median(a)
        sigma = np.median(np.abs(a - level)) * 1.4826022
        before = hit.sum()
        a, hit = cosmic_rays.one_round(a, hit, level, sigma, camera, clip, contrast, grow)
        if hit.sum() == before:
            break
    return a, hit


@pytest.fixture(scope="module")
def skies():
    return {1: sky(1)[0], 2: sky(2)[0]}


@pytest.mark.parametrize("tile", [9, 23])
def test_tiles_change_nothing(spark, skies, tile):
    got = cosmic_rays.without_cosmic_rays(pixels_of(spark, skies), 60, 60, tile=tile)
    for f, image in skies.items():
        v, hit = images(got, f, image.shape)
        a, want = whole(image)
        assert (hit == want).all()
        np.testing.assert_allclose(v, a, rtol=0, atol=1e-12)


def test_hits_found_and_stars_kept(spark):
    image, stars, hits = sky(5)
    v, hit = images(cosmic_rays.without_cosmic_rays(pixels_of(spark, {1: image}), 60, 60, tile=32), 1, image.shape)
    assert all(hit[c] for c in hits)
    for cy, cx in stars:
        assert not hit[cy - 4 : cy + 5, cx - 4 : cx + 5].any()
    assert hit.sum() <= 3 * len(hits)
    assert np.abs(v[hit] - 0.1).max() < 0.05
    assert (v[~hit] == image[~hit]).all()


def test_camera_noise(spark):
    image, _, hits = sky(6)
    camera = (2.0, 8.0, 5000.0)
    v, hit = images(cosmic_rays.without_cosmic_rays(pixels_of(spark, {1: image}), 60, 60, camera=camera, tile=20), 1, image.shape)
    a, want = whole(image, camera=camera)
    assert (hit == want).all() and all(hit[c] for c in hits)
    np.testing.assert_allclose(v, a, rtol=0, atol=1e-12)


def test_mosaic_goes_by_colour(spark):
    r = np.random.default_rng(3)
    image = 0.1 + 0.2 * (np.indices((41, 45)).sum(axis=0) % 2) + r.normal(0, 0.003, (41, 45))
    image[20, 20] += 0.5
    image[7, 30] += 0.5
    v, hit = images(cosmic_rays.without_cosmic_rays(pixels_of(spark, {1: image}), 41, 45, mosaic=True, tile=8), 1, image.shape)
    assert hit[20, 20] and hit[7, 30]
    for py in (0, 1):
        for px in (0, 1):
            a, want = whole(image[py::2, px::2])
            assert (hit[py::2, px::2] == want).all()
            np.testing.assert_allclose(v[py::2, px::2], a, rtol=0, atol=1e-12)


def test_gaps_small_frames_and_empty(spark):
    image, _, _ = sky(7)
    image[30, 30] = np.nan
    v, hit = images(cosmic_rays.without_cosmic_rays(pixels_of(spark, {9: image}), 60, 60, tile=16), 9, image.shape)
    assert np.isnan(v[30, 30]) and not hit[30, 30] and hit[5, 40]
    tiny = pixels_of(spark, {1: np.array([[0.1, 9.0], [0.1, 0.1]])})
    assert not cosmic_rays.without_cosmic_rays(tiny, 2, 2).filter("hit").count()
    nothing = pixels_of(spark, {9: np.full((4, 4), np.nan)})
    assert cosmic_rays.without_cosmic_rays(nothing, 4, 4).filter("v IS NULL AND NOT hit").count() == 16
    assert cosmic_rays.without_cosmic_rays(tiny.limit(0), 2, 2).count() == 0
