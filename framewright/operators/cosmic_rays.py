"""Cosmic ray hits found by their sharp edges (Laplacian against noise and fine structure) and painted over.

Frames go in tiles with a border as wide as one round looks, so a task holds one tile whatever the size of a frame. The
tiles' borders are exchanged anew after each round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import robust
from ..sources.shared import stored
from .levels import medians
from .raster import KEYS

#: How far a round looks: medians of 5 x 5 of medians of 5 x 5 (4), the ring around a hit (1), the median painted over it (2).
BORDER = 7
#: The least fine structure in deviations of the noise, and the deviation of rounding to whole steps.
FINE_FLOOR, ROUNDING = 0.01, 0.28867513


def window_median(a: np.ndarray, r: int) -> np.ndarray:
    """Median of the square of side 2 r + 1 around each place, the edge's values repeated beyond it."""
    side = 2 * r + 1
    views = np.lib.stride_tricks.sliding_window_view(np.pad(a, r, mode="edge"), (side, side))
    return np.median(views.reshape(*a.shape, side * side), axis=2)


def rising_edges(a: np.ndarray) -> np.ndarray:
    """Laplacian of the frame at twice its resolution, negative values cut, averaged back."""
    p = np.pad(a, 1, mode="edge")
    rows, columns = (p[:-2, 1:-1], p[2:, 1:-1]), (p[1:-1, :-2], p[1:-1, 2:])
    return sum(np.maximum(2 * a - r - c, 0) for r in rows for c in columns) / 4


def noise_of(smooth: np.ndarray, level: float, sigma: float, camera: tuple[float, float, float] | None) -> np.ndarray:
    """Noise by place. ``camera`` (gain, read noise, full scale): photon and read noise; without one, the frame's deviation,
    growing with the signal above its level."""
    if camera:
        gain, read_noise, full = camera
        return np.maximum(np.sqrt(gain * np.maximum(smooth, 0) * full + read_noise**2) / (gain * full), ROUNDING / full)
    return np.sqrt(sigma**2 + np.maximum(smooth - level, 0) * sigma**2 / max(level, sigma))


def one_round(a: np.ndarray, hit: np.ndarray, level: float, sigma: float, camera, clip: float, contrast: float, grow: float) -> tuple[np.ndarray, np.ndarray]:
    """The array painted over and all hits, after one more search."""
    small = window_median(a, 1)
    fine = np.maximum(small - window_median(small, 3), 0)
    noise = noise_of(window_median(a, 2), level, sigma, camera)
    sharp = rising_edges(a) / (2 * noise)
    sharp = sharp - window_median(sharp, 2)
    stands_out = ~hit & (sharp > contrast * np.maximum(fine / noise, FINE_FLOOR))
    core = np.pad(stands_out & (sharp > clip), 1)
    ring = np.lib.stride_tricks.sliding_window_view(core, (3, 3)).any(axis=(2, 3))
    hit = hit | core[1:-1, 1:-1] | (ring & stands_out & (sharp > clip * grow))
    y, x = np.nonzero(hit)
    views = np.lib.stride_tricks.sliding_window_view(np.pad(np.where(hit, np.nan, a), 2, mode="edge"), (5, 5))[y, x].reshape(-1, 25)
    known = ~np.isnan(views).all(axis=1)
    a = a.copy()
    a[y[known], x[known]] = np.nanmedian(views[known], axis=1)
    return a, hit


def without_cosmic_rays(
    pixels: DataFrame, height: int, width: int, clip: float = 4.5, contrast: float = 5.0, grow: float = 0.3,
    rounds: int = 4, camera: tuple[float, float, float] | None = None, mosaic: bool = False, tile: int = 256,
) -> DataFrame:
    """(frame, y, x, v, hit): the pixels with hits painted over by the median of what is around them.

    A hit stands ``clip`` deviations of the noise out of its surroundings and ``contrast`` times its fine structure, which
    stars have and hits have not; then ``grow`` * ``clip`` is enough for its neighbours. At most ``rounds`` searches, until one
    finds none. ``mosaic``: the four colours of a 2 x 2 mosaic each as a frame of their own. Frames less than three pixels high
    or wide have no hits. Places without a pixel, or with a null or non-finite value, count as the frame's level and are kept
    as they are. Results don't depend on ``tile``.
    """
    step = 2 if mosaic else 1
    phase = lambda c: F.pmod(F.col(c), F.lit(step)).cast("int")
    part = pixels.select(
        F.struct("frame", phase("y").alias("py"), phase("x").alias("px")).alias("part"),
        F.floor(F.col("y") / step).cast("int").alias("y"),
        F.floor(F.col("x") / step).cast("int").alias("x"),
        F.col("v").cast("double").alias("v"),
        F.lit(False).alias("hit"),
    )
    size = lambda n, c: F.floor((F.lit(n) - F.col(f"part.{c}") + step - 1) / step).cast("int")
    part = stored(part.withColumns({"h": size(height, "py"), "w": size(width, "px")}))
    frame_type = part.schema["part"].dataType.simpleString()
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))

    def tiles_of(c: str, n: str):
        last = F.floor((F.col(n) - 1) / tile)
        low, high = F.floor((F.col(c) - BORDER) / tile), F.floor((F.col(c) + BORDER) / tile)
        return F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, last).cast("int")))

    def search(batch: pd.DataFrame) -> pd.DataFrame:
        row = batch.iloc[0]
        y0, x0 = max(int(row.ty) * tile - BORDER, 0), max(int(row.tx) * tile - BORDER, 0)
        y1, x1 = min((int(row.ty) + 1) * tile + BORDER, int(row.h)), min((int(row.tx) + 1) * tile + BORDER, int(row.w))
        ys, xs, v = batch.y.to_numpy() - y0, batch.x.to_numpy() - x0, batch.v.to_numpy(dtype=float, na_value=np.nan)
        good = np.isfinite(v)
        a, hit = np.full((y1 - y0, x1 - x0), row.level), np.zeros((y1 - y0, x1 - x0), dtype=bool)
        a[ys[good], xs[good]], hit[ys, xs] = v[good], batch.hit.to_numpy(dtype=bool)
        if row.h >= 3 and row.w >= 3:
            # places without a pixel are neither hits nor painted
            empty = np.ones(a.shape, dtype=bool)
            empty[ys[good], xs[good]] = False
            painted, found = one_round(a, hit, row.level, row.sigma, camera, clip, contrast, grow)
            a, hit = np.where(empty, a, painted), found & ~empty
        own = (batch.y.to_numpy() // tile == row.ty) & (batch.x.to_numpy() // tile == row.tx)
        kept = batch.loc[own, ["part", "y", "x", "h", "w"]].copy()
        kept["v"], kept["was"], kept["hit"] = np.where(good, a[ys, xs], v)[own], batch.hit.to_numpy(dtype=bool)[own], hit[ys, xs][own]
        return kept

    schema = f"part {frame_type}, y int, x int, h int, w int, v double, was boolean, hit boolean"
    for _ in range(rounds):
        levels = medians(part.withColumn("v", finite), ["part"], "v", "level")
        off = part.withColumn("v", finite).join(levels, "part").withColumn("off", F.abs(F.col("v") - F.col("level")))
        levels = medians(off, ["part", "level"], "off", "mad")
        least = F.greatest(F.abs("level") * float(np.finfo(np.float32).eps), F.lit(float(np.finfo(np.float32).tiny)))
        levels = levels.select("part", "level", F.greatest(F.col("mad") * robust.MAD_TO_SIGMA, least).alias("sigma"))
        # a row for each frame; Spark broadcasts them or not by their size
        placed = part.join(levels, "part").withColumn("ty", tiles_of("y", "h")).withColumn("tx", tiles_of("x", "w"))
        # frames without any finite value have no level and no hits
        rest = part.join(levels, "part", "left_anti").select("part", "y", "x", "h", "w", "v", F.col("hit").alias("was"), "hit")
        searched = stored(placed.groupBy("part", "ty", "tx").applyInPandas(search, schema).unionByName(rest))
        part = searched.drop("was")
        if searched.filter("hit AND NOT was").isEmpty():
            break
    place = lambda c: (F.col(c) * step + F.col(f"part.p{c}")).cast("int").alias(c)
    return part.select(F.col("part.frame").alias("frame"), place("y"), place("x"), "v", "hit")
