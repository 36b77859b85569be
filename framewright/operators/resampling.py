"""Warps by nearest, bilinear, bicubic and windowed sinc kernels, with coverage and noise gain of each output pixel.

Source pixels are gathered by square tiles with a border as wide as the kernel, so each is shuffled once, or a few times near
a tile's edge, whatever the kernel's size; output pixels go to the tile that holds their source place. A tile and the output
pixels that fall on it are one bounded group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import KEYS

TILE = 64
#: Kernels and how many pixels they reach to each side.
KERNELS = {"nearest": 1, "bilinear": 1, "bicubic": 2, "lanczos2": 2, "lanczos3": 3, "lanczos4": 4}
#: The cubic's slope at one, steps of a tabulated sinc's distance, and a sum of weights that counts as none.
SLOPE, LUT_STEPS, NO_WEIGHT = -0.5, 4096, 1e-10


def weights(kernel: str, f: np.ndarray) -> np.ndarray:
    """(place, tap): a kernel's weights of the pixels around a place, ``f`` after the one in the middle."""
    a = KERNELS[kernel]
    d = np.abs(f[:, None] - (np.arange(2 * a) - a + 1))
    if kernel == "nearest":
        return np.stack([f < 0.5, f >= 0.5], 1).astype(float)
    if kernel == "bilinear":
        return 1 - d
    if kernel == "bicubic":
        near = ((SLOPE + 2) * d - (SLOPE + 3)) * d * d + 1
        far = ((SLOPE * d - 5 * SLOPE) * d + 8 * SLOPE) * d - 4 * SLOPE
        return np.where(d <= 1, near, np.where(d < 2, far, 0.0))
    d = np.floor(d * LUT_STEPS + 0.5) / LUT_STEPS
    return np.where(d < a, np.sinc(d) * np.sinc(d / a), 0.0)


def sampled(tile: np.ndarray, y: np.ndarray, x: np.ndarray, kernel: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, coverage, noise gain) of a tile, NaN where it has no pixel, at places inside it. Taps without a pixel fall away
    and the others count for more; a sinc that lacks any gives way to the bilinear kernel. Coverage is the share of the
    weights that met a pixel, noise gain the variance of the value for pixels of variance one."""
    a = KERNELS[kernel]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    wy, wx = weights(kernel, y - y0), weights(kernel, x - x0)
    total, held, every, squares = (np.zeros(len(y)) for _ in range(4))
    for j in range(2 * a):
        for i in range(2 * a):
            py, px = y0 - a + 1 + j, x0 - a + 1 + i
            inside = (py >= 0) & (py < tile.shape[0]) & (px >= 0) & (px < tile.shape[1])
            v = np.where(inside, tile[np.clip(py, 0, tile.shape[0] - 1), np.clip(px, 0, tile.shape[1] - 1)], np.nan)
            w = wy[:, j] * wx[:, i]
            there = ~np.isnan(v)
            total += np.where(there, w * np.nan_to_num(v), 0.0)
            held += np.where(there, w, 0.0)
            squares += np.where(there, w * w, 0.0)
            every += np.where(there | (w == 0), 0.0, np.abs(w))
    with np.errstate(all="ignore"):
        value = np.where(np.abs(held) < NO_WEIGHT, np.nan, total / held)
        gain = np.where(np.abs(held) < NO_WEIGHT, np.nan, squares / (held * held))
        whole = every == 0
        covered = np.where(whole, 1.0, np.clip(held, 0, 1))
    if kernel.startswith("lanczos"):
        short = ~whole
        if short.any():
            value[short], covered[short], gain[short] = sampled(tile, y[short], x[short], "bilinear")
    return value, covered, gain


def warped(pixels: DataFrame, m: list[float], height: int, width: int, kernel: str = "lanczos3", border: float = 0.0) -> DataFrame:
    """(frame, y, x, v, coverage, noise_gain): each place of the frame reads the source place that the projective ``m`` (nine
    numbers, rows first, or the six of an affine one) takes it to. Outside half a pixel around the frame, and where no
    tap meets a pixel, it gets ``border`` with a coverage and gain of zero."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel}")
    m = [*m, 0.0, 0.0, 1.0][:9]
    reach = KERNELS[kernel] + 1
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    w = m[6] * x + m[7] * y + m[8]
    to = pixels.select(*KEYS, F.try_divide(m[0] * x + m[1] * y + m[2], w).alias("sx"), F.try_divide(m[3] * x + m[4] * y + m[5], w).alias("sy"))
    inside = F.col("sx").between(-0.5, width - 0.5) & F.col("sy").between(-0.5, height - 0.5)
    held = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(n - 1.0))
    # a sinc or a cubic is not moved into the frame, the others are
    if kernel in ("nearest", "bilinear"):
        to = to.filter(inside).withColumns({"sx": held("sx", width), "sy": held("sy", height)})
    else:
        to = to.filter(inside)
    tile = lambda c, n: F.floor(held(c, n) / TILE).cast("int")
    asked = to.select("frame", tile("sy", height).alias("ty"), tile("sx", width).alias("tx"), "y", "x", "sy", "sx")
    tiles = lambda c, name: F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + d) / TILE).cast("int") for d in (-reach, 0, reach))))).alias(name)
    source = pixels.select(*KEYS, "v", tiles("y", "_ty")).select(*KEYS, "v", "_ty", tiles("x", "_tx"))
    source = source.select(F.col("frame").alias("_frame"), "_ty", "_tx", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").cast("double").alias("_v"))
    frame = dict(pixels.dtypes)["frame"]

    def run(wanted: pa.Table, found: pa.Table) -> pa.Table:
        if not len(wanted):
            return wanted.select(["frame", "y", "x"]).append_column("v", pa.array([], pa.float64())).append_column("coverage", pa.array([], pa.float64())).append_column("noise_gain", pa.array([], pa.float64()))
        top, left = (wanted[c][0].as_py() * TILE - reach for c in ("ty", "tx"))
        grid = np.full((TILE + 2 * reach, TILE + 2 * reach), np.nan)
        if len(found):
            grid[found["_y"].to_numpy() - top, found["_x"].to_numpy() - left] = found["_v"].to_numpy()
        value, coverage, gain = sampled(grid, wanted["sy"].to_numpy() - top, wanted["sx"].to_numpy() - left, kernel)
        lost = np.isnan(value)
        columns = [wanted["frame"], wanted["y"], wanted["x"], pa.array(np.where(lost, border, value)), pa.array(np.where(lost, 0.0, coverage)), pa.array(np.where(lost, 0.0, gain))]
        return pa.table(columns, ["frame", "y", "x", "v", "coverage", "noise_gain"])

    out = asked.groupBy("frame", "ty", "tx").cogroup(source.groupBy("_frame", "_ty", "_tx"))
    read = out.applyInArrow(run, f"frame {frame}, y int, x int, v double, coverage double, noise_gain double")
    full = pixels.select(*KEYS).join(read, list(KEYS), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return full.select(*KEYS, F.coalesce("v", F.lit(border)).alias("v"), zero("coverage"), zero("noise_gain"))
