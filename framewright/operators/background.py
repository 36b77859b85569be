"""Smooth backgrounds of frames from their tiles: bicubic splines, refinement around masked objects, polynomial surfaces.

A frame's tiles are (frame, ty, tx, sky, sigma), a row for each ``tile`` x ``tile`` pixels. Lines of tiles are as long as a
side of the frame has tiles; each is solved as one row. Pixels meet the coefficients of their cell by an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robust
from ..sources.shared import stored
from .levels import medians
from .raster import KEYS, noise_floor, smoothed_tiles, spread, tile_background


def centres(size: int, tile: int) -> list[float]:
    """The middle pixel of each tile along a side; the last tile may be smaller."""
    return [(a + min(a + tile, size) - 1) / 2 for a in range(0, size, tile)]


def natural_spline(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of natural cubic splines through lines of values (nan-free): zero at both ends, and
    solved between them by one sweep up and one down for all lines at once."""
    n = values.shape[1]
    out = np.zeros_like(values)
    if n < 3:
        return out
    gap = np.diff(at)
    bend = 6 * np.diff(np.diff(values, axis=1) / gap, axis=1)
    share, rest = np.zeros(n - 2), np.zeros((len(values), n - 2))
    for k in range(n - 2):
        size = 2 * (gap[k] + gap[k + 1]) - (gap[k] * share[k - 1] if k else 0.0)
        share[k] = gap[k + 1] / size
        rest[:, k] = (bend[:, k] - (gap[k] * rest[:, k - 1] if k else 0.0)) / size
    for k in range(n - 3, -1, -1):
        out[:, k + 1] = rest[:, k] - share[k] * out[:, k + 2]
    return out


def _bent(tiles: DataFrame, along: str, size: int, tile: int, names: dict[str, str]) -> DataFrame:
    """``tiles`` with, for each value column of ``names``, its spline's second derivatives along an axis under the new name.
    Lines that lack a tile have none."""
    other = "tx" if along == "ty" else "ty"
    at = np.array(centres(size, tile))
    rows = tiles.groupBy("frame", other).agg(F.array_sort(F.collect_list(F.struct(along, *names))).alias("line")).filter(F.size("line") == len(at))
    flat = rows.select("frame", other, *(F.col(f"line.{c}").alias(c) for c in names))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:2])
            for c in names:
                values = batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(at))
                bent = natural_spline(values, at)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(bent) + 1, dtype=np.int32) * len(at)), pa.array(bent.ravel())))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    bent = flat.mapInArrow(run, schema)
    bent = bent.select("frame", other, F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(at) - 1)).alias("_k"), *names)).alias("p"))
    bent = bent.select("frame", other, F.col("p._k").alias(along), *(F.col(f"p.{c}").alias(to) for c, to in names.items()))
    return tiles.join(bent, ["frame", "ty", "tx"])


def spline_planes(pixels: DataFrame, tiles: DataFrame, tile: int, height: int, width: int) -> DataFrame:
    """(frame, y, x, v, sky, noise): pixels with the natural bicubic splines through the tiles' sky and sigma at their middles.
    Beyond the outer middles the value there holds. Pixels of frames that lack a tile are left out."""
    nodes = tiles.select("frame", "ty", "tx", *(F.col(c).cast("double").alias(c) for c in ("sky", "sigma")))
    nodes = _bent(nodes, "ty", height, tile, {"sky": "sky_y", "sigma": "sigma_y"})
    names = {c: f"{c}_x" for c in ("sky", "sigma", "sky_y", "sigma_y")}
    nodes = stored(_bent(nodes, "tx", width, tile, names))
    last_y, last_x = len(centres(height, tile)) - 1, len(centres(width, tile)) - 1
    values = [*names, *names.values()]
    # each node is a corner of the four cells around it; a cell gathers its four
    corner = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    cells = nodes.withColumn("c", F.explode(corner)).withColumns({"cy": F.col("ty") - F.col("c.i"), "cx": F.col("tx") - F.col("c.j")})
    cells = cells.filter((F.col("cy") >= 0) & (F.col("cx") >= 0) & (F.col("cy") <= max(last_y - 1, 0)) & (F.col("cx") <= max(last_x - 1, 0)))
    cells = cells.groupBy("frame", "cy", "cx").agg(F.map_from_entries(F.collect_list(F.struct((F.col("c.i") * 2 + F.col("c.j")).alias("k"), F.struct(*values).alias("node")))).alias("nodes"))

    def placed(c: str, size: int) -> tuple[Column, Column, Column]:
        """(cell, share of the way through it, its length) along an axis."""
        at = centres(size, tile)
        if len(at) == 1:
            return F.lit(0), F.lit(0.0), F.lit(1.0)
        # all gaps but the last one are as long as a tile
        p = F.least(F.greatest(F.col(c).cast("double"), F.lit(at[0])), F.lit(at[-1]))
        cell = F.least(F.floor((p - at[0]) / tile), F.lit(len(at) - 2)).cast("int")
        length = F.when(cell == len(at) - 2, at[-1] - at[-2]).otherwise(float(tile))
        return cell, (p - at[0] - cell * tile) / length, length

    cy, t, h = placed("y", height)
    cx, s, w = placed("x", width)
    rows = pixels.select(*KEYS, "v", cy.alias("cy"), t.alias("t"), h.alias("h"), cx.alias("cx"), s.alias("s"), w.alias("w"))
    met = rows.join(cells, ["frame", "cy", "cx"])

    def along(f0: Column, f1: Column, d0: Column, d1: Column, length: Column, share: Column) -> Column:
        rest = 1 - share
        return rest * f0 + share * f1 + length * length / 6 * ((rest * rest * rest - rest) * d0 + (share * share * share - share) * d1)

    def at(name: str) -> Column:
        node = lambda i, j, c: F.coalesce(F.try_element_at("nodes", F.lit(2 * i + j)), F.try_element_at("nodes", F.lit(2 * i)), F.try_element_at("nodes", F.lit(j)), F.try_element_at("nodes", F.lit(0)))[c]
        line = lambda i, c: along(node(i, 0, c), node(i, 1, c), node(i, 0, f"{c}_x"), node(i, 1, f"{c}_x"), F.col("w"), F.col("s"))
        return along(line(0, name), line(1, name), line(0, f"{name}_y"), line(1, f"{name}_y"), F.col("h"), F.col("t"))

    return met.select(*KEYS, "v", at("sky").alias("sky"), at("sigma").alias("noise"))


def refined_background(pixels: DataFrame, tile: int, height: int, width: int, sigmas: float = 3.0, dilation: int = 1, rounds: int = 2) -> DataFrame:
    """(frame, y, x, v, sky, noise): splines through tiles that leave objects out. In each round the pixels more than ``sigmas``
    noise above the background, and those up to ``dilation`` lines and columns away, are masked and the tiles measured again; a
    tile without pixels left keeps its values. The background that masks goes through medians of 3x3 tiles, so that an object
    does not hide its wings by the sky and noise of its own tile; frames of fewer than three tiles on an axis have no such medians."""
    tiles = stored(tile_background(pixels, tile))
    around = [(dy, dx, 1.0) for dy in range(-dilation, dilation + 1) for dx in range(-dilation, dilation + 1)]
    for _ in range(rounds):
        smooth = stored(smoothed_tiles(tiles))
        lit = spline_planes(pixels, smooth, tile, height, width).join(F.broadcast(noise_floor(smooth)), "frame")  # a row for each frame
        objects = lit.filter(F.col("v") > F.col("sky") + sigmas * F.greatest("noise", "floor"))
        mask = spread(objects.select(*KEYS, "v"), around).select(*KEYS).distinct()
        again = tile_background(pixels.join(mask, list(KEYS), "left_anti"), tile)
        again = again.select("frame", "ty", "tx", F.col("sky").alias("new_sky"), F.col("sigma").alias("new_sigma"))
        merged = tiles.join(again, ["frame", "ty", "tx"], "left")
        tiles = stored(merged.select("frame", "ty", "tx", F.coalesce("new_sky", "sky").alias("sky"), F.coalesce("new_sigma", "sigma").alias("sigma")))
    return spline_planes(pixels, tiles, tile, height, width)


def _terms(degree: int) -> list[tuple[int, int]]:
    return [(i, total - i) for total in range(degree + 1) for i in range(total + 1)]


def _unit(c: Column, size: int) -> Column:
    """Pixel places along a side as -1 to 1."""
    return 2.0 * c / (size - 1.0) - 1.0 if size > 1 else F.lit(0.0)


def _surface(terms: list[tuple[int, int]], x: Column, y: Column) -> Column:
    power = lambda c, n: F.lit(1.0) if n == 0 else c if n == 1 else power(c, n - 1) * c
    total = F.lit(0.0)
    for k, (i, j) in enumerate(terms):
        total = total + F.get("coefficients", F.lit(k)) * power(x, i) * power(y, j)
    return total


def fit_surfaces(tiles: DataFrame, tile: int, height: int, width: int, degree: int = 2, sigmas: float = 3.0, rounds: int = 3) -> DataFrame:
    """(frame, n, coefficients, mean): for each frame the polynomial of the tiles' sky of ``degree`` (1 to 4) over places from -1
    to 1, by terms of rising degree and power of x, and its mean over the frame. Tiles farther than ``sigmas`` deviations from a
    fit don't count in the next one, as long as enough are left. Frames whose tiles fix no such polynomial are left out.

    The normal equations are sums over tiles, so no frame is gathered.
    """
    if not 1 <= degree <= 4:
        raise ValueError("degree must be 1 to 4")
    while (degree + 1) * (degree + 2) // 2 > len(centres(height, tile)) * len(centres(width, tile)):
        degree -= 1
    terms = _terms(degree)
    middle = lambda c, size: F.get(F.array(*(F.lit(v) for v in centres(size, tile))), F.col(c))
    rows = tiles.select("frame", _unit(middle("tx", width), width).alias("x"), _unit(middle("ty", height), height).alias("y"), F.col("sky").cast("double").alias("z"))
    rows = stored(rows.filter("z IS NOT NULL"))
    power = lambda c, n: F.lit(1.0) if n == 0 else F.col(c) if n == 1 else power(c, n - 1) * F.col(c)
    powers = [(i, j) for i in range(2 * degree + 1) for j in range(2 * degree + 1 - i)]
    sums = [F.sum(power("x", i) * power("y", j)) for i, j in powers] + [F.sum(F.col("z") * power("x", i) * power("y", j)) for i, j in terms]
    place, n_sums = {p: k for k, p in enumerate(powers)}, len(sums)
    normal_at = np.array([[place[a[0] + b[0], a[1] + b[1]] for b in terms] for a in terms])
    grid = [[float(np.mean((np.linspace(-1, 1, size) if size > 1 else np.zeros(1)) ** n)) for n in range(degree + 1)] for size in (width, height)]
    means = np.array([grid[0][i] * grid[1][j] for i, j in terms])
    frame = dict(tiles.dtypes)["frame"]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_sums)
            normal, right = values[:, normal_at], values[:, len(powers) :]
            good = np.linalg.matrix_rank(normal, hermitian=True) == len(terms)
            found = np.linalg.solve(normal[good], right[good][:, :, None])[:, :, 0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(terms)), pa.array(found.ravel()))
            part = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([part.column("frame"), part.column("n"), lists, pa.array(found @ means)], ["frame", "n", "coefficients", "mean"])

    def fitted(df: DataFrame) -> DataFrame:
        grouped = df.groupBy("frame").agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))
        return stored(grouped.mapInArrow(solved, f"frame {frame}, n long, coefficients array<double>, mean double"))

    fits = fitted(rows)
    moving = fits.select("frame")
    for _ in range(rounds):
        off = rows.join(moving, "frame", "left_semi").join(fits.select("frame", "coefficients"), "frame")
        off = stored(off.select("frame", "x", "y", "z", (F.col("z") - _surface(terms, F.col("x"), F.col("y"))).alias("r")))
        centre = medians(off, ["frame"], "r", "m")
        spread_ = medians(off.join(centre, "frame").withColumn("off", F.abs(F.col("r") - F.col("m"))), ["frame"], "off", "mad")
        bound = spread_.select("frame", (sigmas * robust.MAD_TO_SIGMA * F.col("mad")).alias("bound")).filter("bound > 0")
        judged = off.join(bound, "frame").withColumn("keep", F.abs("r") <= F.col("bound"))
        counts = judged.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"))
        moving = stored(counts.filter((F.col("kept") < F.col("n")) & (F.col("kept") >= len(terms))).select("frame"))
        if moving.isEmpty():
            break
        left = judged.filter("keep").join(moving, "frame", "left_semi").select("frame", "x", "y", "z")
        rows = stored(left.unionByName(rows.join(moving, "frame", "left_anti")))
        again = fitted(left)
        fits = stored(fits.join(again.select("frame"), "frame", "left_anti").unionByName(again))
    return fits


def surface_removed(pixels: DataFrame, fits: DataFrame, height: int, width: int, divide: bool = False, floor: float = 0.1) -> DataFrame:
    """(frame, y, x, v): pixels less their frame's surface, or divided by it as a share of its mean, at least ``floor``; then a
    frame whose surface has no positive mean stays as it is. Frames without a surface stay, too."""
    met = pixels.join(F.broadcast(fits.select("frame", "coefficients", "mean")), "frame", "left")  # a row for each frame
    degree = 4
    x, y = _unit(F.col("x"), width), _unit(F.col("y"), height)
    # terms that a surface lacks are null and count nothing
    power = lambda c, n: F.lit(1.0) if n == 0 else c if n == 1 else power(c, n - 1) * c
    level = F.lit(0.0)
    for k, (i, j) in enumerate(_terms(degree)):
        level = level + F.coalesce(F.get("coefficients", F.lit(k)), F.lit(0.0)) * power(x, i) * power(y, j)
    if divide:
        share = F.greatest(F.try_divide(level, F.col("mean")), F.lit(floor))
        return met.select(*KEYS, F.when(F.col("mean") > 0, F.col("v") / share).otherwise(F.col("v")).alias("v"))
    return met.select(*KEYS, (F.col("v") - level).alias("v"))
