"""Calibration masters of a sensor with a colour mosaic: role frames, flats by colour, hot and cold pixels, their correction.

A mosaic is a periodic pattern of colour numbers (``MONO`` for none). Every step works on pixels by their place: tile medians
gather a tile's pixels, neighbourhoods a bounded number of neighbours, levels by colour come from exact quantiles that
gather no frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robust
from ..functions.imaging import mosaic_colour
from ..sources.shared import stored
from .levels import medians, quantiles
from .raster import KEYS

MONO = [[0]]
#: A flat's least share of its level; a dead pixel's share of its neighbours; width of the dark's tiles; the tail
#: of a normal distribution as a share of its sigma, the pixels from which on it counts, and the least threshold.
LEAST_FLAT, DEAD, TILE = 0.1, 0.5, 64
TAIL, TAIL_TO_SIGMA, TAIL_PIXELS, LEAST_SIGMAS = 0.99, 0.38822448, 500, 1.0
#: Same-coloured neighbours of mosaics of more than two lines, and how far they may lie.
MOSAIC_NEIGHBOURS, MOSAIC_REACH = 24, 6


def colour(pattern: list[list[int]]) -> Column:
    return mosaic_colour(F.col("y"), F.col("x"), pattern).cast("int")


def master_frames(frames: DataFrame) -> DataFrame:
    """(role, y, x, n, v): the median of each role's frames at each pixel; a pixel has one sample for each frame."""
    return frames.groupBy("role", "y", "x").agg(F.count("*").alias("n"), F.median("v").alias("v"))


def prepared_flat(flat: DataFrame, subtractor: DataFrame | None = None, pattern: list[list[int]] = MONO) -> DataFrame:
    """(y, x, v): a flat less its own dark or bias, each colour brought to a mean of one; at least ``LEAST_FLAT``."""
    rows = flat.select("y", "x", F.col("v").cast("double").alias("v"))
    if subtractor is not None:
        rows = rows.join(subtractor.select("y", "x", F.col("v").alias("less")), ["y", "x"], "left")
        rows = rows.select("y", "x", (F.col("v") - F.coalesce("less", F.lit(0.0))).alias("v"))
    rows = rows.withColumn("colour", colour(pattern))
    level = rows.groupBy("colour").agg(F.avg("v").alias("level")).filter("level > 0")
    return rows.join(F.broadcast(level), "colour").select("y", "x", F.greatest(F.col("v") / F.col("level"), F.lit(LEAST_FLAT)).alias("v"))  # a row a colour


def dark_residuals(dark: DataFrame, pattern: list[list[int]] = MONO, tile: int = TILE) -> DataFrame:
    """(frame, y, x, colour, v): a dark less its smooth part, which lies between the medians of each colour in the four tiles
    whose middles are nearest; tiles without the colour don't count."""
    place = lambda c: F.floor(F.col(c) / tile).cast("int")
    rows = dark.select(*KEYS, F.col("v").cast("double").alias("v"), colour(pattern).alias("colour"))
    tiles = stored(rows.groupBy("frame", "colour", place("y").alias("ty"), place("x").alias("tx")).agg(F.median("v").alias("level")))
    ends = tiles.groupBy("frame").agg(F.max("ty").alias("last_y"), F.max("tx").alias("last_x"))
    middle = lambda c, end: F.least(F.greatest((F.col(c) + 0.5) / tile - 0.5, F.lit(0.0)), F.col(end).cast("double"))
    at = rows.join(F.broadcast(ends), "frame").withColumns({"gy": middle("y", "last_y"), "gx": middle("x", "last_x")})  # a row a frame
    corners = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)))
    part = lambda g, d: F.when(F.col(f"c.{d}") == 1, F.col(g) - F.floor(g)).otherwise(1 - F.col(g) + F.floor(g))
    asked = at.withColumn("c", F.explode(corners)).withColumn("w", part("gy", "dy") * part("gx", "dx")).filter("w > 0")
    asked = asked.select(*KEYS, "v", "colour", "w", (F.floor("gy") + F.col("c.dy")).cast("int").alias("ty"), (F.floor("gx") + F.col("c.dx")).cast("int").alias("tx"))
    met = asked.join(tiles, ["frame", "colour", "ty", "tx"]).groupBy(*KEYS, "colour", "v")
    return met.agg((F.sum(F.col("w") * F.col("level")) / F.sum("w")).alias("smooth")).select(*KEYS, "colour", (F.col("v") - F.col("smooth")).alias("v"))


def hot_pixels(dark: DataFrame, sigmas: float = 5.0, pattern: list[list[int]] = MONO, tile: int = TILE, floor: float = 1e-7) -> DataFrame:
    """(frame, y, x, v): pixels whose residual passes their colour's median by ``sigmas`` deviations: the greatest of the median
    absolute deviation, the tail of the residuals where there are enough, and ``floor``."""
    found = stored(dark_residuals(dark, pattern, tile))
    by = ["frame", "colour"]
    centre = stored(medians(found, by, "v", "m"))
    off = found.join(centre, by).withColumn("off", F.abs(F.col("v") - F.col("m")))
    spread = medians(off, by, "off", "mad").join(quantiles(off, by, "off", "tail", TAIL), by).join(found.groupBy(*by).agg(F.count("*").alias("n")), by)
    tail = F.when(F.col("n") >= TAIL_PIXELS, F.col("tail") * TAIL_TO_SIGMA).otherwise(0.0)
    sigma = F.greatest(F.col("mad") * robust.MAD_TO_SIGMA, tail, F.lit(floor))
    bounds = centre.join(spread, by).select(*by, (F.col("m") + max(sigmas, LEAST_SIGMAS) * sigma).alias("bound"))
    return found.join(F.broadcast(bounds), by).filter(F.col("v") > F.col("bound")).select(*KEYS, "v")  # a row a frame and colour


def same_colour_offsets(pattern: list[list[int]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For each place of the pattern the (dy, dx) of its neighbours: the eight around without a mosaic, the eight at two pixels
    with one of two lines, and otherwise the nearest of the same colour."""
    h, w = len(pattern), len(pattern[0])
    if h <= 2 and w <= 2:
        step = max(h, w)
        return {(i, j): [(dy, dx) for dy in (-step, 0, step) for dx in (-step, 0, step) if dy or dx] for i in range(h) for j in range(w)}
    reach = range(-MOSAIC_REACH, MOSAIC_REACH + 1)
    found = {}
    for i in range(h):
        for j in range(w):
            same = [(dy, dx) for dy in reach for dx in reach if (dy or dx) and pattern[(i + dy) % h][(j + dx) % w] == pattern[i][j]]
            found[i, j] = sorted(same, key=lambda o: (o[0] ** 2 + o[1] ** 2, o))[:MOSAIC_NEIGHBOURS]
    return found


def neighbour_medians(targets: DataFrame, pixels: DataFrame, pattern: list[list[int]] = MONO) -> DataFrame:
    """(frame, y, x, near): the median of the same-coloured neighbours of each target that ``pixels`` holds."""
    h, w = len(pattern), len(pattern[0])
    offsets = same_colour_offsets(pattern)
    pair = lambda o: F.struct(F.lit(o[0]).alias("dy"), F.lit(o[1]).alias("dx"))
    by_place = F.array(*(F.array(*map(pair, offsets[i, j])) for i in range(h) for j in range(w)))
    own = F.get(by_place, (F.pmod("y", F.lit(h)) * w + F.pmod("x", F.lit(w))).cast("int"))
    asked = targets.select(*KEYS, F.explode(own).alias("o"))
    asked = asked.select("frame", F.col("y").alias("at_y"), F.col("x").alias("at_x"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    met = asked.join(pixels.select(*KEYS, "v"), list(KEYS)).groupBy("frame", "at_y", "at_x").agg(F.median("v").alias("near"))
    return met.select("frame", F.col("at_y").alias("y"), F.col("at_x").alias("x"), "near")


def cold_pixels(flat: DataFrame, pattern: list[list[int]] = MONO, share: float = DEAD) -> DataFrame:
    """(frame, y, x, v): pixels of a flat below ``share`` of the median of their same-coloured neighbours."""
    near = neighbour_medians(flat, flat, pattern)
    return flat.join(near, list(KEYS)).filter(F.col("v") < share * F.col("near")).select(*KEYS, "v")


def defect_summary(hot: DataFrame, cold: DataFrame, pixels: DataFrame) -> DataFrame:
    """(n_hot, n_cold, n, percentage): defects of a sensor of as many places as ``pixels`` has; a place can be both."""
    count = lambda df, name: df.select("y", "x").distinct().groupBy().agg(F.count("*").alias(name))
    counts = count(hot, "n_hot").crossJoin(count(cold, "n_cold")).crossJoin(count(pixels, "n"))  # a row each
    share = F.when(F.col("n") > 0, 100.0 * (F.col("n_hot") + F.col("n_cold")) / F.col("n")).otherwise(0.0)
    return counts.withColumn("percentage", share)


def corrected(light: DataFrame, defects: DataFrame, pattern: list[list[int]] = MONO) -> DataFrame:
    """(frame, y, x, v): each defect place (y, x) gets the median of its same-coloured neighbours that are no defects; it stays
    as it is without any."""
    places = stored(defects.select("y", "x").distinct().withColumn("bad", F.lit(True)))
    judged = light.select(*KEYS, "v").join(places, ["y", "x"], "left")
    bad, good = judged.filter("bad").select(*KEYS, "v"), judged.filter("bad IS NULL")
    mended = bad.join(neighbour_medians(bad, good, pattern), list(KEYS), "left").select(*KEYS, F.coalesce("near", "v").alias("v"))
    return good.select(*KEYS, "v").unionByName(mended)
