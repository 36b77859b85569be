"""Operators on pixel tables (frame, y, x, v): projections, calibration, stencils, tiles.

Stencils send each pixel to the places that need it (a narrow explode) and sum there with partial aggregation, so a pixel
is shuffled a bounded number of times, whatever the size of a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import imaging, robust
from ..sources.shared import stored
from .levels import medians

KEYS = ("frame", "y", "x")


def midtones(x: Column, m: Column) -> Column:
    """Midtones transfer function: 0 and 1 outside, m goes to a half."""
    inner = (m - 1) * x / ((2 * m - 1) * x - m)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def auto_stretch(pixels: DataFrame, k: float = 1.5, target: float = 0.2) -> DataFrame:
    """Black point below the median by ``k`` deviations, then midtones that bring the median to ``target``."""
    levels = stored(medians(pixels, ["frame"], "v", "m"))
    off = pixels.join(levels, "frame").withColumn("off", F.abs(F.col("v") - F.col("m")))
    levels = medians(off, ["frame", "m"], "off", "mad").withColumn("d", F.col("mad") * robust.MAD_TO_SIGMA)
    levels = levels.withColumn("black", clamp(F.col("m") - k * F.col("d")))
    rescaled = clamp((F.col("m") - F.col("black")) / (1 - F.col("black")))
    levels = levels.withColumn("mid", clamp(midtones(rescaled, F.lit(target)), 1e-4, 1 - 1e-4))
    # a row for each frame
    lit = pixels.join(F.broadcast(levels), "frame")
    return lit.select(*KEYS, midtones((F.col("v") - F.col("black")) / (1 - F.col("black")), F.col("mid")).alias("v"))


def auto_asinh(pixels: DataFrame, target: float = 0.2) -> DataFrame:
    """Asinh stretch with the softening that brings each frame's median to ``target``."""
    levels = medians(pixels, ["frame"], "v", "m")
    levels = levels.select("frame", imaging.auto_asinh_beta(F.col("m"), target).alias("beta"))
    lit = pixels.join(F.broadcast(levels), "frame")  # a row for each frame
    return lit.select(*KEYS, clamp(F.asinh(F.col("v") / F.col("beta")) / F.asinh(1 / F.col("beta"))).alias("v"))


def combine_channels(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """(y, x, v): mean over the frames, weighted by the inverse square of the median of their tiles' positive noise."""
    noise = tiles.filter("sigma > 0").groupBy("frame").agg(F.median("sigma").alias("sigma"))
    weights = noise.select("frame", (1 / (F.col("sigma") * F.col("sigma"))).alias("w"))  # a row for each frame
    lit = pixels.join(F.broadcast(weights), "frame")
    return lit.groupBy("y", "x").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def asinh_stretch(x: Column, beta: float) -> Column:
    return clamp(F.asinh(x / beta) / F.asinh(F.lit(1.0 / beta)))


def neutral_green(r: Column, g: Column, b: Column) -> Column:
    """Average neutral: green at most the mean of red and blue."""
    return F.least(g, (r + b) / 2)


def masked_green(r: Column, g: Column, b: Column, amount: float = 0.5) -> Column:
    """Additive mask: green is kept where red and blue are bright."""
    mask = F.least(r + b, F.lit(1.0))
    return g * (1 - amount) * (1 - mask) + mask * g


def calibrate(light: DataFrame, dark: DataFrame, flat: DataFrame) -> DataFrame:
    """(light - dark) / flat, the flat normalised by its mean and at least 0.1; a missing dark counts 0, a missing flat 1."""
    level = flat.groupBy().agg(F.avg("v").alias("level"))
    flat = flat.crossJoin(F.broadcast(level)).select("y", "x", F.greatest(F.col("v") / F.col("level"), F.lit(0.1)).alias("f"))  # one row
    dark = dark.select("y", "x", F.col("v").alias("d"))
    joined = light.join(dark, ["y", "x"], "left").join(flat, ["y", "x"], "left")
    return joined.select(*KEYS, ((F.col("v") - F.coalesce("d", F.lit(0.0))) / F.coalesce("f", F.lit(1.0))).alias("v"))


def spread(pixels: DataFrame, offsets: list[tuple[int, int, float]]) -> DataFrame:
    """(frame, y, x, v, k): each pixel at all places that an offset (dy, dx, k) leads to."""
    places = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(k)).alias("k")) for dy, dx, k in offsets))
    return pixels.withColumn("o", F.explode(places)).select(
        "frame", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "v", F.col("o.k").alias("k")
    )


def median_3x3(pixels: DataFrame) -> DataFrame:
    """Median of a pixel and its neighbours; fewer at the borders."""
    near = spread(pixels, [(dy, dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    found = near.groupBy(*KEYS).agg(F.median("v").alias("v"))
    return found.join(pixels.select(*KEYS), list(KEYS), "left_semi")


def convolve(pixels: DataFrame, kernel: list[tuple[int, int, float]]) -> DataFrame:
    """Weighted mean over the kernel's places that lie on the frame."""
    found = spread(pixels, kernel).groupBy(*KEYS).agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("v"))
    return found.join(pixels.select(*KEYS), list(KEYS), "left_semi")


def wavelet_plane(pixels: DataFrame, step: int, height: int, width: int) -> DataFrame:
    """B3 spline smoothing with holes of ``step``, along both axes, mirrored at the borders; and the detail it takes away."""

    def mirrored(place: Column, n: int) -> Column:
        period = 2 * (n - 1)
        p = F.pmod(place, F.lit(period))
        return F.when(p >= n, period - p).otherwise(p).cast("int")

    def smooth(df: DataFrame, axis: str, n: int) -> DataFrame:
        # the mirror is its own inverse, so each target asks for its five sources
        taps = F.array(*(F.struct(F.lit(d * step).alias("d"), F.lit(k / 16.0).alias("k")) for d, k in ((-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))))
        asked = df.select(*KEYS, F.explode(taps).alias("t")).withColumn("from", mirrored(F.col(axis) + F.col("t.d"), n))
        other = "x" if axis == "y" else "y"
        source = df.select("frame", other, F.col(axis).alias("from"), F.col("s").alias("sv"))
        return asked.join(source, ["frame", other, "from"]).groupBy(*KEYS).agg(F.sum(F.col("sv") * F.col("t.k")).alias("s"))

    smooth_v = smooth(smooth(pixels.select(*KEYS, F.col("v").alias("s")), "x", width), "y", height)
    return pixels.join(smooth_v, list(KEYS)).select(*KEYS, F.col("s").alias("smooth"), (F.col("v") - F.col("s")).alias("detail"))


def tile_background(pixels: DataFrame, tile: int) -> DataFrame:
    """Per tile: clipped median and sigma, and the sky: 2.5 median - 1.5 mean unless mean and median lie far apart."""
    tiles = pixels.groupBy("frame", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"))
    stats = tiles.agg(F.array_sort(F.collect_list("v")).alias("a")).withColumn("s", robust.clipped_stats(F.col("a")))
    m, d, mean = (F.col(f"s.{c}") for c in ("median", "sigma", "mean"))
    sky = F.when(F.abs(mean - m) < 0.3 * d, 2.5 * m - 1.5 * mean).otherwise(m)
    return stats.select("frame", "ty", "tx", sky.alias("sky"), d.alias("sigma"))


def smoothed_tiles(tiles: DataFrame) -> DataFrame:
    """Sky and noise of each tile as the medians of its 3x3 neighbourhood, smaller at the edges; frames with fewer than
    three tiles on an axis stay as they are."""
    few = tiles.groupBy("frame").agg((F.least(F.max("ty") - F.min("ty"), F.max("tx") - F.min("tx")) < 2).alias("few"))
    for c in ("sky", "sigma"):
        near = median_3x3(tiles.select("frame", F.col("ty").alias("y"), F.col("tx").alias("x"), F.col(c).alias("v")))
        near = near.select("frame", F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("v").alias(f"near_{c}"))
        tiles = tiles.join(near, ["frame", "ty", "tx"])
    best = lambda c: F.when(F.col("few"), F.col(c)).otherwise(F.col(f"near_{c}")).alias(c)
    return tiles.join(F.broadcast(few), "frame").select("frame", "ty", "tx", best("sky"), best("sigma"))  # a row a frame


#: Share of the typical noise, and the least noise at all.
FLOOR_SHARE, LEAST_NOISE = 1e-4, 1e-12


def noise_floor(tiles: DataFrame) -> DataFrame:
    """(frame, floor): a small share of the median of the tiles' positive noise, or of their sky where no tile has any."""
    levels = tiles.groupBy("frame").agg(F.median(F.when(F.col("sigma") > 0, F.col("sigma"))).alias("noise"), F.median(F.abs("sky")).alias("sky"))
    return levels.select("frame", F.greatest(FLOOR_SHARE * F.coalesce("noise", "sky"), F.lit(LEAST_NOISE)).alias("floor"))


def matched_filter(pixels: DataFrame, tiles: DataFrame, tile: int, kernel: list[tuple[int, int, float]], k: float) -> DataFrame:
    """(frame, y, x, v): the kernel's response to what lies above the tiles' sky, brought to the noise of one pixel, where
    it is more than ``k`` times the tile's noise."""
    placed = pixels.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    lit = placed.join(tiles, ["frame", "ty", "tx"])
    norm = sum(w * w for _, _, w in kernel) ** 0.5
    answer = spread(lit.select(*KEYS, (F.col("v") - F.col("sky")).alias("v")), kernel).groupBy(*KEYS).agg((F.sum(F.col("v") * F.col("k")) / norm).alias("f"))
    return lit.join(answer, list(KEYS)).filter(F.col("f") > k * F.col("sigma")).select(*KEYS, F.col("f").alias("v"))


def above_background(pixels: DataFrame, tiles: DataFrame, tile: int, k: float, floor: float = 1e-6) -> DataFrame:
    """Pixels more than ``k`` times the noise above their tile's sky."""
    placed = pixels.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    lit = placed.join(tiles, ["frame", "ty", "tx"])
    return lit.filter(F.col("v") > F.col("sky") + k * F.greatest(F.col("sigma"), F.lit(floor))).select(*KEYS, "v")


def tile_histogram(pixels: DataFrame, tile: int, bins: int = 256) -> DataFrame:
    """(frame, ty, tx, bin, n, share): histogram of each tile and its cumulative share."""
    bin_ = F.least(F.greatest(F.floor(F.col("v") * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
    counts = pixels.groupBy("frame", F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), bin_)
    counts = counts.agg(F.count("*").alias("n"))
    of_tile = Window.partitionBy("frame", "ty", "tx")  # at most ``bins`` rows
    below = of_tile.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("frame", "ty", "tx", "bin", "n", (F.sum("n").over(below) / F.sum("n").over(of_tile)).alias("share"))


#: Fixed value: bins of a local histogram.
BINS = 256


def tile_curves(pixels: DataFrame, tile_h: int, tile_w: int, clip: float) -> DataFrame:
    """(frame, ty, tx, curve): for each tile the share of its pixels up to each of ``BINS`` bins, after no bin kept more than
    ``clip`` times an even share and what was taken away was dealt out evenly, the rest to the first bins."""
    bin_ = F.round(clamp(F.col("v")) * (BINS - 1)).cast("int").alias("bin")
    place = (F.floor(F.col("y") / tile_h).cast("int").alias("ty"), F.floor(F.col("x") / tile_w).cast("int").alias("tx"))
    counts = pixels.groupBy("frame", *place, bin_).agg(F.count("*").alias("n"))
    of_tile = counts.groupBy("frame", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"), F.sum("n").alias("n"))
    most = F.greatest(F.floor(F.lit(clip) * F.col("n") / BINS), F.lit(1))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    clipped = F.transform(bins, lambda b: F.least(F.coalesce(F.try_element_at("held", b), F.lit(0)), F.col("most")))
    cut = of_tile.withColumn("most", most).withColumn("kept", clipped)
    total = F.aggregate("kept", F.lit(0).cast("long"), lambda a, c: a + c)
    cut = cut.withColumn("spare", F.col("n") - total)
    upto = lambda b: F.aggregate(F.slice("kept", 1, b + 1), F.lit(0).cast("long"), lambda a, c: a + c)
    dealt = lambda b: F.floor(F.col("spare") / BINS) * (b + 1) + F.least(b + 1, F.col("spare") % BINS)
    return cut.select("frame", "ty", "tx", F.transform(bins, lambda b: (upto(b) + dealt(b)) / F.col("n")).alias("curve"))


def local_contrast(pixels: DataFrame, height: int, width: int, tiles: int = 8, clip: float = 3.0, strength: float = 1.0) -> DataFrame:
    """Contrast-limited adaptive equalisation: each pixel goes through the curves of the four tiles whose middles are nearest,
    blended by distance, and then by ``strength`` with itself. There are as many tiles along each side as ``tiles``, fewer if a
    tile would have less than four pixels a bin. Tiles without pixels leave values as they are."""
    n = min(tiles, max(int((height * width / (4 * BINS)) ** 0.5), 1))
    tile_h, tile_w = -(-height // n), -(-width // n)
    curves = stored(tile_curves(pixels, tile_h, tile_w, clip))
    bin_ = F.round(clamp(F.col("v")) * (BINS - 1)).cast("int")
    middle = lambda c, size: clamp((F.col(c) + 0.5) / size - 0.5, 0.0, n - 1.0)
    at = pixels.select(*KEYS, "v", bin_.alias("bin"), middle("y", tile_h).alias("gy"), middle("x", tile_w).alias("gx"))
    at = at.withColumns({"y0": F.floor("gy").cast("int"), "x0": F.floor("gx").cast("int")})
    for k, (dy, dx) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)]):
        # a row for each tile; Spark broadcasts them or not by their size
        own = curves.select("frame", F.col("ty").alias("_y"), F.col("tx").alias("_x"), F.col("curve").alias(f"_{k}"))
        at = at.withColumns({"_y": F.least(F.col("y0") + dy, F.lit(n - 1)), "_x": F.least(F.col("x0") + dx, F.lit(n - 1))})
        at = at.join(own, ["frame", "_y", "_x"], "left").withColumn(f"m{k}", F.coalesce(F.get(f"_{k}", F.col("bin")), F.col("bin") / (BINS - 1.0))).drop("_y", "_x", f"_{k}")
    fy, fx = F.col("gy") - F.col("y0"), F.col("gx") - F.col("x0")
    top, bottom = F.col("m0") + fx * (F.col("m1") - F.col("m0")), F.col("m2") + fx * (F.col("m3") - F.col("m2"))
    mapped = top + fy * (bottom - top)
    return at.select(*KEYS, (F.col("v") + strength * (mapped - F.col("v"))).alias("v"))


def neutralised(pixels: DataFrame, kappa: float = 2.5, passes: int = 5) -> DataFrame:
    """Each frame shifted so that its clipped median is the least of all frames'. Clipping is by aggregates, pass by pass,
    so that no frame is gathered."""
    pixels = stored(pixels)
    bounds = pixels.select("frame").distinct().withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
    for _ in range(passes):
        inside = pixels.join(bounds.drop("m"), "frame").filter(F.col("v").between(F.col("low"), F.col("high")))
        centre = stored(medians(inside, ["frame", "low", "high"], "v", "m"))
        off = pixels.join(centre, "frame").filter(F.col("v").between(F.col("low"), F.col("high")))
        off = medians(off.withColumn("off", F.abs(F.col("v") - F.col("m"))), ["frame", "m", "low", "high"], "off", "mad")
        d = F.col("mad") * robust.MAD_TO_SIGMA * kappa
        # a row for each frame, written once for its two uses in the next pass
        bounds = stored(off.select("frame", "m", F.greatest("low", F.col("m") - d).alias("low"), F.least("high", F.col("m") + d).alias("high")))
    least = bounds.groupBy().agg(F.min("m").alias("least"))
    shift = bounds.crossJoin(F.broadcast(least)).select("frame", (F.col("least") - F.col("m")).alias("shift"))  # one row
    return pixels.join(F.broadcast(shift), "frame").select(*KEYS, (F.col("v") + F.col("shift")).alias("v"))


def warp_bilinear(pixels: DataFrame, m: list[float], height: int, width: int, border: float = 0.0) -> DataFrame:
    """Each output pixel reads the source place that the affine ``m`` (rows of three) maps it to; outside half a pixel
    around the frame it gets ``border``."""
    fx = m[0] * F.col("x") + m[1] * F.col("y") + m[2]
    fy = m[3] * F.col("x") + m[4] * F.col("y") + m[5]
    out = pixels.select(*KEYS, fx.alias("sx"), fy.alias("sy"))
    inside = F.col("sx").between(-0.5, width - 0.5) & F.col("sy").between(-0.5, height - 0.5)
    cx, cy = clamp(F.col("sx"), 0.0, width - 1.0), clamp(F.col("sy"), 0.0, height - 1.0)
    corner = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)))
    asked = out.filter(inside).withColumns({"cx": cx, "cy": cy}).withColumn("c", F.explode(corner))
    weight = lambda p, d: F.when(F.col(f"c.{d}") == 1, p - F.floor(p)).otherwise(1 - (p - F.floor(p)))
    asked = asked.withColumn("k", weight(F.col("cx"), "dx") * weight(F.col("cy"), "dy")).filter("k > 0")
    asked = asked.select(*KEYS, "k", (F.floor("cy") + F.col("c.dy")).cast("int").alias("py"), (F.floor("cx") + F.col("c.dx")).cast("int").alias("px"))
    source = pixels.select("frame", F.col("y").alias("py"), F.col("x").alias("px"), "v")
    found = asked.join(source, ["frame", "py", "px"]).groupBy(*KEYS).agg(F.sum(F.col("v") * F.col("k")).alias("v"))
    return pixels.select(*KEYS).join(found, list(KEYS), "left").select(*KEYS, F.coalesce("v", F.lit(border)).alias("v"))


def drizzle(pixels: DataFrame, dx: float, dy: float, scale: float = 2.0, drop: float = 0.8) -> DataFrame:
    """Square drops of side ``drop * scale`` on a grid ``scale`` times as fine, after a shift; shared by overlap of areas."""
    half = drop * scale / 2
    placed = pixels.select("v", ((F.col("x") + dx + 0.5) * scale - 0.5).alias("cx"), ((F.col("y") + dy + 0.5) * scale - 0.5).alias("cy"))
    reach = lambda c: F.sequence(F.floor(F.col(c) - half + 0.5).cast("int"), F.floor(F.col(c) + half + 0.5).cast("int"))
    cells = placed.withColumn("oy", F.explode(reach("cy"))).withColumn("ox", F.explode(reach("cx")))
    overlap = lambda c, o: F.greatest(F.least(F.col(c) + half, F.col(o) + 0.5) - F.greatest(F.col(c) - half, F.col(o) - 0.5), F.lit(0.0))
    cells = cells.withColumn("w", overlap("cx", "ox") * overlap("cy", "oy") / (4 * half * half)).filter("w > 0")
    return cells.groupBy("oy", "ox").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"), F.sum("w").alias("weight"))
