"""Frames laid on a finer grid, each by its own affine map, with a choice of drop shapes.

A pixel is sent to the few places its drop meets (a narrow explode) and summed there with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Full width at half maximum of a Gaussian in deviations, and where it is cut off.
WIDTH_IN_SIGMAS, REACH_IN_SIGMAS = 2.3548, 3.0
#: Drops, or sums of taps, smaller than this deposit nothing.
LEAST = 1e-10


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, c: a + c)


def _gaussian(drop: float):
    """Weights by distance; the drop is as wide as the curve at half its height."""
    sigma = drop / WIDTH_IN_SIGMAS
    return -int(-REACH_IN_SIGMAS * sigma // 1), lambda d: F.exp(-d * d / (2 * sigma * sigma))


def _lanczos():
    d3 = lambda d: F.pi() * d / 3.0
    inner = lambda d: F.sin(3.0 * d3(d)) * F.sin(d3(d)) / (3.0 * d3(d) * d3(d))
    return 3, lambda d: F.when(d == 0, 1.0).when(F.abs(d) < 3, inner(d)).otherwise(0.0)


def _clamped(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def shared_area(cells: DataFrame, corners: list[tuple[str, str]], name: str) -> DataFrame:
    """``cells`` with the area that the polygon of ``corners`` (columns, relative to a cell) has in common with the unit square.

    A side adds the signed area of the square below it: the mean of its height, cut to the square, times its stretch along it.
    The steps are columns of their own, so that each is computed once.
    """
    n = len(corners)
    ends = [(*(F.col(c) for c in corners[k]), *(F.col(c) for c in corners[(k + 1) % n])) for k in range(n)]
    steps = {}
    for k, (x1, y1, x2, y2) in enumerate(ends):
        steps |= {f"_p{k}": _clamped(x1), f"_q{k}": _clamped(x2), f"_m{k}": (y2 - y1) / F.when(F.abs(x2 - x1) > 1e-14, x2 - x1)}
    heights = {}
    for k, (x1, y1, _, _) in enumerate(ends):
        heights |= {f"_{h}{k}": y1 + F.col(f"_m{k}") * (F.col(f"_{e}{k}") - x1) for h, e in (("l", "p"), ("h", "q"))}
    under = lambda t: F.when(t <= 0, 0.0).when(t < 1, t * t / 2).otherwise(t - 0.5)
    sides = {}
    for k in range(n):
        low, high = F.col(f"_l{k}"), F.col(f"_h{k}")
        mean = F.when(F.abs(high - low) > 4e-8, (under(high) - under(low)) / (high - low)).otherwise(_clamped((low + high) / 2))
        sides[f"_s{k}"] = F.coalesce((F.col(f"_q{k}") - F.col(f"_p{k}")) * mean, F.lit(0.0))
    total = sum((F.col(f"_s{k}") for k in range(1, n)), F.col("_s0"))
    found = cells.withColumns(steps).withColumns(heights).withColumns(sides).withColumn(name, F.abs(total))
    return found.drop(*steps, *heights, *sides)


def deposits(pixels: DataFrame, transforms: DataFrame, height: int, width: int, kernel: str = "turbo", scale: float = 2.0, drop: float = 0.8) -> DataFrame:
    """(frame, oy, ox, v, w): what each pixel leaves at each place of the finer grid of ``height`` x ``width`` times ``scale``.

    ``transforms`` has for each frame the map a, b, c, d, e, f of (x, y) to (a x + b y + c, d x + e y + f) on the coarse grid.
    ``square``: the drop's mapped outline, shared by area. ``turbo``: an upright square about the mapped centre. ``point``: all
    to the place of the centre. ``gaussian`` and ``lanczos3``: weights by distance, adding up to one over all taps, those
    beyond the grid included; ``lanczos3`` is for ``scale`` and ``drop`` of 1 only. Pixels may have a weight ``w``, frames a
    ``weight``; none, null or 0 deposits nothing, nor does a null or non-finite value or a map without area.
    """
    if kernel not in ("square", "turbo", "point", "gaussian", "lanczos3"):
        raise ValueError(f"no kernel {kernel!r}")
    if kernel == "lanczos3" and (scale != 1 or drop != 1):
        raise ValueError("lanczos3 needs a scale and a drop of 1")
    own = F.col("w").cast("double") if "w" in pixels.columns else F.lit(1.0)
    of_frame = F.col("weight").cast("double") if "weight" in transforms.columns else F.lit(1.0)
    maps = transforms.select("frame", of_frame.alias("_f"), *"abcdef")
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    # a row for each frame; Spark broadcasts it or not by its size
    lit = pixels.select("frame", "y", "x", "v", own.alias("w")).filter(finite).join(maps, "frame").withColumn("w", F.col("w") * F.col("_f"))
    area = F.abs(F.col("a") * F.col("e") - F.col("b") * F.col("d"))
    lit = lit.filter((F.col("w") > 0) & (area >= LEAST))
    at_x = lambda x, y: (F.col("a") * x + F.col("b") * y + F.col("c") + 0.5) * scale - 0.5
    at_y = lambda x, y: (F.col("d") * x + F.col("e") * y + F.col("f") + 0.5) * scale - 0.5
    rows, columns = int(height * scale), int(width * scale)
    placed = lit.withColumns({"cx": at_x(F.col("x"), F.col("y")), "cy": at_y(F.col("x"), F.col("y")), "area": area})
    reach = lambda low, high: F.sequence(F.round(low).cast("int"), F.round(high).cast("int"))
    on_grid = F.col("oy").between(0, rows - 1) & F.col("ox").between(0, columns - 1)
    if kernel == "point":
        cells = placed.withColumns({"oy": F.round("cy").cast("int"), "ox": F.round("cx").cast("int"), "w": F.col("w") / F.col("area")})
    elif kernel == "turbo":
        half = drop * scale / 2
        cells = placed.withColumn("oy", F.explode(reach(F.col("cy") - half, F.col("cy") + half)))
        cells = cells.withColumn("ox", F.explode(reach(F.col("cx") - half, F.col("cx") + half)))
        shared = lambda c, o: F.least(F.col(c) + half, F.col(o) + 0.5) - F.greatest(F.col(c) - half, F.col(o) - 0.5)
        overlap = F.greatest(shared("cx", "ox"), F.lit(0.0)) * F.greatest(shared("cy", "oy"), F.lit(0.0))
        cells = cells.withColumn("w", F.col("w") * overlap / (4 * half * half) / F.col("area"))
    elif kernel == "square":
        half = drop / 2
        turns = [(-half, -half), (half, -half), (half, half), (-half, half)]
        corners = {f"{c}{k}": at(F.col("x") + dx, F.col("y") + dy) for k, (dx, dy) in enumerate(turns) for c, at in (("qx", at_x), ("qy", at_y))}
        placed = placed.withColumns(corners)
        bounds = lambda c: reach(F.least(*(f"{c}{k}" for k in range(4))), F.greatest(*(f"{c}{k}" for k in range(4))))
        cells = placed.withColumn("oy", F.explode(bounds("qy"))).withColumn("ox", F.explode(bounds("qx"))).filter(on_grid)
        for k in range(4):
            cells = cells.withColumns({f"qx{k}": F.col(f"qx{k}") - F.col("ox") + 0.5, f"qy{k}": F.col(f"qy{k}") - F.col("oy") + 0.5})
        cells = shared_area(cells, [(f"qx{k}", f"qy{k}") for k in range(4)], "overlap")
        cells = cells.withColumn("w", F.col("w") * F.col("overlap") / (F.col("area") * (drop * scale) ** 2))
    else:
        far, weight = _gaussian(drop * scale) if kernel == "gaussian" else _lanczos()
        taps = lambda c: F.transform(F.sequence(F.lit(-far), F.lit(far)), lambda i: F.struct((F.round(c) + i).cast("int").alias("o"), weight(F.round(c) + i - F.col(c)).alias("k")))
        cells = placed.withColumns({"ty": taps("cy"), "tx": taps("cx")})
        cells = cells.withColumn("total", _sum(F.transform("ty", lambda t: t["k"])) * _sum(F.transform("tx", lambda t: t["k"]))).filter(F.abs("total") >= LEAST)
        cells = cells.withColumn("ty", F.explode("ty")).withColumn("tx", F.explode("tx"))
        each = F.col("ty.k") * F.col("tx.k") / F.col("total") / F.col("area")
        cells = cells.withColumns({"oy": F.col("ty.o"), "ox": F.col("tx.o"), "w": F.col("w") * each})
    return cells.filter(on_grid).select("frame", "oy", "ox", "v", "w")


def drizzled(
    pixels: DataFrame, transforms: DataFrame, height: int, width: int, kernel: str = "turbo",
    scale: float = 2.0, drop: float = 0.8, gate: float = 0.1, border: float = 0.0,
) -> DataFrame:
    """(y, x, v, weight, noise_gain, coverage) of the places that any drop meets: the mean of the deposits by weight, or
    ``border`` where the weight is below ``gate`` times the highest of all places; the sum of weights, that of their squares
    over its square, and the number of frames. Means by ``lanczos3`` are cut at 0."""
    left = deposits(pixels, transforms, height, width, kernel, scale, drop)
    # no filter here: it would be pushed through the steps above and compute them anew
    w = F.when(F.abs("w") > 1e-12, F.col("w"))
    # by frame first, so that frames are counted by plain sums
    by_frame = left.groupBy("frame", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(
        F.sum(F.col("v") * w).alias("total"), F.sum(w).alias("weight"), F.sum(w * w).alias("squares"), F.count(w).alias("n")
    )
    whole = by_frame.filter("n > 0").groupBy("y", "x").agg(
        F.sum("total").alias("total"), F.sum("weight").alias("weight"), F.sum("squares").alias("squares"), F.count("*").cast("int").alias("coverage")
    )
    sums = stored(whole)
    most = sums.groupBy().agg(F.max("weight").alias("most"))
    mean = F.col("total") / F.col("weight")
    mean = F.greatest(mean, F.lit(0.0)) if kernel == "lanczos3" else mean
    filled = (F.col("weight") >= gate * F.col("most")) & (F.col("weight") > 0)
    gain = F.when(F.col("weight") > 0, F.col("squares") / (F.col("weight") * F.col("weight"))).otherwise(0.0)
    # one row
    return sums.crossJoin(F.broadcast(most)).select("y", "x", F.when(filled, mean).otherwise(border).alias("v"), "weight", gain.alias("noise_gain"), "coverage")
