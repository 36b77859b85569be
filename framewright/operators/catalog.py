"""Operators on star catalogues (frame, star, x, y, flux, ...): filters, top-k, neighbour joins, matching, transforms.

A frame's catalogue can be as large as its image allows, so pairs are found by an equi-join on grid cells or among the
brightest N of a frame, never by pairing all stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .levels import medians


def reject_reason(peak: float = 0.95, snr: float = 10.0, sharpness: float = 0.7, fwhm: float = 4.8) -> Column:
    """The first test that a star fails, in order; null if it passes all."""
    return (
        F.when(F.col("peak") > peak, "saturated")
        .when(F.col("snr") < snr, "low_snr")
        .when(F.col("sharpness") > sharpness, "sharp")
        .when(F.col("fwhm") > fwhm, "wide")
    )


def star_cascade(stars: DataFrame, **limits) -> DataFrame:
    """(frame, reason, n): stars by the first test they fail."""
    return stars.groupBy("frame", F.coalesce(reject_reason(**limits), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def brightest(stars: DataFrame, n: int) -> DataFrame:
    """The ``n`` brightest stars of each frame, ties by star: a top-k report."""
    order = Window.partitionBy("frame").orderBy(F.desc("flux"), "star")
    return stars.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def width_outliers(stars: DataFrame, k: float = 3.0) -> DataFrame:
    """Stars not wider than median + k * max(MAD, a tenth of the median), of the frame's brighter half (at least five)."""
    order = Window.partitionBy("frame").orderBy(F.desc("flux"), "star")
    counted = stored(stars.withColumns({"rank": F.row_number().over(order), "many": F.count("*").over(Window.partitionBy("frame"))}))
    half = counted.filter(F.col("rank") <= F.greatest(F.floor(F.col("many") / 2), F.lit(5)))
    off = half.join(medians(half, ["frame"], "fwhm", "m"), "frame").withColumn("off", F.abs(F.col("fwhm") - F.col("m")))
    levels = medians(off, ["frame", "m"], "off", "d")
    bound = F.col("m") + k * F.greatest("d", F.col("m") * 0.1)
    kept = counted.join(levels, "frame").filter((F.col("many") < 5) | (F.col("fwhm") <= bound))
    return kept.select("frame", "star", "fwhm")


def reference(stars: DataFrame) -> DataFrame:
    """The frame with the most stars, the last of them on ties."""
    counts = stars.groupBy("frame").agg(F.count("*").alias("n"))
    return counts.groupBy().agg(F.max(F.struct("n", "frame")).alias("r")).select(F.col("r.frame").alias("frame"), F.col("r.n").alias("n"))


def nearest(stars: DataFrame, k: int = 5, among: int = 50) -> DataFrame:
    """(frame, star, other, rank, distance): k nearest among the brightest of the frame, ties by star."""
    few = brightest(stars, among).select("frame", "star", "x", "y")
    other = few.select("frame", F.col("star").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = few.join(other, "frame").filter("star <> other")  # at most ``among`` squared a frame
    square = (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2
    order = Window.partitionBy("frame", "star").orderBy("d2", "other")
    ranked = pairs.withColumn("d2", square).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("frame", "star", "other", "rank", F.sqrt("d2").alias("distance"))


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(frame, a, b, distance) of pairs at most ``radius`` apart: an equi-join on cells of that side, each left star sent
    to the nine around it."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("int")
    near = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    a = left.select("frame", F.col("star").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(near).alias("n"), cell("x").alias("cx"), cell("y").alias("cy"))
    a = a.withColumns({"cx": F.col("cx") + F.col("n.dx"), "cy": F.col("cy") + F.col("n.dy")}).drop("n")
    b = right.select("frame", F.col("star").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    distance = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    pairs = a.join(b, ["frame", "cx", "cy"]).withColumn("distance", distance)
    return pairs.filter(F.col("distance") <= radius).select("frame", "a", "b", "distance")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of each frame by rising distance (ties by a, b): a pair counts if both stars are free."""
    return greedy(pairs.select("frame", "a", "b", "distance"), F.col("distance").alias("rank"))


def greedy(pairs: DataFrame, rank: Column) -> DataFrame:
    """The pairs (frame, a, b, ...) that stay if each frame's are taken by rising ``rank`` (ties by a, b), each if both its stars
    are free.

    Rounds of mutual first choices give the same matches as going through the pairs one by one, without a frame in one task.
    """
    order = F.struct("rank", "a", "b")
    left, taken = stored(pairs.select("*", rank.alias("rank"))), None
    columns = pairs.columns
    while not left.isEmpty():
        first_a = left.groupBy("frame", "a").agg(F.min(order).alias("p")).select("frame", "a", F.col("p.b").alias("b"))
        first_b = left.groupBy("frame", "b").agg(F.min(order).alias("p")).select("frame", "b", F.col("p.a").alias("a"))
        mutual = stored(left.join(first_a.join(first_b, ["frame", "a", "b"]), ["frame", "a", "b"]).select(*columns))
        taken = mutual if taken is None else taken.unionByName(mutual)
        left = left.join(mutual.select("frame", "a"), ["frame", "a"], "left_anti")
        left = stored(left.join(mutual.select("frame", "b"), ["frame", "b"], "left_anti").select(*columns, "rank"))
    return taken if taken is not None else left.select(*columns)


#: Side of the cells of ``without_duplicates`` in separations, so that stars of one cell are nearer than one and those beyond
#: two cells are not; the number of stars that one task goes through, and of rounds whose stars go into one table.
SIDE, REACH, FEW, MERGE = 0.51, 2, 1 << 16, 16


def without_duplicates(stars: DataFrame, separation: float = 8.0, few: int = FEW) -> DataFrame:
    """By falling flux (ties by star, nulls last) a star stays if no star that stayed is nearer than ``separation``. Stars
    without a place stay.

    Rounds on cells of which at most one star stays: a cell's first star stays if none within reach goes before it, and
    takes the stars near it away. So a round compares each star that is left with the few that stay in reach, however dense
    the stars lie. A chain of neighbours takes a round for each link while more than ``few`` stars are left; those are gone
    through in one task.
    """
    if not separation > 0:
        return stars
    columns = ["frame", "star", "x", "y", "flux"]
    there = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    tested = F.isnan("flux") if dict(stars.dtypes)["flux"] in ("double", "float") else F.lit(False)
    order = F.struct(F.isnull("flux").alias("dark"), (~F.coalesce(tested, F.lit(False))).alias("real"), (-F.col("flux")).alias("dim"), F.isnull("star").alias("unnamed"), "star", "x", "y")
    cell = lambda c: F.rint(F.col(c).cast("double") / (SIDE * separation)).alias(f"c{c}")
    where = ["g", "cx", "cy"]
    # as a struct a null frame is a frame like any other
    placed = stars.filter(there("x") & there("y"))
    left = stored(placed.select(F.struct("frame").alias("g"), cell("x"), cell("y"), order.alias("o"), F.struct(*columns).alias("s")).distinct())
    near = F.array(*(F.struct(F.lit(float(dy)).alias("y"), F.lit(float(dx)).alias("x")) for dy in range(-REACH, REACH + 1) for dx in range(-REACH, REACH + 1)))

    def around(df: DataFrame) -> DataFrame:
        return df.withColumn("n", F.explode(near)).withColumns({"cx": F.col("cx") + F.col("n.x"), "cy": F.col("cy") + F.col("n.y")}).drop("n")

    def close(a: Column, b: Column) -> Column:
        return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) < separation

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple[float, float]] = {}
        for batch in batches:
            x, y = (batch.column("s").field(c).cast(pa.float64()).to_pylist() for c in ("x", "y"))
            places = zip(batch.column("k").to_pylist(), batch.column("cx").to_pylist(), batch.column("cy").to_pylist(), x, y)
            stays = []
            for k, cx, cy, px, py in places:
                cells = ((k, cx + i, cy + j) for j in range(-REACH, REACH + 1) for i in range(-REACH, REACH + 1))
                stays.append(all(sqrt((px - q[0]) * (px - q[0]) + (py - q[1]) * (py - q[1])) >= separation for c in cells if (q := kept.get(c))))
                if stays[-1]:
                    kept[k, cx, cy] = px, py
            yield pa.RecordBatch.from_arrays([batch.column("s").filter(pa.array(stays))], ["s"])

    stay: list[DataFrame] = []
    while left.count() > few:
        first = stored(left.groupBy(*where).agg(F.min(F.struct("o", "s")).alias("f"), F.count("*").alias("many")).select(*where, "many", "f.o", "f.s"))
        rival = around(first.select(*where, F.struct("o", "many").alias("r"))).join(first, where)
        behind = rival.filter((F.col("r.o") < F.col("o")) & ((F.col("r.many") > 1) | close(F.col("r.o"), F.col("o")))).select(*where).distinct()
        firm = stored(first.join(behind, where, "left_anti"))
        stay.append(firm.select("s"))
        if len(stay) > MERGE:
            stay = [stored(reduce(DataFrame.unionByName, stay))]
        by = around(firm.select(*where, F.struct("o.x", "o.y").alias("k"))).groupBy(*where).agg(F.collect_list("k").alias("by"))
        hidden = F.coalesce(F.exists("by", lambda k: close(k, F.col("o"))), F.lit(False))
        left = stored(left.join(by, where, "left").filter(~hidden).select(*where, "o", "s"))
    rest = left.select("*", F.dense_rank().over(Window.orderBy("g")).alias("k")).sortWithinPartitions("k", "o").select("k", "cx", "cy", "s")
    stay.append(rest.mapInArrow(one_by_one, f"s {left.schema['s'].dataType.simpleString()}"))
    kept = stored(reduce(DataFrame.unionByName, stay))
    found = placed.join(kept, F.struct(*(placed[c] for c in columns)) == kept["s"], "left_semi")
    return found.unionByName(stars.filter(~(there("x") & there("y"))))


def rigid(matches: DataFrame) -> DataFrame:
    """Per frame the mean shift, and the turn with its own shift, that take (rx, ry) to (tx, ty)."""
    means = matches.groupBy("frame").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in ("rx", "ry", "tx", "ty")))
    off = lambda c: F.col(c) - F.col(f"m{c}")
    centred = matches.join(F.broadcast(means), "frame")  # a row for each frame
    keys = ("frame", "n", "mrx", "mry", "mtx", "mty")
    turn = F.atan2(F.sum(off("rx") * off("ty") - off("ry") * off("tx")), F.sum(off("rx") * off("tx") + off("ry") * off("ty")))
    found = centred.groupBy(*keys).agg(turn.alias("angle"))
    cos, sin = F.cos("angle"), F.sin("angle")
    return found.select(
        "frame", "n", (F.col("mtx") - F.col("mrx")).alias("shift_x"), (F.col("mty") - F.col("mry")).alias("shift_y"), "angle",
        (F.col("mtx") - (cos * F.col("mrx") - sin * F.col("mry"))).alias("dx"),
        (F.col("mty") - (sin * F.col("mrx") + cos * F.col("mry"))).alias("dy"),
    )


def similarity(matches: DataFrame) -> DataFrame:
    """Per frame the similarity that takes (rx, ry) to (tx, ty): angle and scale of centred sums, then the shift."""
    sums = matches.groupBy("frame").agg(
        F.count("*").alias("n"),
        *(F.avg(c).alias(f"m{c}") for c in ("rx", "ry", "tx", "ty")),
        *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a in ("rx", "ry") for b in ("tx", "ty", "rx", "ry") if (a, b) != ("ry", "rx")),
    )
    n = F.col("n")
    centred = lambda a, b: F.col(a + b) - n * F.col(f"m{a}") * F.col(f"m{b}")
    sxx, sxy, syx, syy = centred("rx", "tx"), centred("rx", "ty"), centred("ry", "tx"), centred("ry", "ty")
    spread = centred("rx", "rx") + centred("ry", "ry")
    found = sums.withColumns({"angle": F.atan2(sxy - syx, sxx + syy), "c": sxx + syy, "s": sxy - syx, "var": spread})
    found = found.withColumn("scale", (F.col("c") * F.cos("angle") + F.col("s") * F.sin("angle")) / F.col("var")).filter("n >= 2 AND scale > 0")
    cos, sin = F.col("scale") * F.cos("angle"), F.col("scale") * F.sin("angle")
    return found.select(
        "frame", "n", "angle", "scale",
        (F.col("mtx") - (cos * F.col("mrx") - sin * F.col("mry"))).alias("dx"),
        (F.col("mty") - (sin * F.col("mrx") + cos * F.col("mry"))).alias("dy"),
    )


def diagnostics(stars: DataFrame, **limits) -> DataFrame:
    """(frame, n, n_kept, width, snr): stars found and kept, and the kept ones' median width and signal."""
    judged = stars.withColumn("kept", reject_reason(**limits).isNull())
    counts = judged.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))
    kept = judged.filter("kept")
    return counts.join(medians(kept, ["frame"], "fwhm", "width"), "frame", "left").join(medians(kept, ["frame"], "snr", "snr"), "frame", "left")


#: Deviations about the median, its least share, and the width where no star tells it.
NEAR, LEAST_SPREAD, WIDTH = 3.0, 0.1, 4.0


def typical_width(stars: DataFrame, **limits) -> DataFrame:
    """(frame, n, width): median width of the stars that pass the tests and lie near the median of these; ``WIDTH`` for a
    frame without any."""
    good = stored(stars.filter(reject_reason(**limits).isNull()).select("frame", "fwhm"))
    levels = medians(good, ["frame"], "fwhm", "m")
    off = good.join(levels, "frame").withColumn("off", F.abs(F.col("fwhm") - F.col("m")))
    spread = medians(off, ["frame"], "off", "d")
    near = off.join(spread, "frame").filter(F.col("off") <= NEAR * F.greatest("d", F.col("m") * LEAST_SPREAD))
    found = near.groupBy("frame").agg(F.count("*").alias("n")).join(medians(near, ["frame"], "fwhm", "width"), "frame")
    frames = stars.select("frame").distinct().join(found, "frame", "left")
    return frames.select("frame", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("width", F.lit(WIDTH)).alias("width"))


def composed(after: list[float], before: list[float]) -> list[float]:
    """The 3x3 transform that applies ``before`` and then ``after``."""
    return [sum(after[3 * i + k] * before[3 * k + j] for k in range(3)) for i in range(3) for j in range(3)]


def inverse(m: list[float]) -> list[float]:
    """The transform that undoes a 3x3 one, by cofactors."""
    at = lambda i, j: m[3 * (i % 3) + j % 3]
    minor = lambda i, j: at(i + 1, j + 1) * at(i + 2, j + 2) - at(i + 1, j + 2) * at(i + 2, j + 1)
    size = sum(at(0, j) * minor(0, j) for j in range(3))
    if abs(size) < 1e-300:
        raise ValueError("the transform has no inverse")
    return [minor(j, i) / size for i in range(3) for j in range(3)]


def transformed(stars: DataFrame, m: list[float]) -> DataFrame:
    """Positions under a projective 3x3 transform, rows first."""
    w = m[6] * F.col("x") + m[7] * F.col("y") + m[8]
    px, py = m[0] * F.col("x") + m[1] * F.col("y") + m[2], m[3] * F.col("x") + m[4] * F.col("y") + m[5]
    return stars.withColumns({"x": px / w, "y": py / w})
