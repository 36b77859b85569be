"""Photometric gains of registered frames from the pixels that all of them have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robust
from ..sources.shared import stored
from .levels import medians

#: Spreads and covariances that count as none, and the deviations within which a pixel fits the first guess.
NO_SPREAD, NO_COVARIANCE, INLIERS = 1.1920929e-7, 2.220446049250313e-16, 4.0


def common_pixels(pixels: DataFrame) -> DataFrame:
    """The pixels of the places at which every frame has a value."""
    rows = pixels.filter("v IS NOT NULL AND NOT isnan(v)")
    frames = rows.select("frame").distinct().groupBy().agg(F.count("*").alias("_all"))
    full = rows.groupBy("y", "x").agg(F.count_distinct("frame").alias("_n")).crossJoin(F.broadcast(frames)).filter("_n = _all")  # one row
    return rows.join(full.select("y", "x"), ["y", "x"])


def _spread(df: DataFrame, value: str, m: str, mad: str) -> DataFrame:
    """(frame, m, mad): exact median and median absolute deviation of a column by frame."""
    centre = medians(df, ["frame"], value, m)
    off = df.join(centre, "frame").withColumn("_off", F.abs(F.col(value) - F.col(m)))
    return stored(medians(off, ["frame", m], "_off", mad))


def deming(n: Column, frame: Column, reference: Column, both: Column, ratio: Column) -> Column:
    """The slope of a line with errors on both sides, from the variances of both and their covariance; ``ratio``: the reference's
    noise variance as a share of the frame's. One where the pixels tell none."""
    delta = reference - ratio * frame
    root = F.sqrt(delta * delta + 4 * ratio * both * both)
    slope = F.when(delta >= 0, F.try_divide(delta + root, 2 * both)).otherwise(F.try_divide(2 * ratio * both, root - delta))
    return F.when((n < 2) | (both <= NO_COVARIANCE) | ~(slope > NO_COVARIANCE), 1.0).otherwise(slope)


def photometric_gains(pixels: DataFrame, reference: int, noise: DataFrame | None = None) -> DataFrame:
    """(frame, n, gain, offset) that bring each frame to the reference: the slope of the common pixels' values, errors on both
    sides, over those within ``INLIERS`` deviations of a first guess by spreads; medians then meet. ``noise``: (frame, variance) of
    the frames' noise, equal if not told."""
    every = stored(common_pixels(pixels).select("frame", "y", "x", F.col("v").cast("double").alias("v")))
    own = every.filter(F.col("frame") == reference).select("y", "x", F.col("v").alias("r"))
    pairs = stored(every.join(own, ["y", "x"]))
    guess = _spread(pairs, "v", "vm", "vd").join(_spread(pairs, "r", "rm", "rd"), "frame")
    guess = stored(guess.withColumn("first", F.when(F.col("vd") > NO_SPREAD, F.try_divide("rd", "vd")).otherwise(1.0)))
    off = F.col("r") - (F.col("v") * F.col("first") + F.col("rm") - F.col("vm") * F.col("first"))
    left = pairs.join(guess, "frame").withColumn("off", off)
    window = _spread(left.select("frame", "off"), "off", "om", "od")
    inside = left.join(window, "frame").filter(F.abs(F.col("off") - F.col("om")) <= INLIERS * robust.MAD_TO_SIGMA * F.col("od"))
    # about the medians, so that nothing is lost in large sums
    v, r = F.col("v") - F.col("vm"), F.col("r") - F.col("rm")
    sums = inside.groupBy("frame").agg(F.count("*").alias("n"), F.avg(v).alias("mv"), F.avg(r).alias("mr"), F.avg(v * v).alias("vv"), F.avg(r * r).alias("rr"), F.avg(v * r).alias("vr"))
    ratio = F.lit(1.0)
    if noise is not None:
        base = noise.filter(F.col("frame") == reference).select(F.col("variance").alias("base"))
        sums = sums.join(noise.select("frame", "variance"), "frame", "left").crossJoin(F.broadcast(base))  # one row
        told = (F.col("variance") > NO_COVARIANCE) & (F.col("base") > NO_COVARIANCE)
        ratio = F.coalesce(F.when(told, F.try_divide("base", "variance")), F.lit(1.0))
    slope = deming(F.col("n"), F.col("vv") - F.col("mv") * F.col("mv"), F.col("rr") - F.col("mr") * F.col("mr"), F.col("vr") - F.col("mv") * F.col("mr"), ratio)
    found = guess.join(window, "frame").join(sums, "frame", "left")
    gain = F.when(F.col("frame") == reference, 1.0).when(F.col("od") <= NO_SPREAD, F.col("first")).otherwise(slope)
    found = found.withColumn("gain", gain)
    return found.select("frame", F.coalesce("n", F.lit(0)).alias("n"), "gain", (F.col("rm") - F.col("vm") * F.col("gain")).alias("offset"))
