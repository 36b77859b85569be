"""Distortion of registered frames: polynomials of second and higher order that a linear transform leaves over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robust
from ..sources.shared import stored
from .levels import medians
from .registration import transformed_by

#: Orders, the matches that each coefficient needs, and clipping.
LEAST_ORDER, MOST_ORDER, MATCHES_EACH, CLIP, ROUNDS = 2, 5, 3, 3.0, 3


def terms(order: int) -> list[tuple[int, int]]:
    return [(p, total - p) for total in range(2, order + 1) for p in range(total + 1)]


def _power(c: Column, n: int) -> Column:
    return F.lit(1.0) if n == 0 else c if n == 1 else _power(c, n - 1) * c


def _value(coefficients: str, order: int, x: Column, y: Column) -> Column:
    total = F.lit(0.0)
    for k, (p, q) in enumerate(terms(order)):
        total = total + F.coalesce(F.get(coefficients, F.lit(k)), F.lit(0.0)) * _power(x, p) * _power(y, q)
    return total


def fit_distortion(matches: DataFrame, transforms: DataFrame, order: int = 3) -> DataFrame:
    """(frame, order, n, cx, cy, scale, a, b): for each frame the polynomials by which a left place is moved before the frame's
    affine transform (frame, m) takes it to the right one, over places about (cx, cy) in units of ``scale``, by terms of rising
    order and power of x, from the second order on.

    The order is lowered until each coefficient has ``MATCHES_EACH`` matches; frames with fewer for the second order have none.
    Matches that miss by more than ``CLIP`` deviations don't count in the next fit. Sums of products give the normal
    equations, so matches are never gathered.
    """
    if not LEAST_ORDER <= order <= MOST_ORDER:
        raise ValueError("order must be 2 to 5")
    frame = dict(matches.dtypes)["frame"]
    counts = matches.groupBy("frame").agg(F.count("*").alias("n"), F.avg("rx").alias("cx"), F.avg("ry").alias("cy"))
    off = matches.join(counts, "frame")
    scales = off.groupBy("frame", "n", "cx", "cy").agg(F.max(F.greatest(F.abs(F.col("rx") - F.col("cx")), F.abs(F.col("ry") - F.col("cy")))).alias("scale"))
    fitting = F.lit(None).cast("int")
    for k in range(order, LEAST_ORDER - 1, -1):
        fitting = F.coalesce(fitting, F.when(F.col("n") >= MATCHES_EACH * len(terms(k)), k))
    scales = stored(scales.withColumn("order", fitting).filter("order IS NOT NULL AND scale > 0").drop("n"))
    # what the left place lacks: the right place taken back, less the left place
    m = lambda i: F.get("m", F.lit(i))
    det = m(0) * m(4) - m(1) * m(3)
    dx, dy = F.col("tx") - m(2), F.col("ty") - m(5)
    back_x, back_y = F.try_divide(m(4) * dx - m(1) * dy, det), F.try_divide(m(0) * dy - m(3) * dx, det)
    rows = matches.join(transforms.select("frame", "m"), "frame").join(scales, "frame")
    unit = lambda c, at: (c - F.col(at)) / F.col("scale")
    x, y = unit(F.col("rx"), "cx"), unit(F.col("ry"), "cy")
    rows = stored(rows.select("frame", "order", x.alias("x"), y.alias("y"), ((back_x - F.col("rx")) / F.col("scale")).alias("f"), ((back_y - F.col("ry")) / F.col("scale")).alias("g")).filter("f IS NOT NULL"))
    used = [r["order"] for r in scales.select("order").distinct().collect()]  # four at most
    out = matches.sparkSession.createDataFrame([], f"frame {frame}, n long, a array<double>, b array<double>")
    for k in sorted(used):
        out = out.unionByName(_fits(rows.filter(F.col("order") == k), k, frame))
    return out.join(scales, ["frame"]).select("frame", "order", "n", "cx", "cy", "scale", "a", "b")


def _fits(rows: DataFrame, order: int, frame: str) -> DataFrame:
    own = terms(order)
    powers = [(p, q) for p in range(2 * order + 1) for q in range(2 * order + 1 - p)]
    at = {c: k for k, c in enumerate(powers)}
    normal_at = np.array([[at[s[0] + t[0], s[1] + t[1]] for t in own] for s in own])
    x, y = F.col("x"), F.col("y")
    sums = [F.sum(_power(x, p) * _power(y, q)) for p, q in powers]
    sums += [F.sum(F.col(c) * _power(x, p) * _power(y, q)) for c in ("f", "g") for p, q in own]
    n_powers, n_terms, n_sums = len(powers), len(own), len(sums)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_sums)
            normal = values[:, normal_at]
            good = np.linalg.matrix_rank(normal, hermitian=True) == n_terms
            right = values[:, n_powers:].reshape(-1, 2, n_terms).transpose(0, 2, 1)
            found = np.linalg.solve(normal[good], right[good])
            part = batch.filter(pa.array(good))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * n_terms)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(found[:, :, c]).ravel())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("frame"), part.column("n"), *lists], ["frame", "n", "a", "b"])

    def fitted(df: DataFrame) -> DataFrame:
        return stored(df.groupBy("frame").agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).mapInArrow(solved, f"frame {frame}, n long, a array<double>, b array<double>"))

    fits = fitted(rows)
    for _ in range(ROUNDS):
        missed = F.hypot(F.col("f") - _value("a", order, x, y), F.col("g") - _value("b", order, x, y))
        off = stored(rows.join(fits.select("frame", "a", "b"), "frame").withColumn("miss", missed).drop("a", "b"))
        centre = medians(off, ["frame"], "miss", "m")
        spread = medians(off.join(centre, "frame").withColumn("off", F.abs(F.col("miss") - F.col("m"))), ["frame", "m"], "off", "mad")
        bound = spread.select("frame", (F.col("m") + CLIP * robust.MAD_TO_SIGMA * F.col("mad")).alias("bound"))
        kept = stored(off.join(bound, "frame").filter(F.col("miss") <= F.col("bound") + 1e-15).drop("miss", "bound"))
        fewer = off.groupBy("frame").agg(F.count("*").alias("n")).join(kept.groupBy("frame").agg(F.count("*").alias("k")), "frame")
        moving = stored(fewer.filter((F.col("k") < F.col("n")) & (F.col("k") >= n_terms)).select("frame"))
        if moving.isEmpty():
            break
        rows = stored(kept.join(moving, "frame", "left_semi").unionByName(rows.join(moving, "frame", "left_anti")))
        again = fitted(rows.join(moving, "frame", "left_semi"))
        fits = stored(fits.join(again.select("frame"), "frame", "left_anti").unionByName(again))
    return fits


def undistorted(stars: DataFrame, fits: DataFrame) -> DataFrame:
    """Stars moved by their frame's polynomials; frames without any stay."""
    told = fits.select("frame", "cx", "cy", "scale", F.col("a").alias("_a"), F.col("b").alias("_b"))
    met = stars.join(told, "frame", "left")
    x, y = (F.col("x") - F.col("cx")) / F.col("scale"), (F.col("y") - F.col("cy")) / F.col("scale")
    moved = lambda c, k: F.col(c) + F.coalesce(_value(k, MOST_ORDER, x, y) * F.col("scale"), F.lit(0.0))
    return met.withColumns({"x": moved("x", "_a"), "y": moved("y", "_b")}).drop("cx", "cy", "scale", "_a", "_b")


def predicted(stars: DataFrame, fits: DataFrame, transforms: DataFrame) -> DataFrame:
    """Places on the right side: the polynomials, then the frame's transform."""
    return transformed_by(undistorted(stars, fits), transforms)
