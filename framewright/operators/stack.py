"""Stacking: one value for each pixel from its samples in many frames.

``samples`` has a pixel key, ``frame``, ``v`` and maybe ``w``. Grouping is one shuffle on the pixel key with partial sums
where the combination allows; rejection needs a pixel's samples together, at most one for each frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robust
from ..sources.shared import stored
from .levels import medians

REJECTIONS = {
    "sigma": robust.sigma_clip,
    "percentile": robust.percentile_clip,
    "linear_fit": robust.linear_fit_clip,
    "winsorized": robust.winsorized_clip,
}


def gathered(samples: DataFrame, key: str = "px", value: str = "v") -> DataFrame:
    """(key, a): a pixel's samples, sorted."""
    return samples.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("a"))


def mean_stack(samples: DataFrame, key: str = "px") -> DataFrame:
    """Weighted mean with partial sums; 0 where all weights are 0; and the quality planes."""
    sums = samples.groupBy(key).agg(F.sum("w").alias("w"), F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.count("*").alias("n"))
    none = F.col("w") == 0
    return sums.select(
        key,
        F.col("n").alias("n_samples"),
        F.when(none, 0.0).otherwise(F.col("vw") / F.when(none, 1.0).otherwise(F.col("w"))).alias("value"),
        F.col("w").alias("weight"),
        F.when(none, 0.0).otherwise(F.col("ww") / F.when(none, 1.0).otherwise(F.col("w") * F.col("w"))).alias("linear_variance"),
    )


def median_stack(samples: DataFrame, key: str = "px") -> DataFrame:
    """Exact median; weights have no part in it."""
    return samples.groupBy(key).agg(F.count("*").alias("n_samples"), F.median("v").alias("value"))


def rejected_stack(samples: DataFrame, rejection: str, key: str = "px", **options) -> DataFrame:
    """Mean of the samples that a rejection leaves, with their number."""
    kept = gathered(samples, key).select(key, F.size("a").alias("n_samples"), REJECTIONS[rejection](F.col("a"), **options).alias("s"))
    return kept.select(key, F.col("n_samples").cast("long").alias("n_samples"), F.size("s").cast("long").alias("n_survivors"), robust.mean(F.col("s")).alias("value"))


def weighted_rejected_stack(samples: DataFrame, low: float = 2.5, high: float = 2.5, passes: int = 3, key: str = "px") -> DataFrame:
    """Sigma-clipped weighted mean: weights count in the mean only, never in who is rejected."""
    pairs = samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("v", "frame", "w"))).alias("p"))
    kept = pairs.withColumn("s", robust.sigma_clip(F.transform("p", lambda x: x["v"]), low, high, passes))
    inside = F.filter("p", lambda x: (x["v"] >= F.element_at("s", 1)) & (x["v"] <= F.element_at("s", -1)))
    kept = kept.select(key, F.size("p").alias("n"), inside.alias("i"))
    weight = robust.total(F.transform("i", lambda x: x["w"]))
    value = robust.total(F.transform("i", lambda x: x["v"] * x["w"]))
    return kept.select(key, F.col("n").cast("long").alias("n_samples"), F.size("i").cast("long").alias("n_survivors"), F.when(weight > 0, value / weight).otherwise(0.0).alias("value"))


def frame_levels(samples: DataFrame) -> DataFrame:
    """(frame, median, mad): exact, over all samples of a frame, without gathering them; a row for each frame, stored."""
    levels = stored(medians(samples, ["frame"], "v", "median"))
    off = samples.join(levels, "frame").withColumn("off", F.abs(F.col("v") - F.col("median")))
    return stored(medians(off, ["frame", "median"], "off", "mad"))


def reference_frame(levels: DataFrame) -> DataFrame:
    """The frame with the least deviation, the first on ties."""
    return levels.groupBy().agg(F.min(F.struct("mad", "frame", "median")).alias("r")).select(F.col("r.frame").alias("ref"), F.col("r.mad").alias("ref_mad"), F.col("r.median").alias("ref_median"))


def gains(levels: DataFrame) -> DataFrame:
    """(frame, gain, offset, w): to the reference frame's level and spread; w: inverse variance after the gain, normalised."""
    ref = reference_frame(levels)
    found = levels.crossJoin(F.broadcast(ref))  # one row on the right
    found = found.withColumn("gain", F.when(F.col("mad") <= robust.EPSILON, 1.0).otherwise(F.col("ref_mad") / F.col("mad")))
    found = found.withColumn("offset", F.col("ref_median") - F.col("median") * F.col("gain"))
    sigma = F.col("gain") * F.col("mad") * robust.MAD_TO_SIGMA
    found = found.withColumn("raw", F.when(sigma <= robust.EPSILON, 0.0).otherwise(1.0 / (sigma * sigma)))
    total = found.groupBy().agg(F.sum("raw").alias("total"))
    return found.crossJoin(F.broadcast(total)).select("frame", "gain", "offset", (F.col("raw") / F.col("total")).alias("w"))


def normalised_stack(samples: DataFrame, key: str = "px", **options) -> DataFrame:
    """Frames brought to the reference's level, weighted by noise, sigma-clipped and averaged."""
    applied = samples.select(key, "frame", "v").join(F.broadcast(gains(frame_levels(samples))), "frame")
    level = (F.col("v") * F.col("gain") + F.col("offset")).alias("v")
    return weighted_rejected_stack(applied.select(key, "frame", level, "w"), key=key, **options)


def student_quantile(p: float, df: int) -> float:
    """Inverse of Student's t distribution by bisection; the distribution by a sum over the angle (whole df)."""

    def below(t: float) -> float:
        angle = np.arctan(t / np.sqrt(df))
        c, s = np.cos(angle), np.sin(angle)
        if df % 2:
            term, total = c, 0.0
            for k in range(1, (df - 1) // 2 + 1):
                total += term
                term *= c * c * 2 * k / (2 * k + 1)
            return 0.5 + (angle + s * total) / np.pi
        term, total = 1.0, 0.0
        for k in range(1, df // 2 + 1):
            total += term
            term *= c * c * (2 * k - 1) / (2 * k)
        return 0.5 + s * total / 2

    low, high = -1e4, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


def esd_critical(m: int, alpha: float = 0.05) -> float:
    """Rosner's critical value for the most extreme of ``m`` samples."""
    t = student_quantile(1 - alpha / (2 * m), m - 2)
    return t * (m - 1) / float(np.sqrt((m - 2 + t * t) * m))


def esd_survivors(a: np.ndarray, alpha: float = 0.05, most: int | None = None) -> np.ndarray:
    """Generalised extreme Studentized deviate test: rejected up to the last statistic above its critical value."""
    n = len(a)
    if n < 4:
        return a
    most = min(most if most is not None else min(n // 4, 2 if n < 25 else 10), n - 3)
    left, gone, last = a.astype(float), 0, 0
    kept = left
    for i in range(most):
        d = left.std(ddof=1)
        if d == 0:
            break
        far = int(np.argmax(np.abs(left - left.mean())))
        critical = esd_critical(n - i, alpha)
        statistic = abs(left[far] - left.mean()) / d
        left = np.delete(left, far)
        gone = i + 1
        if statistic > critical:
            last, kept = gone, left
    return kept if last else a


def esd_stack(samples: DataFrame, key: str = "px", alpha: float = 0.05) -> DataFrame:
    """Mean after the ESD test; the loop depends on the data, so arrays go through Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [esd_survivors(np.asarray(a), alpha) for a in batch["a"]]
            yield pd.DataFrame({key: batch[key], "n_samples": batch["a"].map(len), "n_survivors": [len(k) for k in kept], "value": [k.mean() for k in kept]})

    return gathered(samples, key).mapInPandas(run, f"{key} long, n_samples long, n_survivors long, value double")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def multiplicative_gains(levels: DataFrame) -> DataFrame:
    """(frame, gain): to the reference frame's median; 1 where a frame has none to speak of."""
    found = levels.crossJoin(F.broadcast(reference_frame(levels)))  # one row on the right
    return found.select("frame", F.when(F.col("median") <= robust.EPSILON, 1.0).otherwise(F.col("ref_median") / F.col("median")).alias("gain"))


def common_domain(samples: DataFrame, key: str = "px") -> DataFrame:
    """Samples of the pixels that every frame covers."""
    frames = samples.select("frame").distinct().groupBy().agg(F.count("*").alias("frames"))
    counts = samples.groupBy(key).agg(F.count("*").alias("n"))
    whole = counts.crossJoin(F.broadcast(frames)).filter("n = frames").select(key)  # one row on the right
    return samples.join(whole, key, "left_semi")


def sample_faults(samples: DataFrame) -> DataFrame:
    """(frame, n, n_missing, n_not_finite): what a stack must not be fed with."""
    odd = F.isnan("v") | (F.abs("v") == float("inf"))
    return samples.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.count_if(odd).alias("n_not_finite"))


def covered(samples: DataFrame, least: float = 1e-3) -> DataFrame:
    """Samples whose coverage is more than ``least``."""
    return samples.filter(F.col("coverage") > least)


#: Frames that a rejection needs; fewer are combined by the median.
LEAST_FRAMES = {"sigma": 5, "linear_fit": 5, "esd": 15}


def stacked(samples: DataFrame, rejection: str | None = "sigma", key: str = "px", **options) -> DataFrame:
    """(key, n_samples, value): mean of what the rejection leaves, or the median of a stack with too few frames for it; the
    number of frames is that of the whole stack. Without a rejection the plain mean."""
    if rejection is None:
        return samples.groupBy(key).agg(F.count("*").alias("n_samples"), F.avg("v").alias("value"))
    if samples.select("frame").distinct().count() < LEAST_FRAMES.get(rejection, 0):
        return median_stack(samples, key)
    found = esd_stack(samples, key, **options) if rejection == "esd" else rejected_stack(samples, rejection, key, **options)
    return found.select(key, "n_samples", "value")


def on_grid(found: DataFrame, grid: DataFrame, key: str = "px") -> DataFrame:
    """``found`` for every pixel of the grid: 0 samples and 0 where no frame covers it."""
    none = {"n_samples": F.coalesce("n_samples", F.lit(0)), "value": F.coalesce("value", F.lit(0.0))}
    return grid.select(key).distinct().join(found, key, "left").withColumns(none)
