"""Robust statistics of one pixel's samples, as columns over a sorted array of doubles.

A pixel has at most one sample for each frame, so an array is as long as the stack is deep. All work stays in SQL
expressions; a data-dependent loop is a ``reduce`` over passes in which a finished state stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MAD to sigma, single-precision epsilon, Huber's bound, the winsorized correction and convergence.
MAD_TO_SIGMA = 1.4826022
EPSILON = 1.1920929e-7
HUBER, CORRECTION, CONVERGENCE = 1.5, 1.134, 0.0005


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def median_fast(a: Column) -> Column:
    """The upper middle of a sorted array."""
    return _at(a, F.floor(F.size(a) / 2))


def median(a: Column) -> Column:
    """The mean of the two middles where the number is even."""
    half = F.floor(F.size(a) / 2)
    return F.when(F.size(a) % 2 == 1, _at(a, half)).otherwise((_at(a, half - 1) + _at(a, half)) / 2)


def _deviations(a: Column, centre: Column) -> Column:
    return F.array_sort(F.transform(a, lambda x: F.abs(x - centre)))


def mad_fast(a: Column, centre: Column) -> Column:
    return median_fast(_deviations(a, centre))


def mad(a: Column, centre: Column) -> Column:
    return median(_deviations(a, centre))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def is_clean(a: Column, k: float) -> Column:
    """No value can be rejected: with ten or more, both ends lie within ``k`` deviations of the mean without them."""
    n = F.size(a) - 2
    low, high = _at(a, F.lit(0)), _at(a, F.size(a) - 1)

    def judge(p: Column) -> Column:
        sums = p["s"] - low - high
        variance = (p["q"] - low * low - high * high - sums * sums / n) / (n - 1)
        centre = sums / n
        reach = F.greatest(F.abs(high - centre), F.abs(low - centre))
        return (variance < EPSILON) | (reach <= k * F.sqrt(F.greatest(variance, F.lit(0.0))))

    sums = F.struct(total(a).alias("s"), total(F.transform(a, lambda x: x * x)).alias("q"))
    return F.when(F.size(a) >= 10, let(sums, judge)).otherwise(False)


def _passes(a: Column, n: int, step) -> Column:
    return F.reduce(F.sequence(F.lit(1), F.lit(n)), a, lambda state, i: step(state, i))


def sigma_clip(a: Column, low: float = 2.5, high: float = 2.5, passes: int = 3) -> Column:
    """Survivors about the upper middle, with the screen for clean pixels in each pass."""

    def cut(s: Column) -> Column:
        def by(p: Column) -> Column:
            kept = F.filter(s, lambda x: (x >= p["c"] - low * p["d"]) & (x <= p["c"] + high * p["d"]))
            return F.when(p["d"] < EPSILON, s).otherwise(kept)

        return let(median_fast(s), lambda c: let(F.struct(c.alias("c"), (MAD_TO_SIGMA * mad_fast(s, c)).alias("d")), by))

    return _passes(a, passes, lambda s, i: F.when((F.size(s) <= 2) | is_clean(s, min(low, high)), s).otherwise(cut(s)))


def percentile_clip(a: Column, low: float = 10.0, high: float = 10.0) -> Column:
    """Without the lowest and highest share; the upper middle where nothing would be left, all of fewer than three."""
    n = F.size(a)
    start, stop = F.floor(n * low / 100.0).cast("int"), (n - F.floor(n * high / 100.0)).cast("int")
    kept = F.when(start >= stop, F.array(median_fast(a))).otherwise(F.slice(a, start + 1, F.greatest(stop - start, F.lit(0))))
    return F.when(n < 3, a).otherwise(kept)


def linear_fit_clip(a: Column, low: float = 3.0, high: float = 3.0, passes: int = 3) -> Column:
    """First pass about the median; then each value about its own place on a line through the sorted values."""

    def about_median(s: Column) -> Column:
        def by(p: Column) -> Column:
            kept = F.filter(s, lambda x: (x >= p["c"] - low * p["d"]) & (x <= p["c"] + high * p["d"]))
            return F.when(p["d"] < EPSILON, s).otherwise(kept)

        return let(median_fast(s), lambda c: let(F.struct(c.alias("c"), (MAD_TO_SIGMA * mad_fast(s, c)).alias("d")), by))

    def about_line(s: Column) -> Column:
        n = F.size(s).cast("double")
        sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
        sxy = total(F.transform(s, lambda x, i: x * i))

        def fitted(line: Column) -> Column:
            off = F.transform(s, lambda x, i: x - (line["a"] + line["b"] * i))
            kept = lambda d: F.filter(s, lambda x, i: (x >= line["a"] + line["b"] * i - low * d) & (x <= line["a"] + line["b"] * i + high * d))
            return let(total(F.transform(off, lambda x: F.abs(x))) / n, lambda d: F.when(d < EPSILON, s).otherwise(kept(d)))

        def line(sy: Column) -> Column:
            slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
            return let(slope, lambda b: let(F.struct(((sy - b * sx) / n).alias("a"), b.alias("b")), fitted))

        return let(total(s), line)

    step = lambda s, i: F.when(F.size(s) <= 3, s).when(i == 1, about_median(s)).otherwise(about_line(s))
    return F.when(F.size(a) < 4, a).otherwise(_passes(a, passes, step))


def _deviation(a: Column, centre: Column) -> Column:
    """Sample standard deviation about a centre."""
    return F.when(F.size(a) <= 1, 0.0).otherwise(F.sqrt(total(F.transform(a, lambda x: (x - centre) * (x - centre))) / (F.size(a) - 1)))


def winsorized_clip(a: Column, low: float = 2.5, high: float = 2.5, passes: int = 50) -> Column:
    """Values beyond the bounds of a centre and deviation found by clamping again and again."""

    def state(s: Column, done: Column, before: Column | None = None) -> Column:
        def of(c: Column) -> Column:
            d = CORRECTION * _deviation(s, c)
            end = done if before is None else done | (F.abs(d - before) <= before * CONVERGENCE)
            return F.struct(s.alias("s"), c.alias("c"), d.alias("d"), (end | (d < EPSILON)).alias("done"))

        return let(median_fast(s), of)

    def step(p: Column, i: Column) -> Column:
        bounded = F.transform(p["s"], lambda x: F.least(F.greatest(x, p["c"] - HUBER * p["d"]), p["c"] + HUBER * p["d"]))
        return F.when(p["done"], p).otherwise(let(bounded, lambda s: state(s, F.lit(False), p["d"])))

    end = F.reduce(F.sequence(F.lit(1), F.lit(passes)), state(a, F.lit(False)), step)
    kept = lambda p: F.filter(a, lambda x: (x >= p["c"] - low * p["d"]) & (x <= p["c"] + high * p["d"]))
    clipped = let(end, lambda p: F.when(p["d"] < EPSILON, a).otherwise(kept(p)))
    return F.when(F.size(a) < 3, a).otherwise(clipped)


def clipped_stats(a: Column, kappa: float = 3.0, passes: int = 3) -> Column:
    """Struct of median, sigma and mean after clipping. A pass that rejects nothing ends with its upper middles; when the
    passes run out, or fewer than three are left, exact medians are taken of what is left."""

    def step(p: Column, i: Column) -> Column:
        s = p["s"]

        def by(q: Column) -> Column:
            flat = q["d"] * MAD_TO_SIGMA <= F.abs(q["c"]) * EPSILON
            kept = F.filter(s, lambda x: F.abs(x - q["c"]) <= kappa * MAD_TO_SIGMA * q["d"])
            stay = F.struct(s.alias("s"), F.lit(True).alias("done"), q["c"].alias("c"), F.when(flat, 0.0).otherwise(q["d"]).alias("d"))
            on = let(kept, lambda k: F.when(F.size(k) == F.size(s), stay).otherwise(F.struct(k.alias("s"), F.lit(False).alias("done"), q["c"].alias("c"), q["d"].alias("d"))))
            return F.when(flat, stay).otherwise(on)

        centred = let(median_fast(s), lambda c: let(F.struct(c.alias("c"), mad_fast(s, c).alias("d")), by))
        return F.when(p["done"] | (F.size(s) < 3), p).otherwise(centred)

    start = F.struct(a.alias("s"), F.lit(False).alias("done"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
    end = F.reduce(F.sequence(F.lit(1), F.lit(passes)), start, step)

    def final(p: Column) -> Column:
        exact = let(median(p["s"]), lambda c: F.struct(c.alias("median"), (MAD_TO_SIGMA * mad(p["s"], c)).alias("sigma"), mean(p["s"]).alias("mean")))
        fast = F.struct(p["c"].alias("median"), (MAD_TO_SIGMA * p["d"]).alias("sigma"), mean(p["s"]).alias("mean"))
        return F.when(p["done"], fast).otherwise(exact)

    return let(end, final)
