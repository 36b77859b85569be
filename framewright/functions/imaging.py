"""Sample-wise image formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gaussian width to full width at half maximum; registration quality's least, error scale and saturation.
FWHM_OF_SIGMA = 2.354820045
LEAST_MATCHES, ERROR_SCALE, ENOUGH_MATCHES = 4, 2.0, 20.0
#: A stretch of less intensity is none; steps of the softening's search.
LEAST_INTENSITY, HALVINGS = 1e-6, 50


def normalised(raw: Column, black: float, white: float, clamp: bool = True) -> Column:
    """Sensor counts to 0..1 between two levels."""
    scaled = (raw - black) / (white - black)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) if clamp else scaled


def mosaic_colour(y: Column, x: Column, pattern: list[list[str]]) -> Column:
    """The filter colour of a pixel of a periodic mosaic (2x2, 6x6, ...)."""
    h, w = len(pattern), len(pattern[0])
    flat = F.array(*(F.lit(c) for line in pattern for c in line))
    return F.get(flat, (F.pmod(y, F.lit(h)) * w + F.pmod(x, F.lit(w))).cast("int"))


def signal_to_noise(flux: Column, sky_noise: Column, pixels: Column, gain: float | None = None, read_noise: float = 0.0) -> Column:
    """Background-limited, or with a sensor's gain (electrons a unit) and read noise the full CCD equation."""
    variance = pixels * sky_noise * sky_noise
    if gain is not None:
        variance = flux / gain + pixels * (sky_noise * sky_noise + (read_noise / gain) ** 2)
    return flux / F.sqrt(F.greatest(variance, F.lit(1.1920929e-7)))


def sexagesimal(text: Column) -> Column:
    """Degrees or hours of 'dd mm ss' or 'dd:mm:ss'; null if it isn't three numbers. The sign stands for the whole."""
    clean = F.trim(F.regexp_replace(text, "[ :]+", " "))
    part = lambda k: F.try_element_at(F.split(clean, " "), F.lit(k)).try_cast("double")
    size = F.abs(part(1)) + part(2) / 60.0 + part(3) / 3600.0
    value = F.when(clean.startswith("-"), -size).otherwise(size)
    return F.when(F.size(F.split(clean, " ")) == 3, value)


def registration_quality(n: Column, sum_of_squares: Column) -> Column:
    """0 to 1 from the number of matches and their squared residuals."""
    rms = F.sqrt(sum_of_squares / n)
    return F.when(n < LEAST_MATCHES, 0.0).otherwise(F.exp(-rms / ERROR_SCALE) * F.least(n / ENOUGH_MATCHES, F.lit(1.0)))


def _falling(d: float, b: float):
    """(slope, area) of a curve whose slope falls from 1 as a power of the distance: (1 + c u) ** -p. ``b`` sets the power
    and ``d`` how fast it falls at first; b = 0 is the exponential limit, and p = 1 a logarithm."""
    if b == 0:
        return lambda u: F.exp(-d * u), lambda u: (1 - F.exp(-d * u)) / d
    c, p = abs(b) * d, 1 + 1 / b if b > 0 else -1 / b
    slope = lambda u: F.pow(1 + c * u, F.lit(-p))
    if p == 1:
        return slope, lambda u: F.log1p(c * u) / c
    return slope, lambda u: (F.pow(1 + c * u, F.lit(1 - p)) - 1) / (c * (1 - p))


def hyperbolic_stretch(x: Column, d: float, b: float, centre: float, low: float = 0.0, high: float = 1.0) -> Column:
    """Generalised hyperbolic stretch of intensity ``d`` and shape ``b``: the area under a slope that is greatest at
    ``centre``, falls to both sides and stays as it is below ``low`` and above ``high``; brought to 0..1. No stretch below
    ``LEAST_INTENSITY``."""
    clamped = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    if d < LEAST_INTENSITY:
        return clamped(x)
    slope, area = _falling(d, b)

    def under(v: Column) -> Column:
        inner = F.least(F.greatest(v, F.lit(low)), F.lit(high))
        away = F.abs(inner - centre)
        return F.signum(inner - centre) * area(away) + (v - inner) * slope(away)

    start, end = under(F.lit(0.0)), under(F.lit(1.0))  # folded
    return clamped((under(x) - start) / (end - start))


def auto_asinh_beta(median: Column, target: float = 0.2) -> Column:
    """The softening that takes a median to ``target``, by halving its decimal logarithm between -5 and 5."""
    def half(p: Column, i: Column) -> Column:
        middle = (p["lo"] + p["hi"]) / 2
        beta = F.pow(F.lit(10.0), middle)
        brighter = F.asinh(median / beta) / F.asinh(1 / beta) > target
        return F.struct(F.when(brighter, middle).otherwise(p["lo"]).alias("lo"), F.when(brighter, p["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(-5.0).alias("lo"), F.lit(5.0).alias("hi"))
    return F.reduce(F.sequence(F.lit(1), F.lit(HALVINGS)), start, half, lambda p: F.pow(F.lit(10.0), (p["lo"] + p["hi"]) / 2))


def remapped(r: Column, g: Column, b: Column, to: Column) -> tuple[Column, Column, Column]:
    """Channels scaled so that their mean becomes ``to``, the brightest at most 1 and none below 0; without light untouched."""
    mean = (r + g + b) / 3
    gain = to / mean
    gain = gain / F.greatest(gain * F.greatest(r, g, b), F.lit(1.0))
    return tuple(F.when(mean <= 0, c).otherwise(F.greatest(c * gain, F.lit(0.0))) for c in (r, g, b))


def colour_preserving(r: Column, g: Column, b: Column, curve) -> tuple[Column, Column, Column]:
    """Channels scaled by what the curve does to their mean, the brightest at most 1; black stays black."""
    mean = (r + g + b) / 3
    gain = curve(mean) / mean
    gain = gain / F.greatest(gain * F.greatest(r, g, b), F.lit(1.0))
    return tuple(F.when(mean <= 0, 0.0).otherwise(F.greatest(c * gain, F.lit(0.0))) for c in (r, g, b))
