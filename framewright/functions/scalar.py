"""Scalar nodes as columns: IEEE results where Spark would raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> tuple[Column, Column]:
    """(quotient, remainder); by zero: infinity with the dividend's sign, or NaN, and a NaN remainder."""
    by_zero = F.when(a > 0, INF).when(a < 0, -INF).otherwise(NAN)
    safe = F.when(b == 0, 1.0).otherwise(b)
    return F.when(b == 0, by_zero).otherwise(a / safe), F.when(b == 0, NAN).otherwise(a % safe)


def logarithm(value: Column, base: Column) -> Column:
    """log of ``value`` to ``base``; -infinity at 0, NaN below."""
    safe = F.when(value > 0, value).otherwise(1.0)
    return F.when(value > 0, F.ln(safe) / F.ln(base)).when(value == 0, -INF / F.ln(base)).otherwise(NAN)


def to_integer(value: Column) -> Column:
    """Cuts towards zero, holds at the limits of 64 bits; NaN is 0."""
    top = 9223372036854775807
    cut = F.when(value >= float(top), F.lit(top)).when(value <= -float(top), F.lit(-top - 1))
    return F.when(F.isnan(value), F.lit(0).cast("long")).otherwise(cut.otherwise(F.when(F.abs(value) < float(top), value).cast("long")))


def to_boolean(value: Column) -> Column:
    """Anything but zero is true, NaN too."""
    return F.isnan(value) | (value != 0)


def double_text(value: Column) -> Column:
    """Shortest text without an exponent; whole numbers without a point."""
    text = value.cast("string")
    sign, first, rest, power = (F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E(-?\d+)$", k) for k in (1, 2, 3, 4))
    rest, power = F.regexp_replace(rest, "0+$", ""), F.when(power == "", "0").otherwise(power).cast("int")
    large = F.when(F.length(rest) <= power, F.concat(first, F.rpad(rest, power, "0")))
    large = large.otherwise(F.concat(first, F.substring(rest, F.lit(1), power), F.lit("."), F.substring(rest, power + 1, F.length(rest))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), first, rest)
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == INF, "inf")
        .when(value == -INF, "-inf")
        .when(text.contains("E"), F.concat(sign, F.when(power > 0, large).otherwise(small)))
        .otherwise(F.regexp_replace(text, r"\.0$", ""))
    )


def concat_text(*parts: Column) -> Column:
    """Texts one after another; a missing part makes no text."""
    return F.concat(*parts)
