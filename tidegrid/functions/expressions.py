"""Column expressions shared by the operators; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in text.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def number(c: Column | str) -> Column:
    """A double from text, null for anything that isn't plainly a number."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    return F.when(text.rlike(NUMBER) | text.rlike(INFINITE), F.trim(text).try_cast("double"))


def no_nan(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def boolean(c: Column | str) -> Column:
    low = F.lower((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(low.isin("yes", "true", "1"), True).when(low.isin("no", "false", "0"), False)


def clip(c: Column, low: Column, high: Column) -> Column:
    """Null stays null: greatest() alone would fill it."""
    return F.when(c.isNotNull(), F.greatest(low, F.least(high, c)))


def skew(c: Column | str) -> Column:
    """Bias-adjusted; null below three values, 0 for a constant."""
    n, std = F.count(c), F.stddev_samp(c)
    return F.when(n < 3, None).when(std == 0, 0.0).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: Column | str) -> Column:
    """Bias-adjusted excess; null below four values, 0 for a constant."""
    n, std = F.count(c), F.stddev_samp(c)
    return F.when(n < 4, None).when(std == 0, 0.0).otherwise(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))
