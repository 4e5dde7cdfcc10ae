"""Missing values are NULL. These helpers keep NaN and, where asked, infinities out, and stay safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(_INF)), x)


def as_number(x: Column) -> Column:
    return null_if_nan(x.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL for a zero divisor and for results that are not finite."""
    return finite(F.try_divide(a, b))


def pearson(x: Column, y: Column, over=None) -> Column:
    """Correlation of complete pairs: NULL for fewer than two, or if one side doesn't vary. over: a window, else an aggregate."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_samp(a, b), F.stddev_samp(a), F.stddev_samp(b)]
    cov, sx, sy = (p.over(over) for p in parts) if over is not None else parts
    return null_if_nan(F.try_divide(cov, sx * sy))


def truthy(x: Column) -> Column:
    return F.coalesce(x != 0, F.lit(False))
