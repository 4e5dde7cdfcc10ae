"""Operators across the instruments of a date. Callers may partition by more columns than the date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.missing import null_if_nan

DATE = ("datetime",)


def _ordered(by: tuple[str, ...], *order: Column) -> tuple:
    """An ordered window and, of the same partitions and sort, the frames up to the last tie and over everything."""
    window = Window.partitionBy(*by).orderBy(*order)
    upto = window.rangeBetween(Window.unboundedPreceding, 0) if len(order) == 1 else None
    return window, upto, window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def percent_rank(x: Column, by: tuple[str, ...] = DATE) -> Column:
    """Average rank as a share of the values that are there: half of the first tie's place and the last one's."""
    window, upto, everything = _ordered(by, x.asc_nulls_last())
    place = (F.rank().over(window) + F.count(F.lit(1)).over(upto)) / F.lit(2.0)
    return F.when(x.isNotNull(), place / F.count(x).over(everything))


def zscore(x: Column, by: tuple[str, ...] = DATE) -> Column:
    day = Window.partitionBy(*by)
    return null_if_nan(F.try_divide(x - F.avg(x).over(day), F.stddev_samp(x).over(day)))


def winsorize(x: Column, low: float, high: float, by: tuple[str, ...] = DATE) -> Column:
    """x clipped to two quantiles of its date, by linear interpolation; swapped bounds are put in order."""
    day = Window.partitionBy(*by)
    a, b = (F.percentile(x, F.lit(p)).over(day) for p in sorted((low, high)))
    return F.when(x.isNotNull(), F.least(F.greatest(x, a), b))


def neutralize(x: Column, group: Column, by: tuple[str, ...] = DATE) -> Column:
    """x less its mean within the date and group; rows without a group are a group."""
    return null_if_nan(x - F.avg(x).over(Window.partitionBy(*by, group)))


def bucket(x: Column, n: int, by: tuple[str, ...] = DATE) -> Column:
    """1 to n by rank; ties go by instrument."""
    window, _, everything = _ordered(by, x.asc_nulls_last(), F.col("instrument"))
    share = F.row_number().over(window) / F.count(x).over(everything).cast("double")
    return F.when(x.isNotNull(), F.least(F.greatest(F.ceil(share * n), F.lit(1)), F.lit(n)).cast("double"))
