"""Operators along an instrument: windows over its own rows in date order, never over calendar days."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.missing import finite, null_if_nan, pearson, truthy


_ALONG: ContextVar[tuple[str, ...]] = ContextVar("along", default=("instrument",))


@contextmanager
def along(*columns: str):
    """Windows that are built within run along these columns instead of the instrument."""
    before = _ALONG.set(columns)
    try:
        yield
    finally:
        _ALONG.reset(before)


def by_instrument():
    return Window.partitionBy(*_ALONG.get()).orderBy("datetime")


def trailing(n: int):
    return by_instrument().rowsBetween(-(n - 1), 0)


#: Ranks among up to so many rows compare the value with each of those before; beyond, with a list of them.
RANK_LAGS = 40


def rank(x: Column, n: int) -> Column:
    """Average rank of the row's value among those of its last n rows, as a share of their number."""
    x = finite(x)
    if n <= RANK_LAGS:
        before = [F.lag(x, k).over(by_instrument()) for k in range(1, n)]
        total = lambda test: sum((F.when(test(v), 1.0).otherwise(0.0) for v in before), F.lit(0.0))
        # below, half of the equal ones, and half of the value itself and the next place
        return F.when(x.isNotNull(), (total(lambda v: v < x) + total(lambda v: v == x) / 2.0 + F.lit(1.0)) / (total(lambda v: v.isNotNull()) + F.lit(1.0)))
    seen = F.collect_list(x).over(trailing(n))
    below, equal = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
    return F.when(x.isNotNull(), (below + (equal + 1) / F.lit(2.0)) / F.size(seen))


def correlation(x: Column, y: Column, n: int) -> Column:
    return pearson(x, y, trailing(n))


def since(event: Column) -> Column:
    """Rows since the last event, 0 on its own row, missing before the first."""
    row = F.row_number().over(by_instrument())
    last = F.last(F.when(truthy(event), row_of_event()), ignorenulls=True).over(by_instrument().rowsBetween(Window.unboundedPreceding, 0))
    return (row - last).cast("double")


#: The row's number along its instrument, which ``since`` needs as a column of its own.
ROW_NUMBER = "__row"


def row_of_event() -> Column:
    return F.col(ROW_NUMBER)


def count(event: Column, n: int) -> Column:
    return F.sum(F.when(truthy(event), 1.0).otherwise(0.0)).over(trailing(n))


#: By operator, a builder of columns and the whole number.
BUILDERS = {
    "TS_MEAN": lambda x, n: F.avg(finite(x)).over(trailing(n)),
    "TS_SUM": lambda x, n: F.sum(finite(x)).over(trailing(n)),
    "TS_MIN": lambda x, n: F.min(finite(x)).over(trailing(n)),
    "TS_MAX": lambda x, n: F.max(finite(x)).over(trailing(n)),
    "TS_STD": lambda x, n: F.stddev_samp(finite(x)).over(trailing(n)),
    "TS_RANK": rank,
    "DELTA": lambda x, n: null_if_nan(x - F.lag(x, n).over(by_instrument())),
    "DELAY": lambda x, n: F.lag(x, n).over(by_instrument()) if n else x,
    "TS_CORR": correlation,
    "TS_SINCE": since,
    "TS_COUNT": count,
}
