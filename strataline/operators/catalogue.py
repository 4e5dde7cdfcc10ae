"""The closed set of operators: how many arguments each takes, which are literals, and what it needs to run."""

from __future__ import annotations

from typing import NamedTuple

#: The fields that expressions may read.
FIELDS = (
    "open", "high", "low", "close", "volume", "market_cap", "dollar_volume", "ret",
    "funda_pe", "funda_pb", "funda_div_yield", "funda_days_since_disclosure",
    "funda_days_since_quarter_start", "funda_net_income", "funda_book_equity",
    "funda_shares_out",
)


class Spec(NamedTuple):
    """kind: scalar, ts (a window along an instrument) or cs (a window across a date).

    literal: place of the argument that has to be a whole-number literal; least: the smallest it may be.
    """

    arity: int
    kind: str
    literal: int | None = None
    least: int | None = None


SPECS = {
    "TS_MEAN": Spec(2, "ts", 1, 1),
    "TS_SUM": Spec(2, "ts", 1, 1),
    "TS_MIN": Spec(2, "ts", 1, 1),
    "TS_MAX": Spec(2, "ts", 1, 1),
    "TS_STD": Spec(2, "ts", 1, 1),
    "TS_RANK": Spec(2, "ts", 1, 1),
    "DELTA": Spec(2, "ts", 1, 1),
    "DELAY": Spec(2, "ts", 1, 0),
    "TS_CORR": Spec(3, "ts", 2, 1),
    "CS_RANK": Spec(1, "cs"),
    "CS_ZSCORE": Spec(1, "cs"),
    "CS_WINSORIZE": Spec(3, "cs"),
    "CS_NEUTRALIZE": Spec(2, "cs"),
    "CS_BUCKET": Spec(2, "cs", 1, 1),
    "ADD": Spec(2, "scalar"),
    "SUBTRACT": Spec(2, "scalar"),
    "MULTIPLY": Spec(2, "scalar"),
    "DIVIDE": Spec(2, "scalar"),
    "ABS": Spec(1, "scalar"),
    "SIGN": Spec(1, "scalar"),
    "LOG": Spec(1, "scalar"),
    "POW": Spec(2, "scalar", 1),
    "GT": Spec(2, "scalar"),
    "LT": Spec(2, "scalar"),
    "IF_THEN_ELSE": Spec(3, "scalar"),
    "TS_SINCE": Spec(1, "ts"),
    "TS_COUNT": Spec(2, "ts", 1, 1),
}

#: Names of each operator's arguments, and what it gives.
MEANINGS = {
    "TS_MEAN": ("x, rows", "mean of the instrument's last rows"),
    "TS_SUM": ("x, rows", "sum of the last rows"),
    "TS_MIN": ("x, rows", "smallest of the last rows"),
    "TS_MAX": ("x, rows", "largest of the last rows"),
    "TS_STD": ("x, rows", "sample deviation of the last rows, which are 2 at least"),
    "TS_RANK": ("x, rows", "rank of the newest value among the last rows, as a share up to 1"),
    "DELTA": ("x, rows", "change since so many rows ago"),
    "DELAY": ("x, rows", "value of so many rows ago"),
    "TS_CORR": ("x, y, rows", "correlation of two values over the last rows"),
    "CS_RANK": ("x", "rank among the date's instruments, as a share up to 1"),
    "CS_ZSCORE": ("x", "distance from the date's mean in deviations"),
    "CS_WINSORIZE": ("x, low, high", "value cut at two quantiles of its date, given as shares"),
    "CS_NEUTRALIZE": ("x, group", "value minus the mean of its group on the date"),
    "CS_BUCKET": ("x, buckets", "number of the bucket, from 1, among equally large ones of the date"),
    "ADD": ("x, y", "sum"),
    "SUBTRACT": ("x, y", "difference"),
    "MULTIPLY": ("x, y", "product"),
    "DIVIDE": ("x, y", "quotient, missing where y is 0"),
    "ABS": ("x", "absolute value"),
    "SIGN": ("x", "-1, 0 or 1"),
    "LOG": ("x", "natural logarithm, missing unless x is above 0"),
    "POW": ("x, power", "power with a whole exponent"),
    "GT": ("x, y", "1 where x is above y, else 0"),
    "LT": ("x, y", "1 where x is below y, else 0"),
    "IF_THEN_ELSE": ("condition, x, y", "x where the condition is not 0, else y"),
    "TS_SINCE": ("event", "rows since the event was last other than 0"),
    "TS_COUNT": ("event, rows", "how many of the last rows have an event other than 0"),
}
if MEANINGS.keys() != SPECS.keys() or any(len(MEANINGS[op][0].split(", ")) != spec.arity for op, spec in SPECS.items()):
    raise AssertionError("each operator has a meaning and a name for each argument")
