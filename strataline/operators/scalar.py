"""Row-wise operators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.missing import null_if_nan, ratio, truthy


def power(x: Column, k: int) -> Column:
    """Anything to the power of 0 is 1, a missing value too."""
    return F.lit(1.0) if k == 0 else null_if_nan(F.power(x, F.lit(float(k))))


def logarithm(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def choose(condition: Column, a: Column, b: Column) -> Column:
    """a where the condition is there and not zero, else b."""
    return F.when(truthy(condition), a).otherwise(b)


#: Operators whose arguments are all columns.
BUILDERS = {
    "ADD": lambda a, b: null_if_nan(a + b),
    "SUBTRACT": lambda a, b: null_if_nan(a - b),
    "MULTIPLY": lambda a, b: null_if_nan(a * b),
    "DIVIDE": ratio,
    "ABS": F.abs,
    "SIGN": F.signum,
    "LOG": logarithm,
    "GT": lambda a, b: (a > b).cast("double"),
    "LT": lambda a, b: (a < b).cast("double"),
    "IF_THEN_ELSE": choose,
}
