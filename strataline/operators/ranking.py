"""Ranks and quantiles across a date for many operands at once, in long form: one sort for all of them.

Rows are dealt by date once. Within the tasks they become (operand, date,
instrument, value), are ordered by operand, date and value, and are folded back
to a row for each date and instrument, all without another exchange, because
each of these groupings lies within a date. So there is one sort, whatever the
number of operands; side by side every operand would sort all columns again.
The sort begins with one number for operand and date, and the fold adds up
fixed-size columns only, CHUNK operands at a time, so both stay with what Spark
does in place.

The panel's keys (date and instrument) have to be unique, as panels are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From so many operands of a pass on, they are ranked in long form.
MANY_OPERANDS = 4
#: Operands that are folded together.
CHUNK = 32
KEYS = ("datetime", "instrument")
_FIXED_SIZE = ("double", "float", "bigint", "int", "smallint", "tinyint", "boolean", "date", "timestamp", "timestamp_ntz")


def rank_many(df: DataFrame, operands: list[Column], rest: list[str], with_places: bool, bounds: Sequence[tuple[float, float]] = ()) -> tuple[DataFrame, list[dict[str, Column]]]:
    """df is dealt by date. A row for each row of df with its keys and the columns ``rest``, and for each operand the columns share (average rank as a share of the date's values), if with_places position (place by value, ties by instrument, as a share), and for each pair of bounds clip0, clip1, .. (the value, clipped to these quantiles of the date, by linear interpolation).

    Missing operands have missing shares, positions and values.
    """
    n, kinds = len(operands), dict(df.dtypes)
    carried = {c: f"rest{j}" for j, c in enumerate(rest)}
    held = [F.col("`" + c.replace("`", "``") + "`") for c in rest]
    missing = [F.lit(None).cast(kinds[c]) for c in rest]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("x"), *[c.alias(name) for c, name in zip(missing if k else held, carried.values(), strict=True)]) for k, x in enumerate(operands)])).alias("e")
    rows = df.select(*KEYS, each).select(*KEYS, "e.*")
    number = F.coalesce(F.datediff("datetime", F.lit("1970-01-01").cast("date")), F.lit(-(1 << 30))).cast("long") * n + F.col("k")
    rows = rows.withColumn("g", number)
    x = F.col("x")
    day, order = Window.partitionBy("g", "datetime"), x.asc_nulls_last()
    parts = ["share"]
    if with_places or bounds:
        rows = rows.withColumn("place", F.row_number().over(day.orderBy(order, "instrument")))
    ordered = day.orderBy(order)  # rows in the order of places are in this one too
    upto = ordered.rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"low": F.rank().over(ordered), "high": F.count(F.lit(1)).over(upto), "values": F.count("x").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    found = {"share": (F.col("low") + F.col("high")) / F.lit(2.0) / F.col("values")}
    if with_places:
        parts.append("position")
        found["position"] = F.col("place") / F.col("values").cast("double")
    if bounds:
        every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = {p: F.lit(p) * (F.col("values") - 1) for pair in bounds for p in pair}  # places from 0, whole or between two
        ends = {(p, k): F.max(F.when(F.col("place") == side(h).cast("int") + 1, x)).over(every) for p, h in at.items() for k, side in enumerate((F.floor, F.ceil))}
        names = {key: f"end{j}" for j, key in enumerate(ends)}
        rows = rows.withColumns({names[key]: c for key, c in ends.items()})

        def quantile(p: float) -> Column:
            low, high, h = F.col(names[p, 0]), F.col(names[p, 1]), at[p]
            return F.when(F.floor(h) == F.ceil(h), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

        for j, pair in enumerate(bounds):
            parts.append(f"clip{j}")
            a, b = map(quantile, sorted(pair))
            found[f"clip{j}"] = F.least(F.greatest(x, a), b)
    slot, chunk = F.col("k") % CHUNK, F.floor(F.col("k") / CHUNK).cast("int")
    rows = rows.select(*KEYS, slot.alias("slot"), chunk.alias("chunk"), *[F.when(x.isNotNull(), c).alias(p) for p, c in found.items()], *carried.values())
    same = [(F.max if kinds[c] in _FIXED_SIZE else lambda y: F.first(y, ignorenulls=True))(name).alias(name) for c, name in carried.items()]
    folded = rows.groupBy(*KEYS, "chunk").agg(*[F.max(F.when(F.col("slot") == j, F.col(p))).alias(f"{p}{j}") for p in parts for j in range(min(n, CHUNK))], *same)
    if n > CHUNK:
        folded = folded.groupBy(*KEYS).agg(*[F.max(F.when(F.col("chunk") == k // CHUNK, F.col(f"{p}{k % CHUNK}"))).alias(f"{p}{k}") for p in parts for k in range(n)], *same)
    own = [{p: F.col(f"__{p}{k}") for p in parts} for k in range(n)]
    return folded.select(*KEYS, *[F.col(name).alias(c) for c, name in carried.items()], *[F.col(f"{p}{k}").alias(f"__{p}{k}") for p in parts for k in range(n)]), own


def bucket_of(parts: dict[str, Column], n: int) -> Column:
    """1 to n by position."""
    return F.when(parts["position"].isNotNull(), F.least(F.greatest(F.ceil(parts["position"] * n), F.lit(1)), F.lit(n)).cast("double"))
