"""How well values foretell labels: daily correlations and what is made of them, for many expressions in one plan.

Values are computed on the whole panel before it is cut into windows; only the
lag of the stability metric stays within one. Lags and label ranks are taken
while there is a column for each expression, so they cost one exchange for all
of them. Then rows are dealt by date, a few dates a task, and become long,
(factor, window, datetime, instrument); this one exchange serves the ranks and
all daily figures. Everything else is made of the
daily figures, a row for each factor and date.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import pearson
from .crosssection import percent_rank
from .panel import LABEL

METRICS = ("ic", "ic_std", "rank_ic", "rank_ic_std", "icir", "lag1_autocorr", "monthly_robustness", "coverage")
KEYS = ("factor", "window")
#: Tasks that dates are dealt to, at least. Not a multiple of 7, so that weekly dates take turns as daily ones do.
DATE_TASKS = 199


def _dealt_by_date(rows: DataFrame) -> DataFrame:
    """rows with deal, the task of their date. Dates take turns, where a hash would put several large ones together."""
    n = max(DATE_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n += n % 7 == 0
    return rows.withColumn("deal", F.pmod(F.datediff("datetime", F.lit("1970-01-01").cast("date")), F.lit(n))).repartitionById(n, "deal")


def long_values(wide: DataFrame, factors: list[str], windows: Mapping[str, tuple[str, str]], label: str = LABEL) -> DataFrame:
    """Rows of wide (one column for each factor) by factor and window; windows are closed date ranges and may overlap.

    Beside value and label: before, the instrument's previous value within the
    window, label_rank, deal, the task of the date, and slot, a number for factor
    and date that is quick to sort by.
    """
    within = [F.when(F.col("datetime").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(name)) for name, (a, b) in windows.items()]
    rows = wide.select("datetime", "instrument", F.col(label).cast("double").alias("label"), F.struct(*factors).alias("v"), F.explode(F.array_compact(F.array(*within))).alias("window"))
    before = F.lag("v").over(Window.partitionBy("window", "instrument").orderBy("datetime"))
    rows = _dealt_by_date(rows.withColumn("before", before))
    rows = rows.withColumn("label_rank", percent_rank(F.col("label"), ("deal", "window", "datetime")))
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("factor"), F.col(f"v.{f}").alias("value"), F.col(f"before.{f}").alias("before")) for k, f in enumerate(factors)]))
    rows = rows.select("deal", "window", "datetime", "instrument", "label", "label_rank", values.alias("f"))
    slot = F.datediff("datetime", F.lit("1970-01-01").cast("date")).cast("long") * len(factors) + F.col("f.k")
    return rows.select("f.factor", "window", "datetime", "instrument", "f.value", "f.before", "label", "label_rank", slot.alias("slot"), "deal")


def daily_figures(rows: DataFrame) -> DataFrame:
    """factor, window, datetime, daily_ic, daily_rank_ic, daily_lag1, and the numbers of rows, values and complete pairs."""
    by = (*KEYS, "datetime")
    value, label = F.col("value"), F.col("label")
    deal = [c for c in ("deal",) if c in rows.columns]
    ranked = rows.withColumn("value_rank", percent_rank(value, (*deal, *(("slot", "window", "datetime") if "slot" in rows.columns else by))))
    figures = ranked.groupBy(*by, *deal).agg(
        pearson(value, label).alias("daily_ic"), pearson(F.col("value_rank"), F.col("label_rank")).alias("daily_rank_ic"), pearson(value, F.col("before")).alias("daily_lag1"),
        F.count(F.lit(1)).alias("rows"), F.count(value).alias("values"), F.count(F.when(label.isNotNull(), value)).alias("pairs"),
    )
    return figures.drop(*deal)


def daily_series(figures: DataFrame) -> DataFrame:
    """factor, window, datetime, daily_ic and daily_rank_ic, for the dates that have a complete pair."""
    return figures.filter("pairs > 0").select(*KEYS, "datetime", "daily_ic", "daily_rank_ic")


def window_metrics(figures: DataFrame) -> DataFrame:
    """One row per factor and window with all METRICS.

    The ratio needs two days with a value. Robustness is the share of months
    whose mean has the sign of the window's; of the months that have a complete
    pair, those without a value miss it.
    """
    whole, month = Window.partitionBy(*KEYS), Window.partitionBy(*KEYS, "month")
    days = figures.withColumn("month", F.when(F.col("pairs") > 0, F.trunc("datetime", "month")))
    days = days.withColumns({"m": F.avg("daily_ic").over(month), "first": F.min("datetime").over(month) == F.col("datetime"), "w": F.avg("daily_ic").over(whole)})
    same = F.coalesce((F.signum("m") == F.signum("w")).cast("double"), F.lit(0.0))
    counted = F.col("first") & F.col("month").isNotNull() & (F.col("w") != 0)
    out = days.groupBy(*KEYS).agg(
        F.avg("daily_ic").alias("ic"), F.stddev_samp("daily_ic").alias("ic_std"), F.avg("daily_rank_ic").alias("rank_ic"), F.stddev_samp("daily_rank_ic").alias("rank_ic_std"),
        F.count("daily_ic").alias("days"), F.avg("daily_lag1").alias("lag1_autocorr"), F.avg(F.when(counted, same)).alias("monthly_robustness"),
        F.try_divide(F.sum("values").cast("double"), F.sum("rows")).alias("coverage"),
    )
    return out.withColumn("icir", F.when(F.col("days") >= 2, F.try_divide("ic", "ic_std"))).select(*KEYS, *METRICS)
