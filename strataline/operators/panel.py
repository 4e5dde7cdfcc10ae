"""The panel builder: daily market records and filed facts become one row per (datetime, instrument).

What was filed is visible on the first trading date strictly after the filing.
On any trading date that is the same as: the latest filing strictly before it.
So facts and panel rows are united by instrument, ordered by date with a date's
panel row before its filings, and carried forward in one window; no calendar is
joined, and instruments may miss dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import as_number, finite

#: Names of the raw market columns, and what the panel calls them.
PRICES = {
    "dlyopen": "open",
    "dlyhigh": "high",
    "dlylow": "low",
    "dlyclose": "close",
    "dlyvol": "volume",
    "dlycap": "market_cap",
    "dlyret": "ret",
}
REQUIRED = ("dlycaldt", "ticker", *PRICES)
#: The fields of filed facts.
FUNDAMENTALS = (
    "funda_net_income",
    "funda_book_equity",
    "funda_shares_out",
    "funda_revenue",
    "funda_assets",
    "funda_liabilities",
    "funda_div_per_share",
)
DIVIDEND = "funda_div_per_share"
LABEL = "label_fwd_10d"
HORIZON = 10
SHARE_CODES = (10, 11)


def _own():
    return Window.partitionBy("instrument").orderBy("datetime")


def check_columns(df: DataFrame, required: tuple[str, ...], what: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")


def market_rows(raw: DataFrame) -> DataFrame:
    """Renamed, typed and deduplicated market rows; other columns stay. Rows without a date or ticker go."""
    check_columns(raw, REQUIRED, "market frame")
    keys = [F.col("dlycaldt").cast("date").alias("datetime"), F.col("ticker").cast("string").alias("instrument")]
    prices = [as_number(F.col(c)).alias(name) for c, name in PRICES.items()]
    others = [c for c in raw.columns if c not in REQUIRED]
    rows = raw.select(*keys, *prices, *others).filter("datetime is not null and instrument is not null")
    return latest_capitalised(rows).withColumn("dollar_volume", F.col("close") * F.col("volume"))


def latest_capitalised(rows: DataFrame) -> DataFrame:
    """Of rows with the same keys, the one of the largest market_cap, rows without one last; prices settle ties."""
    order = [F.col(c).desc_nulls_last() for c in ("market_cap", *[p for p in PRICES.values() if p != "market_cap"])]
    best = Window.partitionBy("datetime", "instrument").orderBy(*order)
    return rows.withColumn("__best", F.row_number().over(best)).filter("__best = 1").drop("__best")


def with_label(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The return over the next rows of the instrument."""
    ahead = F.lead("close", horizon).over(_own())
    return panel.withColumn(LABEL, F.try_divide(ahead, F.col("close")) - 1.0)


def select_universe(raw: DataFrame, as_of: str, until: str, size: int) -> DataFrame:
    """(rank, instrument): the largest on the first date from as_of on, among those with a row on every date until the end.

    If fewer than size qualify, continuity is ignored. One aggregation by
    instrument has its first date, its cap then and its number of dates; only
    the top of that list, size rows, comes to the driver.
    """
    check_columns(raw, ("dlycaldt", "ticker", "dlycap"), "market frame")
    rows = raw if "shrcd" not in raw.columns else raw.filter(F.col("shrcd").isin(*SHARE_CODES))
    rows = rows.select(F.col("dlycaldt").cast("date").alias("d"), F.col("ticker").cast("string").alias("instrument"), as_number(F.col("dlycap")).alias("cap")).filter(F.col("d") >= F.lit(as_of).cast("date"))
    within = F.col("d") <= F.lit(until).cast("date")
    dates = rows.filter(within).agg(F.count_distinct("d")).first()[0]
    by_date = rows.filter("instrument is not null").groupBy("instrument", "d").agg(F.max("cap").alias("cap"))
    by = by_date.groupBy("instrument").agg(F.min(F.struct("d", "cap")).alias("first"), F.count_if(within).alias("n"))

    def top(df: DataFrame) -> list:
        """Up to size instruments on the least first date, the largest cap first."""
        found = df.orderBy("first.d", F.col("first.cap").desc_nulls_last(), "instrument").select("instrument", "first.d").limit(size).collect()
        return [r for r in found if r["d"] == found[0]["d"]]

    chosen = top(by.filter(F.col("n") == dates))
    if len(chosen) < size:
        chosen = top(by)
    if not chosen:
        raise ValueError("no trading day on or after the as-of date")
    return raw.sparkSession.createDataFrame([(k, r["instrument"]) for k, r in enumerate(chosen, 1)], "rank int, instrument string")


def effective_dates(facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """facts with the first date of the calendar (one column, datetime) strictly after they were filed; those after its end go.

    The calendar is laid out by day, each with the date that follows, so this is
    a join on equal days, which go to all tasks (one row a day); what was filed before the calendar counts as on the day before it.
    """
    dates = calendar.select("datetime").distinct()
    first = dates.agg(F.min("datetime")).first()[0]
    if first is None:
        return facts.withColumn("effective", F.lit(None).cast("date")).filter(F.lit(False))
    eve = F.date_sub(F.lit(first), 1)
    before = F.coalesce(F.lag("datetime").over(Window.orderBy("datetime")), eve)  # one row a date, few enough to order
    days = dates.withColumn("__before", before).select(F.explode(F.sequence("__before", F.date_sub("datetime", 1))).alias("__day"), F.col("datetime").alias("effective"))
    return facts.withColumn("__filed", F.greatest(F.col("filed").cast("date"), eve)).filter("filed is not null").join(F.broadcast(days), F.col("__filed") == F.col("__day")).drop("__filed", "__day")


def _filings(facts: DataFrame) -> DataFrame:
    """One row per (instrument, filed), a column for each field, and the trailing sum of four dividends."""
    check_columns(facts, ("instrument", "filed", "field", "value"), "facts")
    rows = facts.select(F.col("instrument").cast("string").alias("instrument"), F.col("filed").cast("date").alias("datetime"), "field", as_number(F.col("value")).alias("value"))
    rows = rows.filter("instrument is not null and datetime is not null")
    wide = rows.groupBy("instrument", "datetime").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FUNDAMENTALS], F.max(F.col("field") == DIVIDEND).alias("__paid"))
    paid = Window.partitionBy("instrument", "__paid").orderBy("datetime").rowsBetween(-3, 0)
    whole = F.count(DIVIDEND).over(paid) == F.count(F.lit(1)).over(paid)
    return wide.withColumn("__dividends", F.when(F.col("__paid") & whole, F.sum(DIVIDEND).over(paid)))


def with_fundamentals(panel: DataFrame, facts: DataFrame) -> DataFrame:
    """panel with the facts known on each date, the trailing dividends and the last filing's date (names in __)."""
    carried = (*FUNDAMENTALS, "__dividends")
    filings = _filings(facts).select("instrument", "datetime", *carried, F.col("datetime").alias("__filed"), F.lit(1).alias("__kind"))
    rows = panel.withColumn("__kind", F.lit(0)).unionByName(filings, allowMissingColumns=True)
    known = Window.partitionBy("instrument").orderBy("datetime", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(known) for c in (*carried, "__filed")})
    return rows.filter("__kind = 0").drop("__kind")


def price_ratio(close: Column, amount: Column, shares: Column) -> Column:
    """close / (amount / shares): without shares the amount per share is infinite and the ratio 0 with the amount's sign."""
    unlimited = F.when(amount > 0, close * 0.0).when(amount < 0, close * -0.0)
    return finite(F.when(shares == 0, unlimited).otherwise(F.try_divide(close, F.try_divide(amount, shares))))


def quarter_counter() -> Column:
    quarter = Window.partitionBy("instrument", F.trunc("datetime", "quarter")).orderBy("datetime")
    return (F.row_number().over(quarter) - 1).cast("double")


def with_event_fields(panel: DataFrame) -> DataFrame:
    """Valuation ratios and row counters since the quarter's start and since the last filing."""
    news = ~F.col("__filed").eqNullSafe(F.lag("__filed").over(_own()))
    panel = panel.withColumns({"__row": F.row_number().over(_own()), "__new": news & F.col("__filed").isNotNull()})
    since = F.last(F.when(F.col("__new"), F.col("__row")), ignorenulls=True).over(_own().rowsBetween(Window.unboundedPreceding, 0))
    close, shares = F.col("close"), F.col("funda_shares_out")
    panel = panel.withColumns({
        "funda_pe": price_ratio(close, F.col("funda_net_income"), shares),
        "funda_pb": price_ratio(close, F.col("funda_book_equity"), shares),
        "funda_div_yield": finite(F.try_divide(F.col("__dividends"), close)),
        "funda_days_since_disclosure": (F.col("__row") - since).cast("double"),
        "funda_days_since_quarter_start": quarter_counter(),
    })
    doubles = [c for c, kind in panel.dtypes if kind == "double"]
    return panel.withColumns({c: finite(F.col(c)) for c in doubles}).drop("__row", "__new", "__filed", "__dividends")


def build_panel(raw: DataFrame, facts: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The panel of raw market records and facts (instrument, filed, field, value)."""
    return with_event_fields(with_fundamentals(with_label(market_rows(raw), horizon), facts))


def slice_panel(panel: DataFrame, start: str, end: str, max_instruments: int | None = None) -> DataFrame:
    """Rows of a closed range of dates, and of the first instruments by name if so many are asked for."""
    rows = panel.filter(F.col("datetime").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if max_instruments is None:
        return rows
    first = rows.select("instrument").distinct().orderBy("instrument").limit(max_instruments)
    return rows.join(first, "instrument", "left_semi").select(*panel.columns)
