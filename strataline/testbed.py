"""A panel derived from order and line item tables, on which the registered queries run.

A week of a supplier is a row: its first and last prices by date are open and
close, and so on. About a fifth of all weeks is missing, on purpose. Facts are
filed some days after the quarter's end. The same tables in SQL, as DuckDB
reads it, are in ``ORACLE``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.candidates import Split
from .operators.panel import build_panel, market_rows, with_label

SPLIT = Split(("1995-01-01", "1999-12-31"), ("2000-01-01", "2001-12-31"))
#: Line items of a task: what it holds stays the same when the table grows.
ROWS_A_TASK = 400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(spark: SparkSession, rows: DataFrame) -> int:
    """As many as there are cores, and more the more rows there are; the count is read from the files' footers."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_A_TASK))


def _week() -> Column:
    return F.date_trunc("week", "l_shipdate").cast("date")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of the market, from the one column that tells them."""
    return read(spark, sf_dir, "lineitem").select(_week().alias("datetime")).filter("datetime is not null").distinct()


def raw_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw market records: dlycaldt, ticker and the price columns.

    About every second line item is a row here, so they are dealt by week and
    supplier as they are: summed up before, they would be sorted twice.
    """
    rows = read(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    place = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    price = F.col("l_extendedprice")
    tasks = _tasks(spark, rows)
    weeks = rows.withColumn("dlycaldt", _week()).repartition(tasks, "dlycaldt", "l_suppkey").groupBy("dlycaldt", "l_suppkey").agg(
        F.min_by(price, place).alias("dlyopen"), F.max(price).alias("dlyhigh"), F.min(price).alias("dlylow"), F.max_by(price, place).alias("dlyclose"),
        F.sum("l_quantity").alias("dlyvol"), F.sum(price.cast("decimal(18,2)")).cast("double").alias("dlycap"),
    )
    ticker = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    weeks = weeks.withColumn("ticker", ticker).drop("l_suppkey").repartition(tasks, "ticker")
    return weeks.withColumn("dlyret", F.expr("try_divide(dlyclose, lag(dlyclose) over (partition by ticker order by dlycaldt)) - 1.0"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label(market_rows(raw_market(spark, sf_dir)))


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed facts: instrument, filed, field, value."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity")
    rows = lines.repartition(_tasks(spark, lines), "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    quarters = rows.groupBy("l_suppkey", F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("q")).agg(
        F.sum(price * (F.col("l_discount").cast("decimal(4,2)") - F.lit("0.05").cast("decimal(4,2)"))).cast("double").alias("funda_net_income"),
        (F.sum(price).cast("double") / 10.0).alias("funda_book_equity"),
        F.sum("l_quantity").alias("funda_shares_out"),
        (F.count(F.lit(1)) / F.lit(100.0)).alias("funda_div_per_share"),
    )
    filed = F.date_add(F.add_months("q", 3), (F.col("l_suppkey") % 20 - 1).cast("int")).alias("filed")
    instrument = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("instrument")
    fields = [c for c in quarters.columns if c.startswith("funda_")]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("f")
    return quarters.select(instrument, filed, each).select("instrument", "filed", "f.field", "f.value")


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_panel(raw_market(spark, sf_dir), raw_facts(spark, sf_dir))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of a user is a row: close is 1 on days with a purchase, volume the number of events."""
    day = F.col("ts").cast("date").alias("datetime")
    user = F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("instrument")
    return read(spark, sf_dir, "events").groupBy(day, user).agg(F.max((F.col("event_type") == "purchase").cast("double")).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


#: Common table expressions, each with those before it: cells, market, facts, panel, events_panel.
ORACLE = r"""
cells AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS datetime, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS instrument,
         arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
         sum(l_quantity) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS market_cap
  FROM lineitem GROUP BY ALL
), market AS (
  SELECT *, close * volume AS dollar_volume,
         close / nullif(lag(close) OVER i, 0) - 1.0 AS ret, lead(close, 10) OVER i / nullif(close, 0) - 1.0 AS label_fwd_10d
  FROM cells WINDOW i AS (PARTITION BY instrument ORDER BY datetime)
), quarters AS (
  SELECT l_suppkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(l_discount AS DECIMAL(4,2)) - CAST(0.05 AS DECIMAL(4,2)))) AS DOUBLE) AS funda_net_income,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 10.0 AS funda_book_equity,
         sum(l_quantity) AS funda_shares_out, count(*) / 100.0::DOUBLE AS funda_div_per_share
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
), filings AS (
  SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS instrument, CAST(q + INTERVAL 3 MONTH + to_days(CAST(l_suppkey % 20 - 1 AS INT)) AS DATE) AS filed,
         funda_net_income, funda_book_equity, funda_shares_out, funda_div_per_share FROM quarters
), facts AS (
  UNPIVOT filings ON funda_net_income, funda_book_equity, funda_shares_out, funda_div_per_share INTO NAME field VALUE value
), paid AS (
  SELECT *, sum(funda_div_per_share) OVER (PARTITION BY instrument ORDER BY filed ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS dividends FROM filings
), known AS (
  SELECT m.*, f.filed, f.funda_net_income, f.funda_book_equity, f.funda_shares_out, f.dividends,
         CAST(row_number() OVER (PARTITION BY m.instrument, date_trunc('quarter', m.datetime) ORDER BY m.datetime) - 1 AS DOUBLE) AS funda_days_since_quarter_start,
         row_number() OVER (PARTITION BY m.instrument ORDER BY m.datetime) AS rn
  FROM market m ASOF LEFT JOIN paid f ON m.instrument = f.instrument AND m.datetime > f.filed
), panel AS (
  SELECT * EXCLUDE (filed, dividends, rn),
         CASE WHEN funda_shares_out = 0 THEN CASE WHEN funda_net_income <> 0 THEN close * 0.0 * sign(funda_net_income) END
              ELSE close / nullif(funda_net_income / funda_shares_out, 0) END AS funda_pe,
         CASE WHEN funda_shares_out = 0 THEN CASE WHEN funda_book_equity <> 0 THEN close * 0.0 * sign(funda_book_equity) END
              ELSE close / nullif(funda_book_equity / funda_shares_out, 0) END AS funda_pb,
         dividends / nullif(close, 0) AS funda_div_yield,
         CASE WHEN filed IS NOT NULL THEN CAST(rn - min(rn) OVER (PARTITION BY instrument, filed) AS DOUBLE) END AS funda_days_since_disclosure
  FROM known
), events_panel AS (
  SELECT CAST(ts AS DATE) AS datetime, 'U' || user_id AS instrument, max(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)::DOUBLE AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY ALL
)
"""
