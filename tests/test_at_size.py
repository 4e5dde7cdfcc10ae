"""What shows on larger tables: results that stay those of the SQL, and tasks that stay small."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from strataline import queries, testbed
from strataline.operators import metrics


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with 2,000 line items of 20 suppliers and 60 weeks, and 500 orders."""
    folder = str(tmp_path_factory.mktemp("tables"))
    kinds = ("l_orderkey long", "l_partkey long", "l_suppkey long", "l_linenumber int", "l_quantity double", "l_extendedprice double", "l_discount double", "l_shipdate timestamp")
    values = ("id div 4", "id % 50", "id * 7 % 20", "int(id % 4)", "double(id % 9 + 1)", "double(id * 31 % 101 + 1)", "double(id % 10) / 100", "timestamp(date_add(date'1999-03-01', int(id * 11 % 420)))")
    spark.range(2000).selectExpr(*[f"{v} {k.split()[0]}" for k, v in zip(kinds, values, strict=True)]).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(500).selectExpr("id o_orderkey", "timestamp(date_add(date'1998-11-01', int(id % 420))) o_orderdate").write.parquet(f"{folder}/orders.parquet")
    return folder


def test_dsr_of_no_deviation_is_that_of_its_sql(spark, monkeypatch):
    ratios = {"reversal": 19.0, "level": 0.5, "turnover": 0.25, "spread": None}
    days = [(f, "validation", dt.date(2000, 1, 1) + dt.timedelta(d), 0.9 + 0.1 * (d % 2)) for f in ratios for d in range(40)]
    daily = spark.createDataFrame(days, "factor string, window string, datetime date, daily_ic double")
    table = spark.createDataFrame([(f, w, r) for f, r in ratios.items() for w in ("train", "validation")], "factor string, window string, icir double")
    monkeypatch.setattr(queries.testbed, "market", lambda spark, sf: None)
    monkeypatch.setattr(queries, "score_candidates", lambda *a, **k: (None, daily, table))
    (one,) = queries.QUERIES["dsr"](spark, "").collect()
    assert one["target"] == "reversal" and one["deviation"] == 0 and one["expected"] > 0
    assert math.isnan(one["dsr"]) and one["undefined_reason"] is None
    monkeypatch.setattr(queries, "score_candidates", lambda *a, **k: (None, daily.limit(0), table))
    assert queries.QUERIES["dsr"](spark, "").collect() == []


def test_the_calendar_of_facts_needs_no_market(spark, tables, monkeypatch):
    week = testbed.market(spark, tables).select("datetime").distinct().collect()
    assert sorted(testbed.calendar(spark, tables).collect()) == sorted(week)
    monkeypatch.setattr(testbed, "raw_market", lambda *a: pytest.fail("the market's prices are not asked for"))
    dates, facts = sorted(r[0] for r in week), testbed.raw_facts(spark, tables).collect()
    got = {(r["instrument"], r["filed"], r["field"]): r["effective"] for r in queries.QUERIES["effective_dates"](spark, tables).collect()}
    assert got == {(f["instrument"], f["filed"], f["field"]): min(d for d in dates if d > f["filed"]) for f in facts if f["filed"] < dates[-1]}


def test_tasks_of_the_market_grow_with_the_table(spark, tables, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    few = rows(testbed.market(spark, tables))
    assert testbed.raw_market(spark, tables).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(testbed, "ROWS_A_TASK", 100)
    many = testbed.raw_market(spark, tables)
    assert many.rdd.getNumPartitions() == 20 and rows(testbed.market(spark, tables)) == few
    assert testbed.raw_market(spark, tables)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2  # line items by week and supplier, weeks by supplier


@pytest.mark.parametrize("step, dates", [(1, 390), (7, 390)])
def test_dates_take_turns_on_tasks(spark, step, dates):
    wide = spark.range(dates * 3).selectExpr(f"date_add(date'1995-01-02', int(id div 3) * {step}) datetime", "concat('I', id % 3) instrument", "double(id) f", "double(id % 3) y")
    long = metrics.long_values(wide, ["f"], {"a": ("1995-01-01", "1998-12-31"), "b": ("1998-01-01", "2005-12-31")}, "y")
    tasks = long.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("datetime").alias("n"))
    assert tasks.agg(F.max("n")).first()[0] == 2  # 199 tasks
    assert metrics.daily_figures(long).columns[:3] == ["factor", "window", "datetime"] and "deal" not in metrics.daily_figures(long).columns
    plan = metrics.daily_figures(long)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2  # along instruments, and by date for both ranks and all figures
