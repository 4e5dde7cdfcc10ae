"""The stored panel, in buckets by instrument."""

import pytest

from strataline.plans.compiler import evaluate_many
from strataline.sources.readers import read_panel_table
from strataline.sources.writers import write_panel_table

TEXTS = {"a": "TS_MEAN($close, 3)", "b": "TS_STD($close, 70)", "c": "DELTA($close, 2)", "d": "TS_SINCE(GT($close, 5))"}


@pytest.fixture(scope="module")
def panel(spark):
    return spark.range(900).selectExpr("date_add(date'2020-01-01', int(id / 9)) datetime", "concat('I', id % 9) instrument", "double(id * 7 % 11) close", "'x' note")


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_windows_along_instruments_need_no_exchange(spark, panel, tmp_path):
    path = str(tmp_path / "panel")
    write_panel_table(panel, path, 3)
    tables = {t.name for t in spark.catalog.listTables()}
    stored = read_panel_table(spark, path)
    assert stored.columns == panel.columns and sorted(map(tuple, stored.collect())) == sorted(map(tuple, panel.collect()))
    assert _exchanges(evaluate_many(stored, TEXTS)) == 0 and _exchanges(evaluate_many(panel, TEXTS)) == 1
    assert _exchanges(evaluate_many(stored, {"r": "CS_RANK(TS_MEAN($close, 3))"})) == 1
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(evaluate_many(stored, TEXTS).fillna(-1)) == order(evaluate_many(panel, TEXTS).fillna(-1))
    again = read_panel_table(spark, path)
    assert again.count() == 900 and len({t.name for t in spark.catalog.listTables()} - tables) == 1
