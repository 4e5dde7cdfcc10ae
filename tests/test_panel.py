import datetime as dt

import pytest

from strataline.operators import panel as P
from strataline.operators.facts import parse_facts


def day(n):
    return dt.date(2020, 1, n)


def market(spark, rows):
    """(date, ticker, close[, cap[, extra]])"""
    full = [(d, t, *[float(c)] * 4, 100.0, float(cap), 0.01, "x") for d, t, c, cap in rows]
    return spark.createDataFrame(full, "dlycaldt date, ticker string, dlyopen double, dlyhigh double, dlylow double, dlyclose double, dlyvol double, dlycap double, dlyret double, note string")


def facts(spark, rows):
    return spark.createDataFrame(rows, "instrument string, filed date, field string, value double")


def values(df, column):
    return [r[column] for r in df.orderBy("instrument", "datetime").collect()]


def test_facts_show_strictly_after_filing(spark):
    raw = market(spark, [(day(n), "A", 10, 1) for n in (2, 3, 6, 7)])
    out = P.build_panel(raw, facts(spark, [("A", day(3), "funda_net_income", 5.0), ("A", day(6), "funda_shares_out", 2.0)]))
    assert values(out, "funda_net_income") == [None, None, 5.0, 5.0]
    assert values(out, "funda_pe") == [None, None, None, 4.0]
    assert values(out, "funda_days_since_disclosure") == [None, None, 0.0, 0.0]
    assert values(out, "funda_days_since_quarter_start") == [0.0, 1.0, 2.0, 3.0]


def test_ragged_instruments_see_facts_on_their_next_row(spark):
    raw = market(spark, [(day(n), "A", 10, 1) for n in (2, 3, 6, 7)] + [(day(2), "B", 10, 1), (day(7), "B", 10, 1)])
    out = P.build_panel(raw, facts(spark, [("B", day(2), "funda_net_income", 5.0), ("B", day(4), "funda_net_income", 6.0)]))
    assert values(out.filter("instrument = 'B'"), "funda_net_income") == [None, 6.0]


def test_last_four_dividends(spark):
    raw = market(spark, [(day(n), "A", 10, 1) for n in range(2, 12)])
    paid = facts(spark, [("A", day(n), "funda_div_per_share", float(n - 1)) for n in range(2, 7)])
    out = P.build_panel(raw, paid)
    assert values(out, "funda_div_yield")[:7] == pytest.approx([None, 0.1, 0.3, 0.6, 1.0, 1.4, 1.4])


def test_price_ratio_without_shares(spark):
    raw = market(spark, [(day(n), "A", 10, 1) for n in (2, 3)])
    out = P.build_panel(raw, facts(spark, [("A", day(2), "funda_net_income", -5.0), ("A", day(2), "funda_shares_out", 0.0)]))
    assert values(out, "funda_pe") == [None, 0.0]


def test_duplicates_keep_the_largest(spark):
    raw = market(spark, [(day(2), "A", 1, 5), (day(2), "A", 2, 9), (day(2), "A", 3, 7)])
    out = P.market_rows(raw)
    assert values(out, "close") == [2.0] and values(out, "note") == ["x"]


def test_label_and_missing_columns(spark):
    raw = market(spark, [(day(n), "A", n, 1) for n in range(1, 14)])
    assert values(P.with_label(P.market_rows(raw)), P.LABEL)[:4] == [10.0, 5.0, pytest.approx(10 / 3), None]
    with pytest.raises(ValueError, match="dlycap"):
        P.market_rows(raw.drop("dlycap"))


def test_universe(spark):
    rows = [(day(n), t, 1, cap) for n in (2, 3, 6) for t, cap in (("A", 5), ("B", 7)) if (n, t) != (9, "A")]
    rows.append((day(2), "C", 1, 100))
    raw = market(spark, rows)
    assert [r["instrument"] for r in P.select_universe(raw, "2020-01-01", "2020-01-31", 2).orderBy("rank").collect()] == ["B", "A"]
    assert [r["instrument"] for r in P.select_universe(raw, "2020-01-01", "2020-01-31", 3).orderBy("rank").collect()] == ["C", "B", "A"]
    with pytest.raises(ValueError):
        P.select_universe(raw, "2021-01-01", "2021-01-31", 2)


def test_effective_dates(spark):
    calendar = spark.createDataFrame([(day(n),) for n in (3, 6)], "datetime date")
    filed = facts(spark, [("A", day(n), "f", 1.0) for n in (1, 3, 5, 6)])
    got = {r["filed"].day: r["effective"].day for r in P.effective_dates(filed, calendar).collect()}
    assert got == {1: 3, 3: 6, 5: 6}


def test_filing_documents(spark):
    text = '{"facts":{"us-gaap":{"Assets":{"units":{"USD":[{"filed":"2020-01-02","val":1},{"filed":"2020-01-02","val":2},{"val":3}]}},"CommonStockSharesOutstanding":{"units":{"s":[{"filed":"2020-01-02","val":4}]}},"EntityCommonStockSharesOutstanding":{"units":{"s":[{"filed":"2020-01-02","val":5}]}}},"dei":{"Assets":{"units":{"USD":[{"filed":"2020-01-03","val":9}]}}}}}'
    rows = spark.createDataFrame([("A", text), ("B", "{}"), ("C", "no json"), ("D", None)], "instrument string, payload string")
    got = {(r["instrument"], r["field"]): (r["filed"], r["value"]) for r in parse_facts(rows).collect()}
    assert got == {("A", "funda_assets"): (day(2), 2.0), ("A", "funda_shares_out"): (day(2), 5.0)}


def test_slice(spark):
    raw = P.market_rows(market(spark, [(day(n), t, 1, 1) for n in range(1, 5) for t in "BAC"]))
    out = P.slice_panel(raw, "2020-01-02", "2020-01-03", 2)
    assert sorted((r["datetime"].day, r["instrument"]) for r in out.collect()) == [(2, "A"), (2, "B"), (3, "A"), (3, "B")]
