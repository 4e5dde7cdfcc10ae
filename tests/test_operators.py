"""Every operator against a plain definition, on a ragged panel with ties, missing values and infinities."""

import datetime as dt
import math
import random
from itertools import groupby

import pytest

from strataline.operators import ranking, sliding, timeseries
from strataline.plans.compiler import evaluate, evaluate_many

INF = float("inf")


@pytest.fixture(params=["as they come", "long forms"], autouse=True)
def forms(request, monkeypatch):
    """Everything holds for the plans of short windows and few ranks, and for those of long windows and many."""
    if request.param == "long forms":
        monkeypatch.setattr(sliding, "LONG_WINDOW", 1)
        monkeypatch.setattr(ranking, "MANY_OPERANDS", 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in "ABCDE":
        for d in range(40):
            if rng.random() < 0.85:
                value = lambda: None if rng.random() < 0.2 else float(rng.randint(-4, 4))
                out.append((dt.date(2020, 1, 1) + dt.timedelta(d), i, value(), value(), INF if rng.random() < 0.05 else value()))
    return sorted(out, key=lambda r: (r[1], r[0]))


@pytest.fixture(scope="module")
def panel(spark, rows):
    return spark.createDataFrame(rows, "datetime date, instrument string, close double, open double, ret double").repartition(3).cache()


def finite(x):
    return x is not None and math.isfinite(x)


def mean(v):
    return sum(v) / len(v)


def std(v):
    return math.sqrt(sum((x - mean(v)) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None


def corr(pairs):
    if len(pairs) < 2 or not all(math.isfinite(v) for p in pairs for v in p):
        return None
    a, b = zip(*pairs, strict=True)
    if std(a) == 0 or std(b) == 0:
        return None
    return sum((x - mean(a)) * (y - mean(b)) for x, y in pairs) / (len(pairs) - 1) / (std(a) * std(b))


def along(rows, rule):
    """rule(values of the instrument so far, place) for each row."""
    return {(r[0], r[1]): rule(g, k) for _, own in groupby(rows, lambda r: r[1]) for g in [list(own)] for k, r in enumerate(g)}


def across(rows, rule):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(r[0], []).append(r)
    return {(d, r[1]): v for d, g in by.items() for r, v in zip(g, rule(g), strict=True)}


def check(panel, text, expected):
    got = {(r["datetime"], r["instrument"]): r["value"] for r in evaluate(panel, text).collect()}
    assert got.keys() == expected.keys()
    for key, want in expected.items():
        have = got[key]
        assert have is None or not math.isnan(have)
        assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, abs=1e-9)), (text, key, have, want)


def window(c, n):
    return lambda g, k: [r[c] for r in g[max(0, k - n + 1) : k + 1] if finite(r[c])]


@pytest.mark.parametrize("op, rule", [("TS_MEAN", mean), ("TS_SUM", sum), ("TS_MIN", min), ("TS_MAX", max), ("TS_STD", std)])
@pytest.mark.parametrize("c, field", [(2, "close"), (4, "ret")])
def test_rolling(panel, rows, op, rule, c, field):
    check(panel, f"{op}(${field}, 4)", along(rows, lambda g, k: rule(w) if (w := window(c, 4)(g, k)) else None))


@pytest.mark.parametrize("lags", [40, 0])
def test_ts_rank(panel, rows, monkeypatch, lags):
    monkeypatch.setattr(timeseries, "RANK_LAGS", lags)

    def rule(g, k):
        x, w = g[k][2], window(2, 5)(g, k)
        return None if x is None else (sum(v < x for v in w) + (sum(v == x for v in w) + 1) / 2) / len(w)

    check(panel, "TS_RANK($close, 5)", along(rows, rule))
    plan = evaluate(panel, "TS_RANK($close, 5)")._jdf.queryExecution().executedPlan().toString()
    assert ("collect_list" in plan) == (lags == 0)


def test_delta_delay(panel, rows):
    lag = lambda g, k, n: g[k - n][2] if k >= n else None
    check(panel, "DELAY($close, 2)", along(rows, lambda g, k: lag(g, k, 2)))
    check(panel, "DELAY($close, 0)", along(rows, lambda g, k: g[k][2]))
    check(panel, "DELTA($close, 3)", along(rows, lambda g, k: None if g[k][2] is None or lag(g, k, 3) is None else g[k][2] - lag(g, k, 3)))


def test_ts_corr(panel, rows):
    def rule(g, k):
        return corr([(r[2], r[3]) for r in g[max(0, k - 5) : k + 1] if r[2] is not None and r[3] is not None])

    check(panel, "TS_CORR($close, $open, 6)", along(rows, rule))


def test_since_and_count(panel, rows):
    def since(g, k):
        return next((float(n) for n in range(k + 1) if g[k - n][2] not in (None, 0.0)), None)

    check(panel, "TS_SINCE($close)", along(rows, since))
    check(panel, "TS_COUNT($close, 4)", along(rows, lambda g, k: float(sum(r[2] not in (None, 0.0) for r in g[max(0, k - 3) : k + 1]))))


def test_cs_rank(panel, rows):
    def rule(g):
        v = [r[4] for r in g if r[4] is not None]
        return [None if r[4] is None else (sum(x < r[4] for x in v) + (sum(x == r[4] for x in v) + 1) / 2) / len(v) for r in g]

    check(panel, "CS_RANK($ret)", across(rows, rule))


def test_cs_zscore(panel, rows):
    def rule(g):
        v = [r[2] for r in g if r[2] is not None]
        s = std(v)
        return [None if r[2] is None or not s else (r[2] - mean(v)) / s for r in g]

    check(panel, "CS_ZSCORE($close)", across(rows, rule))


def quantile(v, p):
    v = sorted(v)
    at = p * (len(v) - 1)
    k = math.floor(at)
    return v[k] + (v[min(k + 1, len(v) - 1)] - v[k]) * (at - k)


@pytest.mark.parametrize("bounds", [(0.1, 0.8), (0.8, 0.1)])
def test_cs_winsorize(panel, rows, bounds):
    def rule(g):
        v = [r[2] for r in g if r[2] is not None]
        a, b = (quantile(v, p) for p in sorted(bounds)) if v else (0, 0)
        return [None if r[2] is None else min(max(r[2], a), b) for r in g]

    check(panel, f"CS_WINSORIZE($close, {bounds[0]}, {bounds[1]})", across(rows, rule))


def test_cs_neutralize(panel, rows):
    def rule(g):
        own = lambda r: [q[2] for q in g if q[3] == r[3] and q[2] is not None]
        return [None if r[2] is None else r[2] - mean(own(r)) for r in g]

    check(panel, "CS_NEUTRALIZE($close, $open)", across(rows, rule))


def test_cs_bucket(panel, rows):
    def rule(g):
        order = sorted((r[2], r[1]) for r in g if r[2] is not None)
        return [None if r[2] is None else float(math.ceil((order.index((r[2], r[1])) + 1) / len(order) * 3)) for r in g]

    check(panel, "CS_BUCKET($close, 3)", across(rows, rule))


SCALARS = {
    "ADD($close, $open)": lambda a, b, r: None if a is None or b is None else a + b,
    "SUBTRACT($close, $open)": lambda a, b, r: None if a is None or b is None else a - b,
    "MULTIPLY($close, $ret)": lambda a, b, r: None if a is None or r is None or (a == 0 and r == INF) else a * r,
    "SUBTRACT($ret, $ret)": lambda a, b, r: None if r is None or r == INF else 0.0,
    "DIVIDE($close, $open)": lambda a, b, r: None if a is None or not b else a / b,
    "ABS($close)": lambda a, b, r: None if a is None else abs(a),
    "SIGN($close)": lambda a, b, r: None if a is None else float((a > 0) - (a < 0)),
    "LOG($close)": lambda a, b, r: math.log(a) if a is not None and a > 0 else None,
    "POW($close, 2)": lambda a, b, r: None if a is None else a * a,
    "POW($close, 0)": lambda a, b, r: 1.0,
    "POW($close, -1)": lambda a, b, r: None if a is None else INF if a == 0 else 1 / a,
    "GT($close, $open)": lambda a, b, r: None if a is None or b is None else float(a > b),
    "LT($close, $open)": lambda a, b, r: None if a is None or b is None else float(a < b),
    "IF_THEN_ELSE($close, $open, 7)": lambda a, b, r: 7.0 if not a else b,
}


@pytest.mark.parametrize("text", SCALARS)
def test_scalars(panel, rows, text):
    check(panel, text, {(r[0], r[1]): SCALARS[text](*r[2:]) for r in rows})


def test_a_batch_equals_its_parts(panel):
    texts = {"a": "CS_RANK(TS_MEAN($close, 3))", "b": "TS_STD(CS_RANK(TS_MEAN($close, 3)), 4)", "c": "x = ADD($close, $open)\nSUBTRACT(CS_RANK(x), TS_MEAN(x, 2))", "d": "CS_NEUTRALIZE(CS_RANK($open), CS_BUCKET($close, 2))"}
    together = evaluate_many(panel, texts).orderBy("instrument", "datetime").collect()
    for name, text in texts.items():
        alone = evaluate(panel, text).orderBy("instrument", "datetime").collect()
        assert [r[name] for r in together] == [r["value"] for r in alone]


def test_zero_variance_is_missing(panel):
    assert evaluate(panel, "TS_CORR(POW($close, 0), $open, 5)").filter("value is not null").count() == 0
    assert evaluate(panel, "CS_ZSCORE(POW($close, 0))").filter("value is not null").count() == 0


def test_empty_panel(panel):
    assert evaluate(panel.filter("false"), "CS_RANK(TS_MEAN($close, 3))").count() == 0


def test_one_exchange_for_each_change_of_direction(panel):
    texts = {f"f{k}": f"CS_RANK(DELTA($close, {k}))" for k in range(1, 9)}
    plan = evaluate_many(panel.repartition("instrument"), texts)._jdf.queryExecution().sparkPlan().toString()
    assert "Python" not in plan
    from strataline.plans.compiler import Plan
    from strataline.plans.grammar import parse

    assert len(Plan({k: parse(v).resolved() for k, v in texts.items()}).passes()) == 2


def _sorts_and_exchanges(df, panel):
    """In the plan of df, beyond what the panel's own plan has."""
    own, base = (x._jdf.queryExecution().executedPlan().toString() for x in (df, panel))
    return own.count("Sort [") - base.count("Sort ["), own.count("Exchange ") - base.count("Exchange ")


def test_sorts_do_not_grow_with_the_ranks_of_a_batch(panel, monkeypatch):
    monkeypatch.setattr(ranking, "MANY_OPERANDS", 4)
    counts = set()
    for n in (8, 64, 400):
        texts = {f"f{k}": f"CS_RANK(DELTA(${('close', 'open', 'ret')[k % 3]}, {1 + k // 3}))" for k in range(n)}
        counts.add(_sorts_and_exchanges(evaluate_many(panel, texts), panel))
    assert counts == {(2, 2)}  # by instrument, and by value


def test_ranks_and_buckets_share_a_sort(panel, monkeypatch):
    monkeypatch.setattr(ranking, "MANY_OPERANDS", 4)
    texts = {f"f{k}": f"ADD(CS_RANK(ADD($close, {k})), CS_BUCKET(ADD($close, {k}), 5))" for k in range(6)}
    assert _sorts_and_exchanges(evaluate_many(panel, texts), panel) == (1, 1)


def test_winsorizing_many_shares_the_sort(panel, monkeypatch):
    monkeypatch.setattr(ranking, "MANY_OPERANDS", 4)
    texts = {f"f{k}": f"CS_WINSORIZE(ADD($close, {k}), 0.{1 + k % 2}, 0.8)" for k in range(6)} | {"r": "CS_RANK($open)"}
    many = evaluate_many(panel, texts)
    assert _sorts_and_exchanges(many, panel) == (1, 1) and "percentile" not in many._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ranking, "MANY_OPERANDS", 100)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])
    assert order(many) == order(evaluate_many(panel, texts))


def test_long_windows_need_no_sort_of_their_own(panel, monkeypatch):
    monkeypatch.setattr(sliding, "LONG_WINDOW", 64)
    texts = {"a": "TS_MEAN($close, 252)", "b": "TS_STD($close, 100)", "c": "TS_CORR($close, $open, 64)", "d": "TS_MAX($ret, 1000)", "e": "TS_SUM($close, 10)"}
    assert _sorts_and_exchanges(evaluate_many(panel, texts), panel) == (1, 1)


@pytest.mark.parametrize("n", [3, 7, 8, 21, 64])
def test_long_windows_equal_short_ones(panel, monkeypatch, n):
    texts = {op: f"{op}($ret, {n})" for op in ("TS_MEAN", "TS_SUM", "TS_MIN", "TS_MAX", "TS_STD", "TS_COUNT")} | {"TS_CORR": f"TS_CORR($ret, ADD($open, $ret), {n})"}
    both = []
    for least in (1, 1000):
        monkeypatch.setattr(sliding, "LONG_WINDOW", least)
        both.append(sorted(evaluate_many(panel, texts).collect(), key=lambda r: (r[1], r[0])))
    for a, b in zip(*both, strict=True):
        assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)) for x, y in zip(a[2:], b[2:], strict=True)), (a, b)


def test_a_constant_in_a_long_window_does_not_vary(spark, monkeypatch):
    monkeypatch.setattr(sliding, "LONG_WINDOW", 2)
    days = spark.range(300).selectExpr("date_add(date'2020-01-01', int(id)) datetime", "'A' instrument", "0.1D close", "if(id % 7 = 0, 1e15D, 3.3D) open")
    found = evaluate_many(days, {"s": "TS_STD($close, 100)", "c": "TS_CORR($close, $open, 90)", "t": "TS_STD($open, 3)"}).orderBy("datetime").collect()
    assert {r["s"] for r in found[1:]} == {0.0} and {r["c"] for r in found} == {None}
    assert {r["t"] for r in found[3:] if r["t"] < 1e9} == {0.0}  # a large value that has left leaves no trace


def test_extra_and_kept_columns_go_through_long_ranks(panel):
    from pyspark.sql import functions as F

    odd = panel.withColumns({"a.b": F.lit("x"), "k": F.lit(1)})
    texts = {f"f{k}": f"TS_MEAN(CS_RANK(ADD($close, {k})), 2)" for k in range(5)}
    found = evaluate_many(odd, texts, keep=("close", "k"))
    assert found.columns == ["datetime", "instrument", "close", "k", *texts] and found.count() == panel.count()
    assert sorted((r[0], r[1], r[2] is None, r[2]) for r in found.select("datetime", "instrument", "close").collect()) == sorted((r[0], r[1], r[2] is None, r[2]) for r in panel.select("datetime", "instrument", "close").collect())
