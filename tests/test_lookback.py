"""Evaluation of a range of dates against evaluation of everything, on panels with gaps."""

import datetime as dt
import random

import pytest

from strataline.plans.compiler import evaluate_many
from strataline.plans.grammar import parse
from strataline.plans.lookback import evaluate_between, furthest, reaches

TEXTS = {
    "mean": "TS_MEAN($close, 5)",
    "rank": "CS_RANK(DELTA($close, 3))",
    "nested": "TS_MEAN(CS_RANK(TS_STD($close, 4)), 6)",
    "twice": "TS_MAX(CS_ZSCORE(TS_MEAN(CS_RANK(DELAY($open, 2)), 3)), 2)",
    "mixed": "x = TS_CORR($close, $open, 4)\nADD(x, CS_BUCKET(TS_RANK($close, 7), 3))",
    "plain": "ADD($close, 1)",
}


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    """Instruments with daily rows, with rows every few weeks, some that begin late or end early."""
    rng = random.Random(3)
    rows = []
    for k in range(12):
        step = (1, 1, 2, 9, 30)[k % 5]
        for d in range(rng.randint(0, 40), rng.randint(180, 300), step):
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(d), f"I{k}", *[None if rng.random() < 0.1 else rng.gauss(5, 2) for _ in range(2)]))
    path = str(tmp_path_factory.mktemp("panel") / "p")
    spark.createDataFrame(rows, "datetime date, instrument string, close double, open double").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("text, want", [
    ("$close", (0,)), ("TS_MEAN($close, 5)", (4,)), ("DELTA(TS_MEAN($close, 5), 3)", (7,)), ("CS_RANK($close)", (0, 0)), ("TS_MEAN(CS_RANK(DELTA($close, 3)), 20)", (19, 3)),
    ("ADD(TS_MEAN($close, 9), CS_RANK(TS_STD($close, 4)))", (8, 3)), ("CS_RANK(TS_SINCE($close))", None), ("DELAY($close, 0)", (0,)), ("TS_CORR($close, DELAY($open, 2), 10)", (11,)),
])
def test_reaches(text, want):
    assert reaches(parse(text).resolved()) == want
    assert furthest([parse(text).resolved(), parse("TS_MEAN($open, 2)").resolved()]) == (want and (max(want[0], 1), *want[1:]))


@pytest.mark.parametrize("start, end", [("2020-06-01", "2020-07-15"), ("2019-01-01", "2020-03-01"), ("2020-10-20", "2021-01-01"), ("2022-01-01", "2022-02-01")])
@pytest.mark.parametrize("names", [("mean",), ("rank",), ("nested",), ("twice",), tuple(TEXTS)])
def test_rows_equal_those_of_the_whole_panel(panel, start, end, names):
    texts = {n: TEXTS[n] for n in names}
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])
    want, got = order(evaluate_many(panel, texts).filter(f"datetime between date'{start}' and date'{end}'")), order(evaluate_between(panel, texts, start, end))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)) for x, y in zip(a[2:], b[2:], strict=True)), (a, b)


def test_the_scan_skips_what_is_not_needed(panel):
    plan = lambda text: evaluate_between(panel, {"x": text}, "2020-09-01", "2020-09-30")._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan(TEXTS["mean"]).splitlines() if "PushedFilters" in line)
    assert "LessThanOrEqual(datetime,2020-09-30)" in pushed and "GreaterThanOrEqual(datetime,2020-0" in pushed
    assert "GreaterThanOrEqual(datetime" not in next(line for line in plan("TS_SINCE($close)").splitlines() if "PushedFilters" in line)
