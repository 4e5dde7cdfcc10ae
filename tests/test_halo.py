"""Chunks of time with halos against windows along whole instruments."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strataline.operators import halo
from strataline.plans.compiler import evaluate_many

TEXTS = {
    "mean": "TS_MEAN($close, 5)", "std": "TS_STD($close, 70)", "corr": "TS_CORR($close, $open, 9)", "rank": "TS_RANK($close, 6)", "delta": "DELTA($close, 4)", "delay": "DELAY($open, 11)",
    "since": "TS_SINCE(GT($close, 6))", "count": "TS_COUNT(GT($close, 6), 3)", "nested": "TS_MEAN(CS_RANK(TS_MAX($close, 8)), 6)",
}


@pytest.fixture(scope="module")
def panel(spark):
    """One instrument with most of the rows, some with few, gaps of months, and one without a name."""
    rng = random.Random(8)
    rows = []
    for name, n, step in (("long", 900, 1), ("short", 20, 1), ("sparse", 40, 35), ("late", 60, 3), (None, 30, 2)):
        day = dt.date(2015, 1, 1) + dt.timedelta(500 * (name == "late"))
        for _ in range(n):
            rows.append((day, name, *[None if rng.random() < 0.1 else float(rng.randint(0, 9)) for _ in range(2)]))
            day += dt.timedelta(rng.randint(1, 2 * step) if rng.random() < 0.98 else 200)
    return spark.createDataFrame(rows, "datetime date, instrument string, close double, open double").repartition(3).cache()


@pytest.mark.parametrize("rows_a_chunk", [1, 30, 200, 10**6])
@pytest.mark.parametrize("names", [("mean", "std", "corr"), ("rank", "delta", "delay", "count"), ("nested",), ("since", "mean")])
def test_chunks_equal_whole_instruments(panel, rows_a_chunk, names):
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[1]), r[0]))
    texts = {n: TEXTS[n] for n in names}
    got, want = order(evaluate_many(panel, texts, keep=("open",), rows_a_chunk=rows_a_chunk)), order(evaluate_many(panel, texts, keep=("open",)))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for a, b in zip(got, want, strict=True):
        assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)) for x, y in zip(a[3:], b[3:], strict=True)), (a, b)


def test_a_long_instrument_is_the_work_of_many_tasks(spark):
    long = spark.range(200_000).selectExpr("date_add(date'1600-01-01', int(id % 150000)) datetime", "if(id < 150000, 'long', concat('s', id)) instrument", "double(id % 97) close")
    dealt = halo.with_halo(long, 5_000, 250)
    sizes = dealt.filter("instrument = 'long'").groupBy(halo.CHUNK).agg(F.count("*").alias("n"), F.sum(F.col(halo.HALO).cast("int")).alias("copies")).collect()
    assert len(sizes) >= 29 and max(r["n"] for r in sizes) < 5_000 + 250 + 2 * halo.PERIOD
    assert sum(r["copies"] for r in sizes) < 0.1 * 150_000 and halo.without_halo(dealt).count() == 200_000


def test_empty_panel(panel):
    assert evaluate_many(panel.filter("false"), {"x": TEXTS["mean"]}, rows_a_chunk=10).isEmpty()
