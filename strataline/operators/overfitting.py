"""Statistics against overfitting: the deflated ratio, and the probability of backtest overfitting by symmetric splits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist, stdev

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .collection import Member

#: Fixed values.
BLOCKS = 16
EULER_GAMMA = 0.5772
#: Digits to which means are compared, so that exact ties stay ties whatever the order of sums.
DIGITS = 12
#: Splits of a task.
SPLITS = 512


def moments(series: DataFrame, by: str = "factor", value: str = "daily_ic") -> DataFrame:
    """by, n, skew and excess_kurtosis: central moments over powers of the sample deviation; 0 for too few or constant values."""
    x = F.col(value)
    own = series.filter(x.isNotNull() & (F.abs(x) != float("inf"))).groupBy(by).agg(F.count(x).alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    shrink = (F.col("n") - 1) / F.col("n").cast("double")
    skew = F.when(F.col("n") >= 3, F.coalesce(F.col("g1") * F.pow(shrink, F.lit(1.5)), F.lit(0.0))).otherwise(0.0)
    kurtosis = F.when((F.col("n") >= 4) & F.col("g2").isNotNull(), (F.col("g2") + 3) * shrink * shrink - 3).otherwise(0.0)
    return own.select(by, "n", skew.alias("skew"), kurtosis.alias("excess_kurtosis"))


@dataclass(frozen=True)
class DeflatedRatio:
    """The target's ratio, what the best of so many trials reaches by chance, and the probability that it is beaten."""

    target: str | None
    trials: int
    icir: float | None = None
    expected: float | None = None
    deviation: float | None = None
    deviation_of_trials: float | None = None
    dsr: float | None = None
    undefined_reason: str | None = None


def _icir(metrics: dict | None) -> float:
    try:
        value = float(metrics["validation"]["icir"])
    except (KeyError, TypeError, ValueError):
        return math.nan
    return value


def is_trial(record: dict) -> bool:
    decision = record.get("decision")
    return isinstance(decision, dict) and all(isinstance(decision.get(w), dict) for w in ("train", "validation"))


def expected_best(deviation: float, trials: int) -> float:
    inverse = NormalDist().inv_cdf
    return deviation * ((1 - EULER_GAMMA) * inverse(1 - 1 / trials) + EULER_GAMMA * inverse(1 - 1 / (trials * math.e)))


def deflated_ratio(members: list[Member], records: list[dict], series: dict[str, dict[str, float]]) -> DeflatedRatio:
    """Of the member with the best validation ratio (the first of equals). series: moments by member, as one row each."""
    trials = [r for r in records if is_trial(r)]
    n = len(trials)
    if not members:
        return DeflatedRatio(None, n, undefined_reason="the collection is empty")
    with_ratio = [m for m in members if math.isfinite(_icir(m.metrics))]
    if not with_ratio:
        return DeflatedRatio(None, n, undefined_reason="no member has a finite validation ratio")
    target = max(with_ratio, key=lambda m: _icir(m.metrics))
    known = {"target": target.name, "trials": n, "icir": _icir(target.metrics)}
    if n < 2:
        return DeflatedRatio(**known, undefined_reason="fewer than two evaluated trials")
    ratios = [x for x in (_icir(r["decision"]) for r in trials) if math.isfinite(x)]
    if len(ratios) < 2:
        return DeflatedRatio(**known, undefined_reason="fewer than two trials with a finite ratio")
    known["deviation_of_trials"] = stdev(ratios)
    if known["deviation_of_trials"] == 0:
        return DeflatedRatio(**known, undefined_reason="the trials' ratios don't vary")
    own = series.get(target.name)
    if own is None or own["n"] < 2:
        return DeflatedRatio(**known, undefined_reason="the target has fewer than two finite days")
    r = known["icir"]
    variance = (1 - own["skew"] * r + (own["excess_kurtosis"] - 1) / 4 * r * r) / (own["n"] - 1)
    known["deviation"] = math.sqrt(max(0.0, variance))
    if known["deviation"] == 0:
        return DeflatedRatio(**known, undefined_reason="the target's standard error is zero")
    known["expected"] = expected_best(known["deviation_of_trials"], n)
    return DeflatedRatio(**known, dsr=NormalDist().cdf((r - known["expected"]) / known["deviation"]))


def complete_days(series: DataFrame, names: list[str]) -> DataFrame:
    """(factor, place, datetime, daily_ic) for the dates on which every named series has a value; place: order of names."""
    places = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])
    own = series.filter(F.col("factor").isin(names) & F.col("daily_ic").isNotNull())
    full = own.groupBy("datetime").agg(F.count_distinct("factor").alias("c")).filter(F.col("c") == len(names)).select("datetime")
    return own.join(full, "datetime", "left_semi").select("factor", places[F.col("factor")].alias("place"), "datetime", "daily_ic")


def blocks(days: DataFrame, n: int = BLOCKS) -> DataFrame:
    """days with block: contiguous runs of dates, the first ones a date longer if they don't divide evenly."""
    dates = days.select("datetime").distinct()  # one row a date, few enough to order
    label = (F.ntile(n).over(Window.orderBy("datetime")) - 1).alias("block")
    return days.join(dates.select("datetime", label), "datetime")


def split_results(blocked: DataFrame, n_members: int, n: int = BLOCKS) -> DataFrame:
    """(split, best, omega, log_odds): for each half of the blocks, the member that is best there and its standing in the other half.

    A split is a number whose bits are the blocks of one half. Splits are dealt in
    runs of SPLITS, each with the sums of all members' blocks (members times
    blocks numbers); a run's splits times those sums are one matrix product, and
    what leaves it is a row for each split.
    """
    sums = blocked.groupBy("place", "block").agg(F.sum("daily_ic").alias("s"), F.count("daily_ic").alias("c"))
    table = sums.agg(F.collect_list(F.struct("place", "block", "s", "c")).alias("cells")).filter(F.size("cells") > 0)
    runs = math.ceil(math.comb(n, n // 2) / SPLITS)
    dealt = table.select("cells", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).repartition(runs, "run")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = np.array([x for x in range(1 << n) if x.bit_count() == n // 2])
        for batch in batches:
            for k, run in enumerate(batch.column(1).to_pylist()):
                cells = batch.column(0).slice(k, 1).flatten()
                at = cells.field("place").to_numpy(), cells.field("block").to_numpy()
                total = np.zeros((2, n_members, n))
                total[0][at], total[1][at] = cells.field("s").to_numpy(), cells.field("c").to_numpy()
                split = halves[run * SPLITS : (run + 1) * SPLITS]
                inside = (split[:, None] >> np.arange(n) & 1).astype(float)
                within, beyond = (np.round((half @ total[0].T) / (half @ total[1].T), DIGITS) for half in (inside, 1 - inside))
                best = within.argmax(1)  # the first of equal ones
                own = beyond[np.arange(len(split)), best][:, None]
                omega = ((beyond < own).sum(1) + ((beyond == own).sum(1) + 1) / 2.0) / float(n_members + 1)
                yield pa.RecordBatch.from_arrays([pa.array(split, pa.int64()), pa.array(best, pa.int32()), pa.array(omega), pa.array(np.log(omega / (1 - omega)))], ["split", "best", "omega", "log_odds"])

    return dealt.mapInArrow(results, "split long, best int, omega double, log_odds double")


@dataclass(frozen=True)
class OverfittingProbability:
    pbo: float | None
    splits: int
    members: int
    blocks: int
    undefined_reason: str | None = None


def overfitting_probability(series: DataFrame, names: list[str], n: int = BLOCKS) -> OverfittingProbability:
    """Share of splits in which the best member of one half is in the lower half of the other. series: (factor, datetime, daily_ic)."""
    if len(names) < 2:
        return OverfittingProbability(None, 0, len(names), n, "fewer than two members")
    have = {r[0] for r in series.filter(F.col("factor").isin(names)).select("factor").distinct().collect()}
    stored = [x for x in names if x in have]
    if len(stored) < 2:
        return OverfittingProbability(None, 0, len(stored), n, "fewer than two members with a training series")
    days = complete_days(series, stored)
    if days.select("datetime").distinct().count() < n:
        return OverfittingProbability(None, 0, len(stored), n, "fewer training days than blocks")
    one = split_results(blocks(days, n), len(stored), n).agg(F.avg((F.col("log_odds") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("splits")).first()
    return OverfittingProbability(one["pbo"], one["splits"], len(stored), n)
