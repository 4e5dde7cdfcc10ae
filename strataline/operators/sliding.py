"""Aggregates over long trailing windows by doubling: linear in rows times the logarithm of the window.

The aggregate of the last 2 ** (k + 1) rows is that of the last 2 ** k rows
merged with the same of 2 ** k rows before. A window of n rows is put together
from those of its binary digits, newest first; minimum and maximum take two
that overlap. Every level is a lag within the order that windows along an
instrument have anyway, so nothing is sorted or exchanged again, and operators
of any window length over the same operand share its levels. Moments are merged
by their counts and means (the pairwise rule), so nothing cancels, and values
that have left a window leave no trace.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import finite, null_if_nan, truthy

#: Windows whose rows times an operator's work a row are so many at least are put together by doubling; shorter ones are read row by row.
LONG_WINDOW = 64

State = dict[str, Column]


class Kind(NamedTuple):
    """What is known about some rows. Missing parts stand for no rows; overlap: rows may be counted twice."""

    first: Callable[..., State]
    merge: Callable[[State, State], State]
    overlap: bool = False


def _either(both: Column, a: Column, b: Column) -> Column:
    """both, which is missing where a or b is; then the other one."""
    return F.coalesce(both, a, b)


def _sum_merge(a: State, b: State) -> State:
    return {k: _either(a[k] + b[k], a[k], b[k]) for k in ("s", "c")}


def _moments_merge(a: State, b: State) -> State:
    """Of one value (x) or two (x and y)."""
    c = _either(a["c"] + b["c"], a["c"], b["c"])
    share = F.try_divide(b["c"], a["c"] + b["c"])
    out = {"c": c}
    apart = {v: b[f"m{v}"] - a[f"m{v}"] for v in "xy" if f"m{v}" in a}
    for v, d in apart.items():
        out[f"m{v}"] = _either(a[f"m{v}"] + d * share, a[f"m{v}"], b[f"m{v}"])
    for k in [k for k in a if len(k) == 2 and k[0] in "xy"]:
        out[k] = _either(a[k] + b[k] + apart[k[0]] * apart[k[1]] * a["c"] * share, a[k], b[k])
    return out


def _moments(x: Column) -> State:
    there = x.isNotNull()
    return {"c": F.when(there, 1.0), "mx": x, "xx": F.when(there, 0.0)}


def _pairs(x: Column, y: Column) -> State:
    both = x.isNotNull() & y.isNotNull()
    return {"c": F.when(both, 1.0), "mx": F.when(both, x), "my": F.when(both, y)} | {k: F.when(both, 0.0) for k in ("xx", "yy", "xy")}


SUM = Kind(lambda x: {"s": x, "c": F.when(x.isNotNull(), 1.0)}, _sum_merge)
LEAST = Kind(lambda x: {"v": x}, lambda a, b: {"v": F.least(a["v"], b["v"])}, True)
MOST = Kind(lambda x: {"v": x}, lambda a, b: {"v": F.greatest(a["v"], b["v"])}, True)
MOMENTS = Kind(_moments, _moments_merge)
PAIRS = Kind(_pairs, _moments_merge)


def _correlation(s: State) -> Column:
    n = s["c"] - 1
    return F.when(n > 0, null_if_nan(F.try_divide(F.try_divide(s["xy"], n), F.sqrt(F.try_divide(s["xx"], n)) * F.sqrt(F.try_divide(s["yy"], n)))))


class Rule(NamedTuple):
    """How an operator uses a kind: what it makes of its operands before, and of the window's state. work: of a row that is read, beside that of a sum."""

    kind: Kind
    operand: Callable[[Column], Column]
    result: Callable[[State], Column]
    work: int = 1


RULES = {
    "TS_MEAN": Rule(SUM, finite, lambda s: F.try_divide(s["s"], s["c"])),
    "TS_SUM": Rule(SUM, finite, lambda s: s["s"]),
    "TS_COUNT": Rule(SUM, lambda x: F.when(truthy(x), 1.0).otherwise(0.0), lambda s: s["s"]),
    "TS_MIN": Rule(LEAST, finite, lambda s: s["v"]),
    "TS_MAX": Rule(MOST, finite, lambda s: s["v"]),
    "TS_STD": Rule(MOMENTS, finite, lambda s: F.when(s["c"] > 1, F.sqrt(F.try_divide(s["xx"], s["c"] - 1))), 2),
    "TS_CORR": Rule(PAIRS, lambda x: x, _correlation, 8),
}


def is_long(op: str, rows: int) -> bool:
    return rows * RULES[op].work >= LONG_WINDOW


class Request(NamedTuple):
    """A column to be added: an operator, its operands with a key that is equal for equal ones, and the rows of the window."""

    name: str
    op: str
    operands: tuple[Column, ...]
    key: tuple
    rows: int


def add_long_windows(df: DataFrame, requests: list[Request], window) -> DataFrame:
    """df with the column of each request. window: ordered, along which rows are counted."""
    groups: dict[tuple, list[Request]] = {}
    for r in requests:
        rule = RULES[r.op]
        groups.setdefault((id(rule.kind), id(rule.operand), r.key), []).append(r)
    levels: list[tuple[Kind, str, list[Request]]] = []
    first: dict[str, Column] = {}
    fields: dict[str, list[str]] = {}
    for g, own in enumerate(groups.values()):
        rule = RULES[own[0].op]
        state = rule.kind.first(*map(rule.operand, own[0].operands))
        levels.append((rule.kind, f"__s{g}_", own))
        fields[f"__s{g}_"] = list(state)
        first |= {f"__s{g}_{k}": c for k, c in state.items()}
    kept = list(df.columns)
    df = df.select(*map(named, kept), *[c.alias(k) for k, c in first.items()])
    covered: dict[str, int] = {}  # rows that a request's own state has so far
    for level in range(max(r.rows for r in requests).bit_length()):
        size = 1 << level
        lags: dict[str, Column] = {}
        after: dict[str, Column] = {}
        merges: list[tuple[Kind, str, State, State]] = []
        for kind, at, own in levels:
            now = {k: F.col(at + k) for k in fields[at]}

            def back(rows: int, at: str = at, now: State = now) -> State:
                for k, c in now.items():
                    lags.setdefault(f"{at}{k}_{rows}", F.lag(c, rows).over(window))
                return {k: F.col(f"{at}{k}_{rows}") for k in now}

            for r in own:
                mine = f"__r{r.name}_"
                if kind.overlap:
                    if r.rows.bit_length() == level + 1:
                        whole = r.rows == size
                        merges.append((kind, mine, now, now if whole else back(r.rows - size)))
                        covered[r.name] = r.rows
                elif r.rows & size:
                    done = covered.get(r.name, 0)
                    if done:
                        merges.append((kind, mine, {k: F.col(mine + k) for k in now}, back(done)))
                    else:
                        after |= {mine + k: c for k, c in now.items()}
                    covered[r.name] = done + size
            if any(r.rows.bit_length() > level + 1 for r in own):
                merges.append((kind, at, now, back(size)))
        if lags:
            df = df.withColumns(lags)
        for kind, at, a, b in merges:
            after |= {at + k: c for k, c in (a if a is b else kind.merge(a, b)).items()}
        held = [f"__r{r.name}_{k}" for _, at, own in levels for r in own if r.name in covered for k in fields[at]]
        df = df.select(*map(named, kept), *[after.get(c, F.col(c)).alias(c) for c in held], *[c.alias(k) for k, c in after.items() if k.startswith("__s")])
    results = [RULES[r.op].result({k: F.col(f"__r{r.name}_{k}") for k in fields[at]}).alias(r.name) for _, at, own in levels for r in own]
    return df.select(*map(named, kept), *results)


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
