"""Compiles expressions into one staged DataFrame plan.

All expressions of a batch become one graph in which equal subtrees are one
node. Row-wise operators stay Column expressions. Window operators become
columns, in passes: all that are ready along instruments, then all that are
ready across dates, and so on. Passes of one kind share their partitioning, so
the exchanges depend on how often the kinds alternate, not on the number of
expressions. Ranks of several operands in a pass are taken in long form, by one
sort for all; long windows along an instrument are put together by doubling.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_number
from ..operators import crosssection, halo, ranking, scalar, sliding, timeseries
from ..operators.catalogue import SPECS
from .grammar import FieldRef, Literal, Node, OpCall, Program, parse, walk

KEYS = ("datetime", "instrument")


class EvalError(ValueError):
    """The expression parses but has no value."""


def fold(node: Node) -> Node:
    """Row-wise operators on numbers become numbers; a missing result stays a call."""
    if not isinstance(node, OpCall):
        return node
    args = tuple(fold(a) for a in node.args)
    if SPECS[node.op].kind == "scalar" and all(isinstance(a, Literal) for a in args):
        value = _folded(node.op, [a.value for a in args])
        if value is not None:
            return Literal(value)
    return OpCall(node.op, args)


def _folded(op: str, x: list[float]) -> float | None:
    rules = {
        "ADD": lambda: x[0] + x[1], "SUBTRACT": lambda: x[0] - x[1], "MULTIPLY": lambda: x[0] * x[1],
        "DIVIDE": lambda: x[0] / x[1] if x[1] else None, "ABS": lambda: abs(x[0]), "SIGN": lambda: float((x[0] > 0) - (x[0] < 0)),
        "LOG": lambda: math.log(x[0]) if x[0] > 0 else None, "POW": lambda: x[0] ** int(x[1]) if x[0] or x[1] >= 0 else None,
        "GT": lambda: float(x[0] > x[1]), "LT": lambda: float(x[0] < x[1]), "IF_THEN_ELSE": lambda: x[1] if x[0] else x[2],
    }
    try:
        value = rules[op]()
    except OverflowError:
        return None
    return float(value) if value is not None and not isinstance(value, complex) and math.isfinite(value) else None


class Plan:
    """The passes for a set of roots over a panel."""

    def __init__(self, roots: Mapping[str, Node]):
        self.roots = {name: fold(node) for name, node in roots.items()}
        self.columns: dict[Node, str] = {}
        self.uses: dict[Node, int] = {}
        for node in dict.fromkeys(n for r in self.roots.values() for n in walk(r)):
            for arg in node.args if isinstance(node, OpCall) else ():
                self.uses[arg] = self.uses.get(arg, 0) + 1
        calls = [n for n in dict.fromkeys(n for r in self.roots.values() for n in walk(r)) if isinstance(n, OpCall)]
        self.windows = [n for n in calls if SPECS[n.op].kind != "scalar"]
        for n in self.windows:
            if n.op == "TS_STD" and n.args[1].value < 2:
                raise EvalError("TS_STD needs two rows at least")
            if n.op == "CS_WINSORIZE":
                for bound in n.args[1:]:
                    _quantile(bound)
        self.shared = [n for n in calls if SPECS[n.op].kind == "scalar" and self.uses.get(n, 0) > 1]

    def passes(self) -> list[tuple[str, list[OpCall]]]:
        """(kind, nodes) in an order in which every node's windows come before it."""
        below = {n: {m for a in n.args for m in walk(a) if isinstance(m, OpCall) and SPECS[m.op].kind != "scalar"} for n in self.windows}
        done: set[Node] = set()
        out: list[tuple[str, list[OpCall]]] = []
        kind = "ts"
        while len(done) < len(self.windows):
            ready = [n for n in self.windows if n not in done and below[n] <= done]
            if not any(SPECS[n.op].kind == kind for n in ready):
                kind = "cs" if kind == "ts" else "ts"
            now = [n for n in ready if SPECS[n.op].kind == kind]
            out.append((kind, now))
            done.update(now)
        return out

    def apply(self, panel: DataFrame, keep: tuple[str, ...] = (), rows_a_chunk: int | None = None) -> DataFrame:
        """panel with a column for each root. Of its other columns at least ``keep`` are there, and those that no expression reads. rows_a_chunk: see evaluate_many."""
        if any(n.op == "TS_SINCE" for n in self.windows):
            panel = panel.withColumn(timeseries.ROW_NUMBER, F.row_number().over(timeseries.by_instrument()))
        read = {n.name for r in self.roots.values() for n in walk(r) if isinstance(n, FieldRef)}
        self.kept = [c for c in panel.columns if c in keep or c not in read]
        for kind, nodes in self.passes():
            panel = self._name_shared(panel)
            names = {n: f"__n{len(self.columns) + k}" for k, n in enumerate(nodes)}
            long = self._long(nodes)
            near = [n for n in nodes if n not in long]
            if kind == "cs" and long:
                panel = panel.repartition("datetime")  # before rows multiply
            chunked = kind == "ts" and rows_a_chunk is not None and all(n.op != "TS_SINCE" for n in nodes)
            if chunked:
                panel = halo.with_halo(panel, rows_a_chunk, max(map(_rows, nodes)))
            with timeseries.along("instrument", halo.CHUNK) if chunked else nullcontext():
                panel = panel.withColumns({names[n]: self.window(n) for n in near})
                if long:
                    panel = (self._long_windows if kind == "ts" else self._long_ranks)(panel, {n: names[n] for n in long}, {n: names[n] for n in near})
            if chunked:
                panel = halo.without_halo(panel)
            self.columns.update(names)
        panel = self._name_shared(panel)
        own = {timeseries.ROW_NUMBER, *self.columns.values()}
        return panel.withColumns({name: self.column(node) for name, node in self.roots.items()}).drop(*own)

    @staticmethod
    def _long(nodes: list[OpCall]) -> set[OpCall]:
        """Those of a pass that have a plan of their own: long windows, and ranks if there are several."""
        ranked = [n for n in nodes if n.op in ("CS_RANK", "CS_BUCKET", "CS_WINSORIZE")]
        many = len({n.args[0] for n in ranked}) >= ranking.MANY_OPERANDS
        return {n for n in nodes if n.op in sliding.RULES and sliding.is_long(n.op, _rows(n))} | set(ranked if many else ())

    def _long_windows(self, panel: DataFrame, names: dict[OpCall, str], _: dict[OpCall, str]) -> DataFrame:
        requests = []
        for n, name in names.items():
            operands = tuple(a for k, a in enumerate(n.args) if k != SPECS[n.op].literal)
            requests.append(sliding.Request(name, n.op, tuple(map(self.column, operands)), operands, _rows(n)))
        return sliding.add_long_windows(panel, requests, timeseries.by_instrument())

    def _long_ranks(self, panel: DataFrame, names: dict[OpCall, str], others: dict[OpCall, str]) -> DataFrame:
        operands = list(dict.fromkeys(n.args[0] for n in names))
        columns = list(map(self.column, operands))
        named = self.columns | others
        needed: set[str] = set()
        ahead = [*self.roots.values(), *[n for n in self.shared if n not in self.columns]]
        while ahead:
            n = ahead.pop()
            if n in named:
                needed.add(named[n])
            elif isinstance(n, FieldRef):
                needed.add(n.name)
            elif isinstance(n, OpCall) and n not in names:
                ahead += n.args
        rest = [c for c in panel.columns if c not in KEYS and (c in needed or c in self.kept)]
        bounds = list(dict.fromkeys(tuple(map(_quantile, n.args[1:])) for n in names if n.op == "CS_WINSORIZE"))
        panel, parts = ranking.rank_many(panel, columns, rest, any(n.op == "CS_BUCKET" for n in names), bounds)
        of = dict(zip(operands, parts, strict=True))
        rules = {"CS_RANK": lambda p, n: p["share"], "CS_BUCKET": lambda p, n: ranking.bucket_of(p, int(n.args[1].value)), "CS_WINSORIZE": lambda p, n: p[f"clip{bounds.index(tuple(map(_quantile, n.args[1:])))}"]}
        found = {name: rules[n.op](of[n.args[0]], n) for n, name in names.items()}
        return panel.select(*KEYS, *map(sliding.named, rest), *[c.alias(name) for name, c in found.items()])

    def _name_shared(self, panel: DataFrame) -> DataFrame:
        """Row-wise nodes with several users become columns, as soon as all windows below them are."""
        for n in self.shared:
            if n not in self.columns and all(m in self.columns for m in walk(n) if isinstance(m, OpCall) and SPECS[m.op].kind != "scalar"):
                name = f"__n{len(self.columns)}"
                panel = panel.withColumn(name, self.column(n))
                self.columns[n] = name
        return panel

    def column(self, node: Node) -> Column:
        if node in self.columns:
            return F.col(self.columns[node])
        if isinstance(node, Literal):
            return F.lit(node.value)
        if isinstance(node, FieldRef):
            return F.col(node.name)
        if node.op == "POW":
            return scalar.power(self.column(node.args[0]), int(node.args[1].value))
        return scalar.BUILDERS[node.op](*map(self.column, node.args))

    def window(self, node: OpCall) -> Column:
        spec = SPECS[node.op]
        if node.op == "CS_WINSORIZE":
            return crosssection.winsorize(self.column(node.args[0]), *map(_quantile, node.args[1:]))
        whole = int(node.args[spec.literal].value) if spec.literal is not None else None
        args = [self.column(a) for k, a in enumerate(node.args) if k != spec.literal]
        if spec.kind == "ts":
            return timeseries.BUILDERS[node.op](*args, *([] if whole is None else [whole]))
        rule = {"CS_RANK": crosssection.percent_rank, "CS_ZSCORE": crosssection.zscore, "CS_NEUTRALIZE": crosssection.neutralize, "CS_BUCKET": crosssection.bucket}[node.op]
        return rule(*args, *([] if whole is None else [whole]))


def _rows(node: OpCall) -> int:
    """The rows of a window along an instrument."""
    return int(node.args[SPECS[node.op].literal].value)


def _quantile(node: Node) -> float:
    if not isinstance(node, Literal):
        raise EvalError("CS_WINSORIZE takes numbers as its bounds")
    if not 0 <= node.value <= 1:
        raise EvalError("CS_WINSORIZE bounds are between 0 and 1")
    return node.value


def evaluate_many(panel: DataFrame, expressions: Mapping[str, str | Program], keep: tuple[str, ...] = (), max_nodes: int = 50, rows_a_chunk: int | None = None) -> DataFrame:
    """The panel's keys, the columns ``keep`` and one column for each expression.

    rows_a_chunk: for panels with instruments of very many rows. Passes along
    instruments then run in chunks of about so many rows, with the rows that
    windows look back to, which should be far fewer; a pass with TS_SINCE
    doesn't, as that may look back to the first row.
    """
    programs = {name: e if isinstance(e, Program) else parse(e, max_nodes) for name, e in expressions.items()}
    fields = sorted({f for p in programs.values() for f in p.fields})
    missing = [f for f in fields if f not in panel.columns]
    if missing:
        raise EvalError(f"the panel has no {', '.join(missing)}")
    clash = {*keep, *KEYS, *fields} & set(programs)
    if clash:
        raise EvalError(f"columns {sorted(clash)} would be there twice")
    read = panel.select(*KEYS, *[c for c in keep if c not in fields], *[as_number(F.col(f)).alias(f) for f in fields])
    return Plan({name: p.resolved() for name, p in programs.items()}).apply(read, keep, rows_a_chunk).select(*KEYS, *keep, *programs)


def evaluate(panel: DataFrame, expression: str | Program, name: str = "value", keep: tuple[str, ...] = (), max_nodes: int = 50) -> DataFrame:
    """(datetime, instrument, value) of one expression."""
    return evaluate_many(panel, {name: expression}, keep, max_nodes)
