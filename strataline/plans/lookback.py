"""How far back expressions look, and evaluation of a range of dates that reads no more than that.

A window along an instrument looks back so many of its rows; nested ones add up.
Behind a rank or mean across a date stand all instruments of that date, whose
rows may be sparser than those of the one that asks, so a path is a list of
reaches: rows before the first change of direction, rows before the next, and so
on. A reach becomes a date by the instruments' own rows, and that date is a
filter below all windows, which Spark pushes to the scan.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.catalogue import SPECS
from .compiler import evaluate_many
from .grammar import Node, OpCall, Program, parse

Reaches = tuple[int, ...]
_BACK = ("DELTA", "DELAY")


def reaches(node: Node) -> Reaches | None:
    """Rows of an instrument that come before those asked for, and after each change of direction those before these; None: all rows."""
    if not isinstance(node, OpCall):
        return (0,)
    below = [reaches(a) for a in node.args]
    if node.op == "TS_SINCE" or None in below:
        return None
    own = tuple(map(max, itertools.zip_longest(*below, fillvalue=0)))
    spec = SPECS[node.op]
    if spec.kind == "cs":
        return (0, *own)
    if spec.kind == "ts":
        rows = int(node.args[spec.literal].value)
        return (own[0] + (rows if node.op in _BACK else rows - 1), *own[1:])
    return own


def furthest(nodes: Iterable[Node]) -> Reaches | None:
    """The reaches of several expressions together."""
    every = [reaches(n) for n in nodes]
    return None if None in every else tuple(map(max, itertools.zip_longest(*every, fillvalue=0)))


def first_date(panel: DataFrame, start: str, end: str, back: Reaches):
    """The earliest date that rows from start to end depend on, by the instruments' own rows; None if there are no rows. One job over the keys for each reach that isn't 0."""
    begin = F.lit(start).cast("date")
    until = F.lit(end).cast("date")
    known = None
    for rows in back:
        if not rows:
            continue
        keys = panel.select("datetime", "instrument").filter(F.col("datetime") <= until)
        asked = keys.filter(F.col("datetime") >= begin).select(F.col("instrument").alias("i")).distinct()
        newest = Window.partitionBy("instrument").orderBy(F.col("datetime").desc())
        before = keys.filter(F.col("datetime") < begin).withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= rows)
        found = before.join(asked, F.col("instrument").eqNullSafe(F.col("i")), "left_semi").agg(F.min("datetime")).first()[0]
        if found is not None:
            known, begin = found, F.lit(found)
    return known


def evaluate_between(panel: DataFrame, expressions: Mapping[str, str | Program], start: str, end: str, keep: tuple[str, ...] = (), max_nodes: int = 50) -> DataFrame:
    """evaluate_many for the dates from start to end, which are included, reading the dates that these depend on."""
    programs = {name: e if isinstance(e, Program) else parse(e, max_nodes) for name, e in expressions.items()}
    back = furthest(p.resolved() for p in programs.values())
    until = F.lit(end).cast("date")
    begin = F.lit(start).cast("date")
    read = panel.filter(F.col("datetime") <= until)
    if back is not None:
        first = first_date(panel, start, end, back)
        read = read.filter(F.col("datetime") >= (begin if first is None else F.lit(first)))
    return evaluate_many(read, programs, keep, max_nodes).filter(F.col("datetime").between(begin, until))
