"""From expressions to decisions: many candidates, one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.compiler import EvalError, Plan, evaluate_many
from ..plans.grammar import ParseError, Program, parse
from .gate import TRAIN, VALIDATION, Thresholds, decide
from .metrics import daily_figures, daily_series, long_values, window_metrics
from .panel import LABEL


@dataclass(frozen=True)
class Split:
    """Closed date ranges."""

    train: tuple[str, str] = ("2015-01-01", "2020-12-31")
    validation: tuple[str, str] = ("2021-01-01", "2023-12-31")

    def windows(self) -> dict[str, tuple[str, str]]:
        return {TRAIN: self.train, VALIDATION: self.validation}


def checked(expressions: Mapping[str, str], max_nodes: int = 50) -> tuple[dict[str, Program], dict[str, str]]:
    """Programs that can be run, and what is wrong with the others; one bad candidate doesn't stop the rest."""
    good, bad = {}, {}
    for name, text in expressions.items():
        try:
            program = parse(text, max_nodes)
            Plan({name: program.resolved()})
        except (ParseError, EvalError) as e:
            bad[name] = str(e)
        else:
            good[name] = program
    return good, bad


def score_candidates(panel: DataFrame, programs: Mapping[str, str | Program], split: Split, max_nodes: int = 50, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values (wide), daily series and window metrics of all candidates; values come from the whole panel, once. keep: what makes the values and the figures last."""
    wide = evaluate_many(panel, programs, keep=(LABEL,), max_nodes=max_nodes)
    wide = keep(wide) if keep else wide
    figures = daily_figures(long_values(wide, list(programs), split.windows()))
    figures = keep(figures) if keep else figures
    return wide, daily_series(figures), window_metrics(figures)


def evaluate_candidates(panel: DataFrame, programs: Mapping[str, str | Program], split: Split, alignment: float | DataFrame, thresholds: Thresholds = Thresholds(), max_nodes: int = 50) -> DataFrame:
    """The gate's decision on each candidate."""
    return decide(score_candidates(panel, programs, split, max_nodes)[2], alignment, thresholds)
