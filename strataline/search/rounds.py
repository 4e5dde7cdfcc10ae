"""Rounds of proposals. All candidates of a round are tested in one plan; those that fail are proposed anew together."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storing import stored
from ..operators import gate
from ..operators.candidates import Split, checked, score_candidates
from ..operators.collection import MAX_CORRELATION, NEAREST, Collection, Member, pair_correlations
from ..operators.metrics import METRICS
from ..plans.compiler import evaluate_many
from ..plans.grammar import parse
from ..plans.lookback import evaluate_between
from .alignment import Fit, Question, rate_fit
from .client import Client, first_object
from .prompt import describe_language


@dataclass(frozen=True)
class Proposal:
    rationale: str
    expression: str


@dataclass
class Attempt:
    """A candidate's last proposal, how often it was proposed, and what was wrong with it."""

    proposal: Proposal | None = None
    attempts: int = 0
    error: str | None = None
    parsed: bool = False


def ask(client: Client, model: str, feedback: list[str], error: str | None, max_nodes: int = 50) -> Proposal:
    messages = [
        {"role": "system", "content": describe_language(max_nodes)},
        {"role": "user", "content": json.dumps({"feedback": feedback, "last_error": error})},
    ]
    try:
        found = first_object(client.complete(messages, model))
        return Proposal(str(found["rationale"]), str(found["expression"]))
    except (KeyError, IndexError, TypeError) as e:
        raise ValueError(f"the answer lacks {e}") from None
    except OSError as e:  # a lost connection, an answer that never came
        raise ValueError(f"no answer: {e}") from None


def propose(client: Client, model: str, train: DataFrame, feedback: list[str], candidates: int = 8, attempts: int = 5, max_nodes: int = 50) -> list[Attempt]:
    """So many candidates that run and have a value on the training panel, as far as the attempts suffice."""
    found = [Attempt() for _ in range(candidates)]
    for turn in range(1, attempts + 1):
        open_ = {f"c{k}": a for k, a in enumerate(found) if not a.parsed}
        for a in open_.values():
            a.attempts = turn
            try:
                a.proposal, a.error = ask(client, model, feedback, a.error, max_nodes), None
            except ValueError as e:
                a.error = str(e)
        good, bad = checked({name: a.proposal.expression for name, a in open_.items() if a.error is None}, max_nodes)
        for name, error in bad.items():
            open_[name].error = error
        if good:
            counts = evaluate_many(train, good).agg(*[F.count(name).alias(name) for name in good]).first()
            for name in good:
                open_[name].parsed = counts[name] > 0
                open_[name].error = None if counts[name] else "no value in the training window"
        if all(a.parsed for a in found):
            break
    return found


@dataclass(frozen=True)
class Shelf:
    """Folders of what is kept of members: values on the validation window, and daily series of both windows."""

    values: str
    daily: str

    @staticmethod
    def key(name: str) -> str:
        return re.sub(r"[^A-Za-z0-9]+", "_", name)

    def keep(self, name: str, wide: DataFrame, daily: DataFrame, split: Split) -> dict[str, str]:
        """Write a candidate's values and daily series; where they are, by the member's attributes."""
        start, end = split.validation
        place = f"{self.values}/factor={self.key(name)}"
        dated = wide.filter(F.col("datetime").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        dated.select("datetime", "instrument", F.col(name).alias("value")).write.mode("overwrite").parquet(place)
        found = {"validation_values_path": place}
        for window in (gate.TRAIN, gate.VALIDATION):
            found[f"{window}_daily_ic_path"] = f"{self.daily}/{window}/factor={self.key(name)}"
            daily.filter((F.col("factor") == name) & (F.col("window") == window)).select("datetime", "daily_ic").coalesce(1).write.mode("overwrite").parquet(found[f"{window}_daily_ic_path"])
        return found


def member_values(spark: SparkSession, members: list[Member]) -> DataFrame:
    """(datetime, instrument, one column for each member), of the values that are kept. Members of one shelf are one scan of its dataset."""
    shelves: dict[str, dict[str, Member]] = {}
    for m in members:
        folder, _, own = m.validation_values_path.rstrip("/").rpartition("/")
        shelves.setdefault(folder, {})[own] = m
    schema = "datetime date, instrument string, value double"
    rows = None
    for folder, own in shelves.items():
        dealt = {place.removeprefix("factor="): m for place, m in own.items() if place.startswith("factor=")}
        parts = []
        if dealt:
            read = spark.read.schema(f"{schema}, factor string").option("basePath", folder).parquet(*[m.validation_values_path for m in dealt.values()])
            names = F.create_map(*[F.lit(x) for key, m in dealt.items() for x in (key, m.name)])
            parts.append(read.select("datetime", "instrument", names[F.col("factor")].alias("factor"), "value"))
        for place, m in own.items():
            if not place.startswith("factor="):
                parts.append(spark.read.schema(schema).parquet(m.validation_values_path).select("datetime", "instrument", F.lit(m.name).alias("factor"), "value"))
        for part in parts:
            rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("datetime", "instrument").agg(*[F.max(F.when(F.col("factor") == m.name, F.col("value"))).alias(m.name) for m in members])


@dataclass
class Search:
    """State of a run: the collection, feedback and records, and the folders of what members leave (None: nothing is kept)."""

    collection: Collection
    records: list[dict] = field(default_factory=list)
    feedback: list[str] = field(default_factory=list)
    shelf: Shelf | None = None


#: Saves a state; called after each candidate that was tested.
Save = Callable[[Search], None]


def try_round(panel: DataFrame, proposals: dict[str, Proposal], align: Callable[[str, Proposal, float | None], Fit], split: Split, state: Search, thresholds: gate.Thresholds = gate.Thresholds(), max_nodes: int = 50, max_correlation: float = MAX_CORRELATION, save: Save | None = None) -> None:
    """Gate and novelty of all proposals, in order; what is accepted counts for those after it.

    Values of all candidates are one plan and are written once; metrics,
    correlations and what is kept read them. A candidate whose alignment fails
    is recorded as an error.
    """
    good, _ = checked({name: p.expression for name, p in proposals.items()}, max_nodes)
    if not good:
        return
    wide, daily, table = score_candidates(panel, good, split, max_nodes, keep=stored)
    rows = {(r["factor"], r["window"]): r for r in table.collect()}
    fits: dict[str, Fit] = {}
    for name in good:
        try:
            row = rows.get((name, gate.TRAIN))
            fits[name] = align(name, proposals[name], row["ic"] if row else None)
        except Exception as e:  # noqa: BLE001  one failing call must not stop the others
            state.records.append({"name": name, "proposal": asdict(proposals[name]), "evaluated": False, "error": str(e)})
    spark = panel.sparkSession
    if not fits:
        return
    metric_rows = [(f, w, *[r[m] for m in METRICS]) for (f, w), r in rows.items() if f in fits]
    scores = spark.createDataFrame([(n, a.score) for n, a in fits.items()], "factor string, alignment double")
    metric_table = spark.createDataFrame(metric_rows, "factor string, window string, " + ", ".join(f"{m} double" for m in METRICS))
    decisions = {r["factor"]: r.asDict(True) for r in gate.decide(metric_table, scores, thresholds).collect()}
    correlations = _correlations(panel, wide, list(fits), state, split)
    for name in fits:
        decision = decisions[name] | {"alignment_justification": fits[name].why}
        to_members = [correlations.get((name, m.name), correlations.get((m.name, name))) for m in state.collection.members]
        near = sorted(zip([m.name for m in state.collection.members], to_members, strict=True), key=lambda x: -abs(x[1] or 0))[:NEAREST]
        novel = max((abs(rho) for _, rho in near if rho is not None), default=0.0) <= max_correlation
        accepted = decision["accepted"] and novel
        if accepted:
            places = state.shelf.keep(name, wide, daily, split) if state.shelf else {"validation_values_path": ""}
            state.collection.add(Member(name, proposals[name].rationale, proposals[name].expression, good[name].node_count, decision, **places), to_members)
            state.feedback = []
        elif not novel:
            state.feedback = [f"too close to what is there: {near}"]
        elif "alignment_score" in decision["failed_criteria"]:
            state.feedback = [fits[name].why]
        state.records.append({"name": name, "proposal": asdict(proposals[name]), "evaluated": True, "decision": decision, "nearest": near, "accepted": accepted, "breadth": state.collection.breadth(), "node_count": good[name].node_count})
        if save:
            save(state)


def _correlations(panel: DataFrame, wide: DataFrame, names: list[str], state: Search, split: Split) -> dict[tuple[str, str], float | None]:
    """Over the validation window, of candidates with members and each other. Members whose values aren't kept are evaluated anew."""
    members = state.collection.members
    pairs = [(a, b) for k, a in enumerate([*(m.name for m in members), *names]) for b in names[max(0, k - len(members) + 1) :]]
    if not pairs:
        return {}
    start, end = split.validation
    dated = F.col("datetime").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    values = wide.filter(dated).select("datetime", "instrument", *names)
    kept = [m for m in members if m.validation_values_path]
    if kept:
        values = values.join(member_values(panel.sparkSession, kept), ["datetime", "instrument"], "left")
    if others := {m.name: m.expression for m in members if not m.validation_values_path}:
        values = values.join(evaluate_between(panel, others, start, end), ["datetime", "instrument"], "left")
    return {(r["a"], r["b"]): r["rho"] for r in pair_correlations(values, pairs).collect()}


def run_search(panel: DataFrame, client: Client, generation_model: str, alignment_model: str, split: Split, rounds: int = 50, candidates: int = 8, attempts: int = 5, state: Search | None = None, save: Save | None = None, thresholds: gate.Thresholds = gate.Thresholds(), max_nodes: int = 50, max_correlation: float = MAX_CORRELATION) -> Search:
    """Propose and test, round by round; save is called after each candidate that was tested, and after each round."""
    state = state or Search(Collection())
    start, end = split.train
    train = panel.filter(F.col("datetime").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for number in range(1, rounds + 1):
        found = propose(client, generation_model, train, state.feedback, candidates, attempts, max_nodes)
        named = {f"round_{number}_candidate_{k}": a for k, a in enumerate(found, 1)}
        for name, a in named.items():
            if not a.parsed:
                state.records.append({"name": name, "proposal": a.proposal and asdict(a.proposal), "evaluated": False, "error": a.error, "attempts": a.attempts})
        ready = {name: a.proposal for name, a in named.items() if a.parsed}
        try_round(panel, ready, by_model(client, alignment_model, max_nodes), split, state, thresholds, max_nodes, max_correlation, save)
        if save:
            save(state)
    return state


def by_model(client: Client, model: str, max_nodes: int = 50) -> Callable[[str, Proposal, float | None], Fit]:
    """How a model rates proposals."""
    return lambda name, p, ic: rate_fit(client, model, Question(p.rationale, p.expression, parse(p.expression, max_nodes), ic))
