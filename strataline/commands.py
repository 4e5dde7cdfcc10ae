"""The engine's tasks as functions of paths: build a panel, slice it, test the seeds, search, and report on overfitting."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, replace
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.storing import stored
from .operators import gate, overfitting
from .operators.candidates import Split, score_candidates
from .operators.collection import Collection
from .operators.panel import build_panel, select_universe, slice_panel
from .operators.seeds import SEEDS
from .plans.grammar import parse
from .search.client import Client
from .search.rounds import Proposal, Search, Shelf, by_model, run_search, try_round
from .settings import Settings
from .sources import filings_client, readers, writers


def fetch_market(spark: SparkSession, url: str, table: str, start_date: str, end_date: str, universe_size: int, output_market: str, output_universe: str, where: dict[str, tuple[str, ...]] | None = None, **options: str) -> None:
    """Market records of the universe, and the universe itself, one instrument a line."""
    rows = readers.read_market_database(spark, url, table, start_date, end_date, where, **options)
    universe = select_universe(rows, start_date, end_date, universe_size)
    rows.join(universe.select("instrument"), F.col("ticker") == F.col("instrument"), "left_semi").write.mode("overwrite").parquet(output_market)
    universe.orderBy("rank").select("instrument").coalesce(1).write.mode("overwrite").text(output_universe)


def fetch_facts(spark: SparkSession, universe: str, user_agent: str, landing: str, output: str, get: Callable[[str], str] | None = None, pause: Callable[[float], None] = time.sleep) -> list[str]:
    """Facts of the universe: its filing documents are landed and read. The instruments that the registry lacks are returned, and listed beside the documents."""
    get = get or (lambda url: filings_client.http_get(url, user_agent))
    known, unknown = readers.match_registry(readers.read_universe(spark, universe), filings_client.registry(spark, get))
    companies = [(r["instrument"], r["cik"]) for r in known.orderBy("instrument").collect()]  # as many as requests
    for _ in filings_client.land_filings(spark, companies, landing, get, pause):
        pass
    missing = [r["instrument"] for r in unknown.orderBy("instrument").collect()]
    writers.write_text(spark, f"{landing}/missing.txt", "".join(f"{i}\n" for i in missing))
    parse_filings(spark, landing, output)
    return missing


def parse_filings(spark: SparkSession, landing: str, output: str) -> None:
    """Facts from a landing folder of filing documents."""
    writers.write_facts(readers.read_filings(spark, landing), output)


def make_panel(spark: SparkSession, facts_csv: str, output: str, market_csv: str | None = None, market_parquet: str | None = None) -> None:
    writers.write_panel(build_panel(readers.read_market(spark, market_csv, market_parquet), readers.read_facts(spark, facts_csv)), output)


def build_data(spark: SparkSession, url: str, table: str, user_agent: str, folder: str, settings: Settings = Settings(), get: Callable[[str], str] | None = None, **options) -> str:
    """Market records, facts and the panel, one after the other; where the panel is."""
    at = lambda name: f"{folder}/{name}"
    fetch_market(spark, url, table, settings.start, settings.end, settings.universe_size, at("market"), at("universe"), **options)
    fetch_facts(spark, at("universe"), user_agent, at("filings"), at("facts"), get)
    make_panel(spark, at("facts"), at("panel"), market_parquet=at("market"))
    return at("panel")


def cut_panel(spark: SparkSession, panel: str, output: str, start_date: str, end_date: str, max_instruments: int | None = None) -> None:
    writers.write_panel(slice_panel(spark.read.parquet(panel), start_date, end_date, max_instruments), output)


def evaluate_seeds(spark: SparkSession, panel: str, output: str, client: Client, model: str, settings: Settings = Settings()) -> None:
    """The gate's decision on each seed, with its alignment scored by a model."""
    programs = {s.name: parse(s.expression, settings.max_nodes) for s in SEEDS}
    table = stored(score_candidates(spark.read.parquet(panel), programs, settings.split)[2])
    ic = {r["factor"]: r["ic"] for r in table.filter(F.col("window") == gate.TRAIN).collect()}
    rate = by_model(client, model, settings.max_nodes)
    fits = {s.name: rate(s.name, Proposal(s.rationale, s.expression), ic.get(s.name)) for s in SEEDS}
    scores = spark.createDataFrame([(n, a.score) for n, a in fits.items()], "factor string, alignment double")
    found = {r["factor"]: r.asDict(True) for r in gate.decide(table, scores, settings.thresholds).collect()}
    writers.write_json(spark, output, [{"seed": s.name, "node_count": programs[s.name].node_count, "decision": found.get(s.name)} for s in SEEDS])


def _shelf(values: str | None, daily: str | None) -> Shelf | None:
    return Shelf(values, daily or f"{values}_daily") if values else None


def seed_collection(spark: SparkSession, panel: str, collection: str, report: str, client: Client, model: str, values: str | None = None, daily: str | None = None, settings: Settings = Settings()) -> Search:
    """A new collection of those seeds that pass the gate and are novel; values, daily: folders of what members leave."""
    state = Search(Collection(), shelf=_shelf(values, daily))

    def save(now: Search) -> None:
        now.collection.save(spark, collection)
        writers.write_json(spark, report, now.records)

    proposals = {s.name: Proposal(s.rationale, s.expression) for s in SEEDS}
    try_round(spark.read.parquet(panel), proposals, by_model(client, model, settings.max_nodes), settings.split, state, settings.thresholds, settings.max_nodes, settings.max_correlation, save)
    save(state)
    return state


def search(spark: SparkSession, panel: str, collection: str, log: str, client: Client, generation_model: str, alignment_model: str, values: str | None = None, daily: str | None = None, settings: Settings = Settings()) -> Search:
    """A run of the search that goes on from a saved collection and saves it and the log after each candidate."""
    state = Search(Collection.load(spark, collection), shelf=_shelf(values, daily))

    def save(now: Search) -> None:
        now.collection.save(spark, collection)
        writers.write_json(spark, log, now.records)

    return run_search(
        spark.read.parquet(panel), client, generation_model, alignment_model, settings.split, settings.rounds, settings.candidates, settings.attempts,
        state, save, settings.thresholds, settings.max_nodes, settings.max_correlation,
    )


def validation_report(spark: SparkSession, panel: str, collection: str, log: str, report: str, settings: Settings = Settings()) -> dict:
    """Deflated ratio and overfitting probability of a saved collection. Daily series that weren't kept are computed anew, in one plan."""
    known = Collection.load(spark, collection)
    records = writers.read_json(spark, log)
    names = [m.name for m in known.members]
    moments, pbo = {}, overfitting.OverfittingProbability(None, 0, len(names), overfitting.BLOCKS, "fewer than two members")
    if names:
        daily = None
        for m in known.members:
            for window, path in ((gate.TRAIN, m.train_daily_ic_path), (gate.VALIDATION, m.validation_daily_ic_path)):
                if path:
                    own = spark.read.schema("datetime date, daily_ic double").parquet(path).select(F.lit(m.name).alias("factor"), F.lit(window).alias("window"), "datetime", "daily_ic")
                    daily = own if daily is None else daily.unionByName(own)
        if anew := {m.name: m.expression for m in known.members if not (m.train_daily_ic_path and m.validation_daily_ic_path)}:
            own = score_candidates(spark.read.parquet(panel), anew, settings.split)[1].select("factor", "window", "datetime", "daily_ic")
            daily = own if daily is None else daily.filter(~F.col("factor").isin(*anew)).unionByName(own)
        moments = {r["factor"]: r.asDict() for r in overfitting.moments(daily.filter(F.col("window") == gate.VALIDATION)).collect()}
        pbo = overfitting.overfitting_probability(daily.filter(F.col("window") == gate.TRAIN), names)
    found = {"dsr": asdict(overfitting.deflated_ratio(known.members, records, moments)), "pbo": asdict(pbo)}
    writers.write_json(spark, report, found)
    return found


class Tier(NamedTuple):
    """How much of the panel a run of the search takes; None: all of it, and the split of the settings."""

    rounds: int
    start: str | None = None
    end: str | None = None
    instruments: int | None = None
    split: Split | None = None


#: A smoke run, a medium run and the full one, each with its split.
TIERS = {
    1: Tier(1, "2020-01-02", "2020-02-07", 50, Split(("2020-01-02", "2020-01-21"), ("2020-01-22", "2020-01-24"))),
    2: Tier(5, "2020-01-01", "2021-03-31", None, Split(("2020-01-01", "2020-12-31"), ("2021-01-01", "2021-03-31"))),
    3: Tier(50),
}


def run_tier(spark: SparkSession, number: int, panel: str, folder: str, client: Client, generation_model: str, alignment_model: str, settings: Settings = Settings()) -> dict:
    """Cut the panel to the tier, seed a collection, search, and report on overfitting; all files go to folder."""
    tier = TIERS[number]
    own = panel
    if tier.start is not None:
        own = f"{folder}/panel"
        cut_panel(spark, panel, own, tier.start, tier.end, tier.instruments)
    settings = replace(settings, rounds=tier.rounds, split=tier.split or settings.split)
    at = lambda name: f"{folder}/{name}"
    seed_collection(spark, own, at("collection.json"), at("seeds.json"), client, alignment_model, at("values"), at("daily"), settings)
    search(spark, own, at("collection.json"), at("log.json"), client, generation_model, alignment_model, at("values"), at("daily"), settings)
    return validation_report(spark, own, at("collection.json"), at("log.json"), at("report.json"), settings)
