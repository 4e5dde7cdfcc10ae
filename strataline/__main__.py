"""python -m strataline TASK ..: the tasks of ``commands`` from a shell."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import commands
from .search.client import HttpClient
from .settings import read_settings

#: Arguments of each task; those with a ? may be left out, those with # are whole numbers.
TASKS = {
    "fetch-market": ("url", "table", "start_date?", "end_date?", "universe_size?#", "output_market", "output_universe"),
    "fetch-facts": ("universe", "user_agent", "landing", "output"),
    "build-panel": ("market_csv?", "market_parquet?", "facts_csv", "output"),
    "build-data": ("url", "table", "user_agent", "folder"),
    "slice-panel": ("panel", "output", "start_date", "end_date", "max_instruments?#"),
    "evaluate-seeds": ("panel", "output"),
    "seed-collection": ("panel", "collection", "report", "values?", "daily?"),
    "search": ("panel", "collection", "log", "values?", "daily?"),
    "report": ("panel", "collection", "log", "report"),
    "tier": ("number#", "panel", "folder"),
}


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="strataline", description=__doc__)
    parser.add_argument("--settings", action="append", default=[], help="configuration files, each over those before it")
    parser.add_argument("--endpoint", default="", help="chat endpoint of the model; its key is in STRATALINE_KEY")
    tasks = parser.add_subparsers(dest="task", required=True)
    for task, names in TASKS.items():
        own = tasks.add_parser(task)
        for name in names:
            own.add_argument("--" + name.rstrip("?#").replace("_", "-"), required="?" not in name, type=int if "#" in name else str)
    return parser.parse_args(argv)


def run(spark: SparkSession, argv: list[str], client=None) -> object:
    given = vars(arguments(argv))
    task, endpoint, files = (given.pop(k) for k in ("task", "endpoint", "settings"))
    settings = read_settings(spark, *files)
    if task == "fetch-market":
        defaults = {"start_date": settings.start, "end_date": settings.end, "universe_size": settings.universe_size}
        return commands.fetch_market(spark, **{k: defaults.get(k) if v is None else v for k, v in given.items()})
    if task == "fetch-facts":
        return commands.fetch_facts(spark, **given)
    if task == "build-panel":
        return commands.make_panel(spark, **given)
    if task == "build-data":
        return commands.build_data(spark, **given, settings=settings)
    if task == "slice-panel":
        return commands.cut_panel(spark, **given)
    if task == "report":
        return commands.validation_report(spark, **given, settings=settings)
    client = client or HttpClient(endpoint, os.environ.get("STRATALINE_KEY", ""))
    models = {"generation_model": settings.generation_model, "alignment_model": settings.alignment_model}
    if not all(models.values()):
        raise ValueError("the settings name no models")
    if task == "evaluate-seeds":
        return commands.evaluate_seeds(spark, client=client, model=settings.alignment_model, settings=settings, **given)
    if task == "seed-collection":
        return commands.seed_collection(spark, client=client, model=settings.alignment_model, settings=settings, **given)
    if task == "search":
        return commands.search(spark, client=client, settings=settings, **models, **given)
    return commands.run_tier(spark, client=client, settings=settings, **models, **given)


if __name__ == "__main__":
    run(SparkSession.builder.appName("strataline").getOrCreate(), sys.argv[1:])
