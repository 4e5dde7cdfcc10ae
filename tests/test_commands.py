import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from strataline import __main__ as shell
from strataline import commands
from strataline.operators.candidates import Split
from strataline.search.client import Client
from strataline.settings import Settings, read_settings
from strataline.sources import filings_client, readers, writers

SETTINGS = Settings(split=Split(("2020-01-01", "2020-03-31"), ("2020-04-01", "2020-12-31")), rounds=1, candidates=2, attempts=1)


class Model(Client):
    def complete(self, messages, model):
        return '{"rationale": "r", "expression": "CS_RANK(DELTA($close, 3))"}'

    def call_tool(self, messages, model, name, schema):
        return '{"fit": 1, "why": "j"}'


def raw(spark):
    rng = random.Random(1)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(d), t, 10, *[10 + rng.random() for _ in range(7)]) for d in range(150) for t in ("A", "B", "C", "D")]
    return spark.createDataFrame(rows, readers.MARKET_SCHEMA)


def test_from_files_to_report(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    raw(spark).write.option("header", True).csv(at("market"))
    facts = spark.createDataFrame([("A", dt.date(2020, 1, 10), "funda_net_income", 3.0)], "instrument string, filed date, field string, value double")
    writers.write_facts(facts, at("facts"))
    commands.make_panel(spark, at("facts"), at("panel"), market_csv=at("market"))
    panel = spark.read.parquet(at("panel"))
    assert panel.count() == 600 and panel.filter("funda_net_income = 3").count() == 140
    with pytest.raises(ValueError):
        commands.make_panel(spark, at("facts"), at("x"))
    commands.cut_panel(spark, at("panel"), at("cut"), "2020-02-01", "2020-02-10", 2)
    assert spark.read.parquet(at("cut")).count() == 20
    commands.evaluate_seeds(spark, at("panel"), at("seeds.json"), Model(), "m", SETTINGS)
    assert len(json.loads((tmp_path / "seeds.json").read_text())) == 5
    commands.seed_collection(spark, at("panel"), at("collection.json"), at("report.json"), Model(), "m", at("values"), at("daily"), SETTINGS)
    state = commands.search(spark, at("panel"), at("collection.json"), at("log.json"), Model(), "m", "m", at("values"), at("daily"), SETTINGS)
    assert len(state.records) == 2 and len(json.loads((tmp_path / "log.json").read_text())) == 2
    found = commands.validation_report(spark, at("panel"), at("collection.json"), at("log.json"), at("validation.json"), SETTINGS)
    assert set(found) == {"dsr", "pbo"}


def test_landing_and_reading_filings(spark, tmp_path):
    body = json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"filed": "2020-01-02", "val": 1}]}}}}})
    asked = []

    def get(url):
        asked.append(url)
        return body

    (tmp_path / "universe.txt").write_text(" brk/b \n\nzz\n")
    universe = readers.read_universe(spark, str(tmp_path / "universe.txt"))
    registry = spark.createDataFrame([("BRK/B", 12)], "ticker string, cik_str long")
    known, missing = readers.match_registry(universe, registry)
    assert [r["instrument"] for r in missing.collect()] == ["ZZ"]
    landed = list(filings_client.land_filings(spark, [tuple(r) for r in known.collect()], str(tmp_path / "land"), get, pause=lambda s: None))
    assert landed == ["BRK/B"] and asked[0].endswith("CIK0000000012.json")
    assert [tuple(r) for r in readers.read_filings(spark, str(tmp_path / "land")).collect()] == [("BRK/B", dt.date(2020, 1, 2), "funda_assets", 1.0)]


def test_values_of_many_factors(spark, tmp_path):
    rows = spark.createDataFrame([("f", dt.date(2020, 1, 1), "A", 1.0), ("g", dt.date(2020, 1, 1), "A", 2.0)], "factor string, datetime date, instrument string, value double")
    writers.write_values(rows, str(tmp_path / "values"))
    assert readers.read_values(spark, str(tmp_path / "values"), ["g"]).first()["value"] == 2.0
    assert set(commands.TIERS) == {1, 2, 3}


def test_facts_of_a_universe(spark, tmp_path):
    registry = json.dumps({"0": {"ticker": "aa", "cik_str": 7, "title": "x"}})
    body = json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"filed": "2020-01-02", "val": 4}]}}}}})
    (tmp_path / "universe.txt").write_text("AA\nQQ\n")
    at = lambda name: str(tmp_path / name)
    asked = []

    def get(url):
        asked.append(url)
        return registry if url == filings_client.REGISTRY_URL else body

    assert commands.fetch_facts(spark, at("universe.txt"), "me", at("land"), at("facts"), get, lambda s: None) == ["QQ"]
    assert (tmp_path / "land" / "missing.txt").read_text() == "QQ\n" and asked[1].endswith("CIK0000000007.json")
    assert [tuple(r) for r in readers.read_facts(spark, at("facts")).collect()] == [("AA", dt.date(2020, 1, 2), "funda_assets", 4.0)]


def test_settings(spark, tmp_path):
    document = {"data": {"train_start": "2001-01-01", "universe_size": 5}, "grammar": {"max_ast_nodes": 9}, "evaluation": {"min_abs_ic": 0.5}, "zoo": {"redundancy_threshold": 0.25}, "llm": {"generation_model": ""}, "odd": 3}
    (tmp_path / "a.json").write_text(json.dumps(document))
    (tmp_path / "b.json").write_text(json.dumps({"openrouter": {"default_generation_model": "g", "default_alignment_model": "a"}}))
    found = read_settings(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert found.split.train == ("2001-01-01", "2020-12-31") and (found.universe_size, found.max_nodes, found.thresholds.min_abs_ic, found.max_correlation) == (5, 9, 0.5, 0.25)
    assert (found.generation_model, found.alignment_model, found.rounds) == ("g", "a", 50)
    yaml = pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(document))
    assert read_settings(spark, str(tmp_path / "a.yaml"), str(tmp_path / "b.json")) == found


def test_tasks_from_a_shell(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    raw(spark).write.parquet(at("market"))
    writers.write_facts(spark.createDataFrame([], "instrument string, filed date, field string, value double"), at("facts"))
    shell.run(spark, ["build-panel", "--market-parquet", at("market"), "--facts-csv", at("facts"), "--output", at("panel")])
    shell.run(spark, ["slice-panel", "--panel", at("panel"), "--output", at("cut"), "--start-date", "2020-02-01", "--end-date", "2020-02-03"])
    assert spark.read.parquet(at("cut")).count() == 12
    split = {"data": {"train_start": "2020-01-01", "train_end": "2020-03-31", "validation_start": "2020-04-01", "validation_end": "2020-12-31"}, "mining": {"full_rounds": 1, "candidates_per_round": 1, "max_refinement_attempts": 1}}
    (tmp_path / "s.json").write_text(json.dumps(split | {"llm": {"generation_model": "g", "alignment_model": "a"}}))
    shell.run(spark, ["--settings", at("s.json"), "tier", "--number", "1", "--panel", at("panel"), "--folder", at("tier")], Model())
    assert {p.name for p in (tmp_path / "tier").iterdir() if p.suffix == ".json"} == {"collection.json", "seeds.json", "log.json", "report.json"}
    with pytest.raises(SystemExit):
        shell.arguments(["tier"])
    with pytest.raises(ValueError, match="models"):
        shell.run(spark, ["evaluate-seeds", "--panel", at("panel"), "--output", at("x")], Model())


def test_market_of_a_database(spark, tmp_path):
    """Records by JDBC, from a database in memory: filters by date and kind, the universe, and the whole build after it."""
    jars = spark.sparkContext._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    if jars.getResource("org/apache/derby/iapi/jdbc/AutoloadedDriver.class") is None:
        pytest.skip("no embedded database")
    rows = raw(spark).withColumns({c: F.lit(v[0]) for c, v in readers.COMMON_SHARES.items()})
    rows = rows.unionByName(rows.filter("ticker = 'A'").withColumns({"ticker": F.lit("FUND"), "securitytype": F.lit("FUND"), "dlycap": F.lit(1e9)}))
    url, table = "jdbc:derby:memory:market;create=true", "daily_market"
    kinds = ", ".join(f"{c} VARCHAR(20)" for c, kind in rows.dtypes if kind == "string")
    rows.write.format("jdbc").options(url=url, dbtable=table, createTableColumnTypes=kinds).save()
    at = lambda name: str(tmp_path / name)
    commands.fetch_market(spark, url, table, "2020-01-05", "2020-02-10", 3, at("market"), at("universe"))
    found = spark.read.parquet(at("market"))
    instruments = {r["instrument"] for r in readers.read_universe(spark, at("universe")).collect()}
    assert len(instruments) == 3 and instruments < {"A", "B", "C", "D"} and {r["ticker"] for r in found.select("ticker").distinct().collect()} == instruments
    assert found.count() == 3 * 37 and found.agg(F.min("dlycaldt"), F.max("dlycaldt")).first()[:] == (dt.date(2020, 1, 5), dt.date(2020, 2, 10))
    registry = json.dumps({"0": {"ticker": sorted(instruments)[0], "cik_str": 7}})
    body = json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"filed": "2020-01-08", "val": 4}]}}}}})
    get = lambda u: registry if u == filings_client.REGISTRY_URL else body
    panel = commands.build_data(spark, url, table, "me", at("all"), Settings(start="2020-01-05", end="2020-02-10", universe_size=3), get)
    assert spark.read.parquet(panel).filter("funda_assets = 4").count() == 33
