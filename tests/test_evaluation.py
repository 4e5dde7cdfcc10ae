import datetime as dt
import itertools
import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strataline.functions.storing import stored
from strataline.operators import collection, gate, gram, metrics, overfitting
from strataline.operators.candidates import Split, checked, evaluate_candidates
from strataline.operators.collection import Collection, Member
from strataline.operators.seeds import SEEDS
from strataline.search.alignment import Question, rate_fit
from strataline.search.client import HttpClient, first_object
from strataline.search.prompt import describe_language
from strataline.search.alignment import Fit
from strataline.search.rounds import Proposal, Search, Shelf, member_values, propose, run_search
from strataline.search.rounds import try_round
from strataline.plans.compiler import evaluate_many
from strataline.plans.grammar import parse
from strataline.operators.catalogue import FIELDS, MEANINGS, SPECS

SPLIT = Split(("2020-01-01", "2020-04-30"), ("2020-05-01", "2020-12-31"))


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(2)
    rows = []
    for k, i in enumerate("ABC"):
        for d in range(140):
            date = dt.date(2020, 1, 1) + dt.timedelta(d + 2 * (d // 5))
            close = 10.0 * (k + 1) + d + rng.random()
            rows.append((date, i, *[close + rng.random() for _ in range(3)], close, 1000.0, close * 1e6, close * 1000, rng.random() - 0.5, 10 / (k + 1), 2.0, 0.01, float(d % 20), float(d), k + 1.0, k + 5.0, 1.0, rng.random() - 0.5))
    names = [*FIELDS, "label_fwd_10d"]
    return spark.createDataFrame(rows, "datetime date, instrument string, " + ", ".join(f"{n} double" for n in names)).cache()


def test_seeds_end_to_end(panel):
    found = evaluate_candidates(panel, {s.name: s.expression for s in SEEDS}, SPLIT, 0.9).collect()
    assert {r["factor"] for r in found} == {s.name for s in SEEDS}
    assert set(found[0]["train"].asDict()) == set(metrics.METRICS)


def test_metrics_by_hand(spark):
    days = [(1, [(1, 1), (2, 2), (3, 4)]), (2, [(1, 3), (2, 2), (3, 1)]), (33, [(1, 1), (1, 2), (None, 3)]), (34, [(1, None), (2, None), (3, None)])]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(d), i, None if v is None else float(v), None if y is None else float(y)) for d, pairs in days for i, (v, y) in zip("abc", pairs, strict=True)]
    wide = spark.createDataFrame(rows, "datetime date, instrument string, f double, y double")
    figures = metrics.daily_figures(metrics.long_values(wide, ["f"], {"w": ("2020-01-01", "2020-12-31")}, "y"))
    daily = [r["daily_ic"] for r in metrics.daily_series(figures).orderBy("datetime").collect()]
    assert daily == [pytest.approx(0.9819805), pytest.approx(-1.0), None]
    one = metrics.window_metrics(figures).first()
    assert one["ic"] == pytest.approx((0.9819805 - 1) / 2) and one["coverage"] == pytest.approx(11 / 12)
    assert one["monthly_robustness"] == 0.5  # February has a pair but no value, and misses
    assert one["lag1_autocorr"] == pytest.approx(1.0)  # on the third day values don't vary, on the fourth two have no predecessor that does


def test_metrics_stay_within_their_window(spark):
    rows = [(dt.date(2020, 1, d), i, float(d * k), float(k)) for d in range(1, 9) for k, i in enumerate("abc", 1)]
    wide = spark.createDataFrame(rows, "datetime date, instrument string, f double, y double")
    long = metrics.long_values(wide, ["f"], {"w": ("2020-01-03", "2020-01-05"), "v": ("2020-01-05", "2020-01-06")}, "y")
    assert long.count() == 15 and long.filter("before is null").count() == 6
    assert {r["window"]: r["coverage"] for r in metrics.window_metrics(metrics.daily_figures(long)).collect()} == {"w": 1.0, "v": 1.0}


def _metric_rows(spark, train, validation):
    kinds = "factor string, window string, " + ", ".join(f"{m} double" for m in metrics.METRICS)
    base = {"ic": 0.02, "ic_std": 0.1, "rank_ic": 0.02, "rank_ic_std": 0.1, "icir": 0.2, "lag1_autocorr": 0.7, "monthly_robustness": 0.8, "coverage": 0.95}
    return spark.createDataFrame([("f", w, *[(base | change)[m] for m in metrics.METRICS]) for w, change in (("train", train), ("validation", validation))], kinds)


@pytest.mark.parametrize(
    "train, validation, alignment, failed",
    [
        ({}, {}, 0.5, []),
        ({"ic": 0.005}, {}, 0.5, []),
        ({}, {"ic": 0.001}, 0.5, ["validation:abs_ic"]),
        ({"icir": 0.1}, {"lag1_autocorr": 0.6}, 0.5, ["train:abs_icir", "validation:lag1_autocorr"]),
        ({"ic": -0.02}, {}, 0.4, ["validation_ic_same_sign", "alignment_score"]),
        ({"coverage": None}, {"monthly_robustness": None}, 1.0, ["train:coverage", "validation:monthly_robustness"]),
    ],
)
def test_gate(spark, train, validation, alignment, failed):
    one = gate.decide(_metric_rows(spark, train, validation), alignment).first()
    assert (one["accepted"], one["failed_criteria"]) == (not failed, failed)


def test_collection(spark, tmp_path):
    days = [(dt.date(2020, 1, d), i, float(x), float(y)) for d, pairs in ((1, ((1, 2), (2, 4), (3, 6))), (2, ((1, 3), (2, 2), (3, 1)))) for i, (x, y) in zip("abc", pairs, strict=True)]
    wide = spark.createDataFrame(days, "datetime date, instrument string, x double, y double")
    matrix = collection.correlation_matrix(wide, ["x", "y"])
    assert {(r["a"], r["b"]): r["rho"] for r in matrix.collect()} == {("x", "x"): 1.0, ("y", "y"): 1.0, ("x", "y"): pytest.approx(0.0), ("y", "x"): pytest.approx(0.0)}
    assert collection.breadth(matrix).first()[0] == pytest.approx(2.0)
    assert collection.novelty(matrix).filter("novel").count() == 2
    own = Collection()
    assert own.breadth() == 0.0
    own.add(Member("x", "r", "$close", 1, {}, "p"), [])
    assert own.add(Member("y", "r", "$open", 1, {}, "p"), [0.0]) == 2.0
    own.save(spark, str(tmp_path / "c.json"))
    again = Collection.load(spark, str(tmp_path / "c.json"))
    assert again == own and Collection.load(spark, str(tmp_path / "none.json")).members == []


def _series(spark, columns, days):
    rows = [(n, dt.date(2020, 1, 1) + dt.timedelta(d), float(f(d))) for n, f in columns.items() for d in range(days)]
    return spark.createDataFrame(rows, "factor string, datetime date, daily_ic double")


def _plain_pbo(columns, days, n):
    labels = [b for b in range(n) for _ in range(days // n + (b < days % n))]
    names, hits, total = list(columns), 0, 0
    for half in itertools.combinations(range(n), n // 2):
        mean = lambda f, inside: round(sum(f(d) for d in range(days) if (labels[d] in half) == inside) / sum((labels[d] in half) == inside for d in range(days)), 12)  # noqa: B023, E731
        within = [mean(columns[c], True) for c in names]
        beyond = [mean(columns[c], False) for c in names]
        x = beyond[within.index(max(within))]
        omega = (sum(v < x for v in beyond) + (sum(v == x for v in beyond) + 1) / 2) / (len(names) + 1)
        hits += math.log(omega / (1 - omega)) <= 0
        total += 1
    return hits / total, total


@pytest.mark.parametrize("days", [37, 40])
def test_overfitting_probability(spark, days):
    columns = {"a": lambda d: math.sin(d), "b": lambda d: math.cos(1.7 * d), "c": lambda d: 0.1, "d": lambda d: 0.1}
    got = overfitting.overfitting_probability(_series(spark, columns, days), list(columns), 8)
    assert (got.pbo, got.splits) == (pytest.approx(_plain_pbo(columns, days, 8)[0]), 70)


def test_splits_of_many_members(spark, monkeypatch):
    """Each split's best member and its standing, some members being equal; a row for each split, whatever the number of members."""
    monkeypatch.setattr(overfitting, "SPLITS", 30)
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(50)] for _ in range(30)]
    columns = {f"m{k}": (lambda d, v=base[k % 27]: v[d]) for k in range(30)}
    blocked = overfitting.blocks(overfitting.complete_days(_series(spark, columns, 50), list(columns)), 8)
    found = {r["split"]: r for r in overfitting.split_results(blocked, 30, 8).collect()}
    assert len(found) == 70
    labels = [b for b in range(8) for _ in range(50 // 8 + (b < 50 % 8))]
    for split, r in found.items():
        within, beyond = ([round(sum(f(d) for d in range(50) if (split >> labels[d] & 1) == half) / sum((split >> b & 1) == half for b in labels), 12) for f in columns.values()] for half in (1, 0))
        best = within.index(max(within))
        rank = sum(v < beyond[best] for v in beyond) + (sum(v == beyond[best] for v in beyond) + 1) / 2
        assert (r["best"], r["omega"]) == (best, pytest.approx(rank / 31)) and r["log_odds"] == pytest.approx(math.log(rank / (31 - rank)))


def test_overfitting_is_undefined(spark):
    series = _series(spark, {"a": math.sin, "b": math.cos}, 10)
    assert overfitting.overfitting_probability(series, ["a"]).undefined_reason == "fewer than two members"
    assert overfitting.overfitting_probability(series, ["a", "z"]).undefined_reason.endswith("a training series")
    assert overfitting.overfitting_probability(series, ["a", "b"]).undefined_reason == "fewer training days than blocks"


def test_moments_and_deflated_ratio(spark):
    x = [math.sin(d) ** 3 for d in range(50)]
    m, s = sum(x) / 50, math.sqrt(sum((v - sum(x) / 50) ** 2 for v in x) / 49)
    one = overfitting.moments(_series(spark, {"a": lambda d: math.sin(d) ** 3}, 50)).first()
    assert one["skew"] == pytest.approx(sum((v - m) ** 3 for v in x) / 50 / s**3)
    assert one["excess_kurtosis"] == pytest.approx(sum((v - m) ** 4 for v in x) / 50 / s**4 - 3)
    record = lambda r: {"decision": {"train": {}, "validation": {"icir": r}}}
    members = [Member("a", "", "", 1, record(0.3)["decision"], "")]
    records = [record(0.3), record(0.1), {"decision": None}, record(float("nan"))]
    got = overfitting.deflated_ratio(members, records, {"a": one.asDict()})
    assert got.trials == 3 and 0 < got.dsr < 1
    assert overfitting.deflated_ratio([], records, {}).undefined_reason == "the collection is empty"
    assert overfitting.deflated_ratio(members, records[:1], {}).undefined_reason == "fewer than two evaluated trials"
    assert overfitting.deflated_ratio(members, [record(0.3)] * 2, {}).undefined_reason == "the trials' ratios don't vary"
    assert overfitting.deflated_ratio(members, records, {}).undefined_reason == "the target has fewer than two finite days"


class Canned:
    def __init__(self, texts, tool='{"fit": 0.9, "why": "fits"}'):
        self.texts, self.tool, self.seen = itertools.cycle(texts), tool, []

    def complete(self, messages, model):
        self.seen.append(messages)
        return next(self.texts)

    def call_tool(self, messages, model, name, schema):
        self.seen.append(messages)
        return self.tool


def answer(expression):
    return "Sure. ```json\n" + json.dumps({"rationale": "why", "expression": expression}) + "\n```"


def test_prompt_has_the_whole_language():
    text = describe_language()
    assert all(f"{op}({names}): {meaning}" in text for op, (names, meaning) in MEANINGS.items()) and MEANINGS.keys() == SPECS.keys()
    assert all(f"${f}" in text for f in FIELDS) and len(SPECS) == 27


def test_proposals_are_tried_again(panel):
    found = propose(Canned([answer("CS_RANK($close"), answer("CS_RANK($close)"), answer("DELTA($close, 5000)")]), "m", panel, [], candidates=3, attempts=3)
    assert [a.parsed for a in found].count(True) >= 2 and all(1 <= a.attempts <= 3 for a in found)
    never = propose(Canned(["nothing"]), "m", panel, [], candidates=2, attempts=5)
    assert [(a.parsed, a.attempts) for a in never] == [(False, 5)] * 2 and "JSON" in never[0].error


def test_alignment_reads_the_tool_call_only():
    question = Question("the idea", "CS_RANK($close)", parse("CS_RANK($close)"), 0.1)
    client = Canned([""])
    assert rate_fit(client, "m", question).score == 0.9
    assert all(x in client.seen[0][0]["content"] for x in ("the idea", "CS_RANK($close)", "close", "0.100000"))
    bad = (None, "", "[]", "no", '{"fit": 1}', '{"fit": 1.5, "why": "w"}', '{"fit": -0.1, "why": "w"}', '{"fit": true, "why": "w"}', '{"fit": "1", "why": "w"}', '{"fit": 1, "why": " "}')
    for answer_ in bad:
        with pytest.raises(ValueError):
            rate_fit(Canned([""], answer_), "m", question)


def test_a_search(panel):
    state = run_search(panel, Canned([answer("CS_RANK($close)"), answer("CS_RANK(DELTA($close, 5))")]), "m", "m", SPLIT, rounds=1, candidates=2, attempts=1)
    assert isinstance(state, Search) and [r["evaluated"] for r in state.records] == [True, True]
    assert all("decision" in r for r in state.records)


def test_members_leave_values_and_each_candidate_is_saved(spark, panel, tmp_path):
    easy = gate.Thresholds(-1, -1, -2, -1, -1, 0)
    state, saved = Search(Collection(), shelf=Shelf(str(tmp_path / "values"), str(tmp_path / "daily"))), []
    first = {"A b/c": Proposal("r", "CS_RANK($close)"), "second": Proposal("r", "CS_RANK($open)")}
    run = lambda proposals: try_round(panel, proposals, lambda n, p, ic: Fit(1.0, "w"), SPLIT, state, easy, max_correlation=1.1, save=lambda s: saved.append(len(s.records)))
    run(first)
    assert saved == [1, 2] and [m.name for m in state.collection.members] == list(first)
    values = member_values(spark, state.collection.members)
    want = evaluate_many(panel, {"A b/c": "CS_RANK($close)", "second": "CS_RANK($open)"}).filter("datetime >= '2020-05-01'")
    assert sorted(map(str, values.select("datetime", "instrument", "A b/c", "second").collect())) == sorted(map(str, want.select("datetime", "instrument", "A b/c", "second").collect()))
    assert all(spark.read.parquet(p).count() > 0 for m in state.collection.members for p in (m.train_daily_ic_path, m.validation_daily_ic_path))
    run({"third": Proposal("r", "CS_RANK(MULTIPLY($close, 2))")})
    assert saved == [1, 2, 3] and state.collection.correlations[2][0] == pytest.approx(1.0)
    anew = Search(Collection([replace(m, validation_values_path="") for m in state.collection.members[:2]], [row[:2] for row in state.collection.correlations[:2]]))
    try_round(panel, {"third": Proposal("r", "CS_RANK(MULTIPLY($close, 2))")}, lambda n, p, ic: Fit(1.0, "w"), SPLIT, anew, easy, max_correlation=1.1)
    assert anew.collection.correlations[2] == pytest.approx(state.collection.correlations[2])


@pytest.mark.parametrize("block", [256, 4, 3])
def test_gram_matrices_equal_pairs(spark, block):
    """Ragged rows with missing and infinite values, columns that don't vary, at all or on some dates, and large numbers."""
    rng = random.Random(block)
    rows = []
    for d in range(12):
        for i in range(rng.randint(1, 30)):
            x = rng.gauss(0, 1)
            own = [x, x + rng.gauss(0, 1), 1e9 + x, 0.1, float(d), -x, rng.choice((1.0, 2.0)), float("inf") if rng.random() < 0.02 else x * x, 3.3 if d % 2 else x, None]
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(d), str(i), *[None if v is None or rng.random() < 0.15 else v for v in own]))
    names = [f"c{k}" for k in range(9)] + ["a.b"]
    wide = spark.createDataFrame(rows, "datetime date, instrument string, " + ", ".join(f"`{n}` double" for n in names)).repartition(3)
    plain = wide.withColumnRenamed("a.b", "c9")
    pairs = list(itertools.combinations([f"c{k}" for k in range(10)], 2))
    want = {(r["a"], r["b"]): r["rho"] for r in collection.pair_correlations(plain, pairs).collect()}
    got = {(r["a"], r["b"]): r["rho"] for r in gram.mean_correlations(wide, names, block).collect()}
    turn = lambda n: "c9" if n == "a.b" else n
    assert {(turn(a), turn(b)) for a, b in got} == set(pairs)
    for (a, b), rho in got.items():
        other = want[turn(a), turn(b)]
        assert (rho is None) == (other is None) and (rho is None or rho == pytest.approx(other, abs=1e-6)), (a, b, rho, other)


def test_many_pairs_are_one_scan(panel, monkeypatch):
    names = ["open", "high", "close", "ret", "funda_pe", "volume"]
    pairs = [(b, a) for a, b in itertools.combinations(names, 2)][2:]
    one = {(r["a"], r["b"]): r["rho"] for r in collection.pair_correlations(panel, pairs).collect()}
    monkeypatch.setattr(collection, "PAIRS_A_PASS", 4)
    many = collection.pair_correlations(panel, pairs)
    assert many._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") == 1
    many = {(r["a"], r["b"]): r["rho"] for r in many.collect()}
    assert many.keys() == one.keys() == set(pairs) and all(many[p] == pytest.approx(one[p]) if one[p] is not None else many[p] is None for p in pairs)


def test_gram_matrices_of_pieces_and_of_nothing(spark, panel, monkeypatch):
    names = ["open", "close", "ret"]
    whole = {(r["a"], r["b"]): r["rho"] for r in gram.mean_correlations(panel, names).collect()}
    monkeypatch.setattr(gram, "PIECE", 60)
    pieces = {(r["a"], r["b"]): r["rho"] for r in gram.mean_correlations(panel, names).collect()}
    assert pieces == pytest.approx(whole) and gram.mean_correlations(panel.filter("false"), names).isEmpty()


def test_stored_tables_are_read_by_column(spark, panel):
    again = stored(panel)
    assert sorted(map(str, again.collect())) == sorted(map(str, panel.collect()))
    assert "ReadSchema: struct<close:double>" in again.select("close")._jdf.queryExecution().executedPlan().toString()


def test_members_of_a_shelf_are_one_scan(spark, tmp_path):
    days = [(dt.date(2020, 1, d), i, float(d)) for d in range(1, 4) for i in "ab"]
    own = []
    for k in range(5):
        place = f"{tmp_path}/factor=m_{k}" if k < 4 else f"{tmp_path}/elsewhere"
        spark.createDataFrame([(d, i, v * k) for d, i, v in days], "datetime date, instrument string, value double").write.parquet(place)
        own.append(Member(f"m {k}", "", "", 1, {}, place))
    values = member_values(spark, own)
    assert values._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert sorted(tuple(r) for r in values.collect()) == sorted((d, i, *[v * k for k in range(5)]) for d, i, v in days)


class Broken(Canned):
    """Every second answer has no choices, or never comes."""

    def complete(self, messages, model):
        self.turn = getattr(self, "turn", 0) + 1
        if self.turn % 2:
            raise (KeyError("choices"), TimeoutError("lost"), IndexError("list index out of range"))[self.turn // 2 % 3]
        return super().complete(messages, model)


def test_an_answer_that_fails_is_an_attempt(panel):
    found = propose(Broken([answer("CS_RANK($close)")]), "m", panel, [], candidates=3, attempts=5)
    assert all(a.parsed for a in found) and max(a.attempts for a in found) > 1
    never = propose(Broken([None]), "m", panel, [], candidates=1, attempts=2)
    assert not never[0].parsed and never[0].attempts == 2 and never[0].error


def test_client_and_objects():
    sent = []

    def send(body):
        sent.append(body)
        return {"choices": [{"message": {"content": "hi", "tool_calls": [{"function": {"name": "t", "arguments": "{}"}}]}}]}

    client = HttpClient("u", "k", send, extra={"reasoning": {"enabled": False}})
    assert client.complete([], "m") == "hi" and client.call_tool([], "m", "t", {}) == "{}" and client.call_tool([], "m", "x", {}) is None
    assert all(body["reasoning"] == {"enabled": False} for body in sent) and sent[1]["tool_choice"]["function"]["name"] == "t"
    assert first_object('a {"b": {"c": "}"}} d') == {"b": {"c": "}"}}
    with pytest.raises(ValueError):
        first_object("none")


def test_bad_candidates_do_not_stop_others():
    good, bad = checked({"a": "CS_RANK($close)", "b": "nope(", "c": "TS_STD($ret, 1)"})
    assert set(good) == {"a"} and set(bad) == {"b", "c"}
