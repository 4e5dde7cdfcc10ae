import pytest

from strataline.operators.catalogue import SPECS
from strataline.operators.seeds import SEEDS
from strataline.plans.compiler import EvalError, Plan
from strataline.plans.grammar import ParseError, parse


def test_counts_every_node():
    assert parse("CS_RANK(MULTIPLY(TS_STD($ret, 20), -1))").node_count == 6
    assert parse("x = TS_STD($ret, 20)\nADD(x, x)").node_count == 6


@pytest.mark.parametrize("seed", SEEDS)
def test_seeds_parse(seed):
    assert parse(seed.expression).operators <= set(SPECS)


@pytest.mark.parametrize(
    "text, part",
    [
        ("CS_RANK($label_fwd_10d)", "unknown field"),
        ("CS_RANK(" * 30 + "$close" + ")" * 30 + "\n", None),
        ("ADD(" * 30 + "$close" + ", ABS($open))" * 30, "exceeding cap"),
        ("TS_MEAN($close, 2.5)", "integer numeric literal"),
        ("n = 5\nTS_MEAN($close, n)", "integer numeric literal"),
        ("TS_MEAN($close, 0)", "positive integer"),
        ("DELAY($close, -1)", "non-negative integer"),
        ("NOPE($close)", "no operator NOPE"),
        ("ADD($close)", "takes 2 arguments"),
        ("$close + 1", "unsupported expression syntax"),
        ("-$close", "minus"),
        ("x", "before it is defined"),
        ("$close\n$open", "only one line"),
        ("x = $close", "no line gives"),
        ("1x = $close\n$open", "cannot name"),
        ("x = CS_RANK($close, k=1)\nx", "unsupported expression syntax"),
        ("TS_MEAN($close, 1e999)", "not finite"),
        ("", "no line gives"),
        ("(" * 3000 + "$close" + ")" * 3000, "levels within each other"),
        ("ABS(" * 3000 + "$close" + ")" * 3000, "levels within each other"),
        ("-" * 3000 + "3", "levels within each other"),
    ],
)
def test_rejections(text, part):
    if part is None:
        assert parse(text).node_count == 31
        return
    with pytest.raises(ParseError, match=part):
        parse(text)


def test_accepted_forms():
    assert parse('CS_RANK(FIELD("close"))').fields == {"close"}
    assert parse("y = $open\nCS_RANK(y)\ny = $close").node_count == 4
    assert parse("POW($close, -2)").node_count == 3
    assert parse("ADD(True, --3)").node_count == 3


def test_plan_alternates_as_little_as_needed():
    a = parse("CS_RANK(TS_MEAN($close, 3))").resolved()
    b = parse("CS_RANK(TS_STD(CS_RANK($close), 3))").resolved()
    assert [kind for kind, _ in Plan({"a": a, "b": b}).passes()] == ["ts", "cs", "ts", "cs"]
    shared = Plan({"a": a, "c": parse("CS_ZSCORE(TS_MEAN($close, 3))").resolved()})
    assert [len(nodes) for _, nodes in shared.passes()] == [1, 2]


@pytest.mark.parametrize("text", ["TS_STD($ret, 1)", "CS_WINSORIZE($ret, $close, 0.9)", "CS_WINSORIZE($ret, 0.1, 1.5)"])
def test_expressions_without_a_value(text):
    with pytest.raises(EvalError):
        Plan({"a": parse(text).resolved()})


def test_constant_bounds_fold():
    Plan({"a": parse("CS_WINSORIZE($ret, DIVIDE(1, 10), SUBTRACT(1, 0.1))").resolved()})
