"""Five known expressions to start from."""

from __future__ import annotations

from typing import NamedTuple


class Seed(NamedTuple):
    name: str
    expression: str
    rationale: str


#: The expressions.
SEEDS = (
    Seed("Momentum", "CS_RANK(DELTA($close, 126))", "What rose over half a year goes on rising."),
    Seed("Reversal", "CS_RANK(MULTIPLY(DELTA($close, 5), -1))", "What fell within a week comes back."),
    Seed("Low-volatility", "CS_RANK(MULTIPLY(TS_STD($ret, 20), -1))", "Calm instruments do better for their risk."),
    Seed("Value", "CS_NEUTRALIZE(CS_RANK(DIVIDE(1, $funda_pe)), CS_BUCKET($market_cap, 10))", "Earnings that are cheap among instruments of the same size."),
    Seed("Post-disclosure drift", "IF_THEN_ELSE(LT($funda_days_since_disclosure, 5), CS_RANK(DELTA($funda_net_income, 60)), 0)", "Prices follow new earnings slowly."),
)
