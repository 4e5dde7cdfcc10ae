"""Whether an expression does what its author says it does, as a language model sees it.

The model reads the stated idea, the formula and its result on the training
window. The validation window stays out of the question.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from ..plans.grammar import Program
from .client import Client

#: The function that the model has to call, and its arguments.
RATING = "rate_fit"
ARGUMENTS = {
    "type": "object",
    "required": ["fit", "why"],
    "properties": {
        "why": {"type": "string", "description": "one or two sentences"},
        "fit": {"type": "number", "description": "0: the formula does something else; 1: it does just what the idea says"},
    },
}


@dataclass(frozen=True)
class Question:
    """What is put to the model."""

    idea: str
    formula: str
    program: Program
    train_ic: float | None

    def text(self) -> str:
        ic = "not known" if self.train_ic is None else f"{self.train_ic:.6f}"
        return "\n".join((
            f"Idea: {self.idea}",
            f"Formula: {self.formula}",
            f"It reads {', '.join(sorted(self.program.fields)) or 'no field'} and calls {', '.join(sorted(self.program.operators)) or 'no operator'}.",
            f"Mean daily correlation with forward returns on the training window: {ic}",
            f"Call {RATING}. The question is whether the formula carries out the idea, not whether the idea is true.",
        ))


@dataclass(frozen=True)
class Fit:
    score: float
    why: str


def rate_fit(client: Client, model: str, question: Question) -> Fit:
    """ValueError unless the model calls the function with a number from 0 to 1 and a reason."""
    arguments = client.call_tool([{"role": "user", "content": question.text()}], model, RATING, ARGUMENTS)
    if arguments is None:
        raise ValueError(f"{RATING} was not called")
    given = json.loads(arguments) if arguments.strip() else None
    fit, why = (given.get(k) for k in ("fit", "why")) if isinstance(given, dict) else (None, None)
    if isinstance(fit, bool) or not isinstance(fit, (int, float)) or not 0 <= fit <= 1:
        raise ValueError(f"fit is no number from 0 to 1: {fit!r}")
    if not isinstance(why, str) or not why.strip():
        raise ValueError("no reason is given")
    return Fit(float(fit), why)
