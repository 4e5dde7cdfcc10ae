"""The description of the language that proposers get, made from the catalogue itself."""

from __future__ import annotations

from ..operators.catalogue import FIELDS, MEANINGS, SPECS
from ..operators.seeds import SEEDS

_WHOLE = {None: "any whole number", 0: "a whole number from 0 on", 1: "a whole number from 1 on"}
_FUNDAMENTAL = "funda_"


def describe_language(max_nodes: int = 50) -> str:
    operators = []
    for name, spec in SPECS.items():
        names, meaning = MEANINGS[name]
        whole = "" if spec.literal is None else f"; {names.split(', ')[spec.literal]} is {_WHOLE[spec.least]}, written as such"
        operators.append(f"  {name}({names}): {meaning}{whole}")
    return "\n".join([
        "Propose an expression that ranks instruments by their coming returns.",
        "Fields of a day's record: " + " ".join(f"${f}" for f in FIELDS if not f.startswith(_FUNDAMENTAL)),
        "Fields of what was filed before that day: " + " ".join(f"${f}" for f in FIELDS if f.startswith(_FUNDAMENTAL)),
        "Operators (TS_ along an instrument's rows, CS_ across a date; arguments are expressions but for whole numbers):",
        *operators,
        f"At most {max_nodes} calls, fields, names and numbers. Lines may name parts (name = expression); one line is the output.",
        "Examples:",
        *[f"  {s.name}: {s.expression}" for s in SEEDS],
        'Answer with one JSON object: {"rationale": "...", "expression": "..."}',
    ])
