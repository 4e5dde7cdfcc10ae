"""The numbers of a run, with their defaults, and how they are read from a configuration file."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

from .operators.candidates import Split
from .operators.collection import MAX_CORRELATION
from .operators.gate import Thresholds


@dataclass(frozen=True)
class Settings:
    start: str = "2015-01-01"
    end: str = "2023-12-31"
    universe_size: int = 2750
    max_nodes: int = 50
    candidates: int = 8
    attempts: int = 5
    rounds: int = 50
    max_correlation: float = MAX_CORRELATION
    generation_model: str | None = None
    alignment_model: str | None = None
    split: Split = Split()
    thresholds: Thresholds = Thresholds()


#: Section and key of a configuration file, and the setting that it is.
KEYS = {
    ("data", "start_date"): "start",
    ("data", "end_date"): "end",
    ("data", "universe_size"): "universe_size",
    ("grammar", "max_ast_nodes"): "max_nodes",
    ("mining", "candidates_per_round"): "candidates",
    ("mining", "max_refinement_attempts"): "attempts",
    ("mining", "full_rounds"): "rounds",
    ("zoo", "redundancy_threshold"): "max_correlation",
    ("llm", "generation_model"): "generation_model",
    ("llm", "alignment_model"): "alignment_model",
    ("openrouter", "default_generation_model"): "generation_model",
    ("openrouter", "default_alignment_model"): "alignment_model",
}
#: The keys of the section data that are ends of windows.
WINDOWS = {"train": ("train_start", "train_end"), "validation": ("validation_start", "validation_end")}


def parse_document(text: str, path: str) -> dict:
    """JSON, or YAML by the library for it, which may be absent."""
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ModuleNotFoundError:
        raise ValueError(f"{path} can't be read without the yaml library; JSON can") from None
    return yaml.safe_load(text)


def read_settings(spark: SparkSession, *paths: str) -> Settings:
    """Settings from files, each over those before it. What a file lacks, or leaves empty, stays; sections that aren't known are left out."""
    found = Settings()
    for path in paths:
        document = parse_document(spark.read.text(path, wholetext=True).first()[0], path) or {}
        given = {(s, k): v for s, keys in document.items() if isinstance(keys, dict) for k, v in keys.items() if v not in (None, "")}
        kinds = {f.name: type(f.default) for f in fields(Settings)}
        values = {KEYS[x]: kinds[KEYS[x]](v) if kinds[KEYS[x]] in (int, float) else str(v) for x, v in given.items() if x in KEYS}
        ends = {w: tuple(str(given.get(("data", k), old)) for k, old in zip(keys, getattr(found.split, w), strict=True)) for w, keys in WINDOWS.items()}
        limits = {f.name: float(given["evaluation", f.name]) for f in fields(Thresholds) if ("evaluation", f.name) in given}
        found = replace(found, **values, split=Split(**ends), thresholds=replace(found.thresholds, **limits))
    return found
