"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``: rejected documents
are gone, one document of each near-duplicate group stays, secrets are replaced
in the texts, and the mix has each document as often as it takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataline.llm.common import drop, table, written_alone
from strataline.llm.jaccard_join import near_duplicate_stage
from strataline.llm.mixing import mixing_stage
from strataline.llm.packing import packing_stage
from strataline.llm.secret_scan import secrets_stage
from strataline.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Scores, components and packing are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next reads it; then what it was made of goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written_alone(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
