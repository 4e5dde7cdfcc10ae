"""The acceptance gate: twelve checks on the metrics of two windows and an alignment score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import METRICS

TRAIN, VALIDATION = "train", "validation"


@dataclass(frozen=True)
class Thresholds:
    """Fixed values as defaults. The first and the last may be met exactly, the others have to be exceeded."""

    min_abs_ic: float = 0.005
    min_abs_icir: float = 0.1
    min_lag1_autocorr: float = 0.6
    min_monthly_robustness: float = 0.7
    min_coverage: float = 0.9
    min_alignment_score: float = 0.5


def _checks(t: Thresholds) -> list[tuple[str, Column]]:
    out = []
    for w in (TRAIN, VALIDATION):
        icir = F.abs(f"{w}.icir")
        out += [
            (f"{w}:abs_ic", F.abs(f"{w}.ic") >= t.min_abs_ic),
            (f"{w}:abs_icir", (icir > t.min_abs_icir) & (icir < float("inf"))),
            (f"{w}:lag1_autocorr", F.col(f"{w}.lag1_autocorr") > t.min_lag1_autocorr),
            (f"{w}:monthly_robustness", F.col(f"{w}.monthly_robustness") > t.min_monthly_robustness),
            (f"{w}:coverage", F.col(f"{w}.coverage") > t.min_coverage),
        ]
    signs = F.signum(f"{TRAIN}.ic"), F.signum(f"{VALIDATION}.ic")
    out.append(("validation_ic_same_sign", (signs[0] == signs[1]) & (signs[0] != 0)))
    out.append(("alignment_score", F.col("alignment") >= t.min_alignment_score))
    return out


def decide(metrics: DataFrame, alignment: float | DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """factor, accepted, failed_criteria (in order), alignment and the metrics of both windows.

    metrics: window_metrics with windows train and validation. alignment: one
    score for all, or rows (factor, alignment). What is missing fails.
    """
    rows = metrics.groupBy("factor").agg(*[F.max(F.when(F.col("window") == w, F.struct(*METRICS))).alias(w) for w in (TRAIN, VALIDATION)])
    rows = rows.withColumn("alignment", F.lit(float(alignment))) if not isinstance(alignment, DataFrame) else rows.join(alignment.select("factor", "alignment"), "factor", "left")
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in _checks(thresholds)]))
    return rows.withColumn("failed_criteria", failed).select("factor", (F.size("failed_criteria") == 0).alias("accepted"), "failed_criteria", "alignment", TRAIN, VALIDATION)
