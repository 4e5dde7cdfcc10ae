"""Results that several jobs read, kept in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stored: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is not set, a local one for a local master, and an error on a cluster."""
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not there:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strataline-"))
        there = context.getCheckpointDir()
    return there.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written in columns; later jobs read those that they need, and rows outlive executors. It goes when the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataline/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _stored:
        atexit.register(_clean)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _stored:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return
