"""Session-level helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules: blank and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Session, path and, if the catalog knows it, table.
_written: list[tuple[SparkSession, str, str | None]] = []


#: Bytes of a batch that goes to a Python worker, so that long texts don't add up in memory.
BATCH_BYTES = 2 * 1024 * 1024
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of BATCH_BYTES at most; a lower setting stays."""
    now = spark.conf.get(_BATCH, None)
    if now is None or not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one for a local master, and an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        there = spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strataline-"))
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path, None))
    out = spark.read.schema(df.schema).parquet(path)
    out._strataline_path = path
    return out


def written_in_buckets(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """written(), in buckets of a key whose values already lie together: joins by the key read it where it is."""
    spark = df.sparkSession
    own = f"strataline_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/strataline/{own}"
    df.write.bucketBy(buckets, key).options(path=path, compression="none").saveAsTable(own)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path, own))
    out = spark.table(own)
    out._strataline_path = path
    return out


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make's result, written; what was written on the way to it is deleted."""
    before = {path for _, path, _ in _written}
    out = written(make(), name)
    for item in [x for x in _written if x[1] not in before and x[1] != out._strataline_path]:
        _delete(*item)
        _written.remove(item)
    return out


def drop(df: DataFrame) -> None:
    """Delete what written() wrote, once no lazy result reads it any more."""
    path = getattr(df, "_strataline_path", None)
    for item in [x for x in _written if x[1] == path]:
        _delete(*item)
        _written.remove(item)


def _delete(spark: SparkSession, path: str, own: str | None) -> None:
    if own:
        spark.sql(f"DROP TABLE IF EXISTS {own}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _clean() -> None:
    for item in _written:
        try:
            _delete(*item)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def width(spark: SparkSession, rows: int, per_task: int, least: int = 1) -> int:
    """Partitions for so many rows, at least the session's shuffle partitions if those are fewer rows each."""
    return max(least, math.ceil(rows / per_task))


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
