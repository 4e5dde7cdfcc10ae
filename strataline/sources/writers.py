"""Writers. A report is one JSON document; it goes through Spark's file systems like all other files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, content: object) -> None:
    write_text(spark, path, json.dumps(content, indent=2, default=str))


def read_json(spark: SparkSession, path: str) -> object:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_panel(panel: DataFrame, path: str) -> None:
    """Sorted within files by instrument and date, so that row groups can be skipped by either."""
    panel.repartition("instrument").sortWithinPartitions("instrument", "datetime").write.mode("overwrite").parquet(path)


def write_panel_table(panel: DataFrame, path: str, buckets: int | None = None) -> None:
    """The panel in buckets by instrument, each sorted by instrument and date, with a note of that beside it, so that ``read_panel_table`` can tell Spark. Windows along instruments over it need no exchange.

    buckets: by default as many as the session's shuffle has partitions; about
    128 MB of a bucket is a good size.
    """
    spark = panel.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = f"strataline_panel_{uuid.uuid4().hex}"
    dealt = panel.repartition(buckets, "instrument")
    dealt.write.mode("overwrite").bucketBy(buckets, "instrument").sortBy("instrument", "datetime").option("path", path).saveAsTable(own)
    spark.sql(f"DROP TABLE {own}")  # the files stay
    write_json(spark, f"{path.rstrip('/')}.layout.json", {"buckets": buckets, "schema": panel.schema.jsonValue()})


def write_facts(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").option("header", True).csv(path)


def write_values(values: DataFrame, path: str) -> None:
    """Values of many expressions in one dataset, a folder each."""
    values.write.mode("append").partitionBy("factor").parquet(path)
