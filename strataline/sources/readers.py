"""Readers with explicit schemas. All go through Spark's sources, so columns and filters reach the scans."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.facts import FACTS, parse_facts
from ..operators.panel import PRICES
from .writers import read_json

MARKET_SCHEMA = "dlycaldt date, ticker string, shrcd int, " + ", ".join(f"{c} double" for c in PRICES)

#: Which securities the market database is asked for.
COMMON_SHARES = {"sharetype": ("NS",), "securitytype": ("EQTY",), "securitysubtype": ("COM",), "usincflg": ("Y",), "issuertype": ("CORP", "REIT")}


def read_market(spark: SparkSession, csv: str | None = None, parquet: str | None = None) -> DataFrame:
    """Raw market records from exactly one of a CSV file with a header and a Parquet file; CSV columns go by their names."""
    if (csv is None) == (parquet is None):
        raise ValueError("exactly one of csv and parquet is needed")
    if parquet is not None:
        return spark.read.parquet(parquet)
    rows = spark.read.option("header", True).csv(csv)
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], MARKET_SCHEMA).schema}
    return rows.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])


def read_market_database(spark: SparkSession, url: str, table: str, start: str, end: str, where: dict[str, tuple[str, ...]] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """Market records by JDBC: a range of dates, cut into parts that are read at the same time; filters are pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="dlycaldt", lowerBound=start, upperBound=end, numPartitions=partitions, **options)
    rows = reader.load().filter(F.col("dlycaldt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for column, values in (COMMON_SHARES if where is None else where).items():
        rows = rows.filter(F.col(column).isin(*values))
    return rows


def read_panel_table(spark: SparkSession, path: str) -> DataFrame:
    """What write_panel_table wrote, with its buckets known to Spark: windows, joins and groups by instrument read it where it is."""
    note = read_json(spark, f"{path.rstrip('/')}.layout.json")
    own = "strataline_panel_" + hashlib.md5(path.encode()).hexdigest()
    listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(note["schema"]))
    spark.sql(f"DROP TABLE IF EXISTS {own}")
    spark.sql(f"CREATE TABLE {own} ({listed}) USING parquet CLUSTERED BY (instrument) SORTED BY (instrument, datetime) INTO {int(note['buckets'])} BUCKETS LOCATION '{path}'")
    return spark.table(own)


def read_facts(spark: SparkSession, csv: str) -> DataFrame:
    return spark.read.schema(FACTS).option("header", True).option("enforceSchema", False).csv(csv)


def read_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Facts from a folder of filing documents, <instrument>.json each, the name quoted as in a url; Spark quotes it once more."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return parse_facts(files.select(F.url_decode(F.url_decode(name)).alias("instrument"), F.col("value").alias("payload")))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Instruments, one a line; blanks go and letters become capitals."""
    lines = spark.read.text(path).select(F.upper(F.trim("value")).alias("instrument"))
    return lines.filter("instrument <> ''").distinct()


def match_registry(universe: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instrument, cik) of the universe by a registry (ticker, cik_str), numbers padded to ten digits; and what it lacks."""
    known = registry.select(F.upper(F.trim("ticker")).alias("ticker"), F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik")).dropDuplicates(["ticker"])
    same = F.col("instrument") == F.col("ticker")
    return universe.join(known, same).select("instrument", "cik"), universe.join(known, same, "left_anti")


def read_values(spark: SparkSession, path: str, factors: list[str] | None = None) -> DataFrame:
    """(factor, datetime, instrument, value) of what write_values wrote; only the folders of the named ones are read."""
    rows = spark.read.parquet(path)
    return rows if factors is None else rows.filter(F.col("factor").isin(factors))
