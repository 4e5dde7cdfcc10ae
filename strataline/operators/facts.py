"""Filed facts from nested filing documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Which tag of a filing is which field; a later tag overrides an earlier one of the same field.
TAGS = (
    ("NetIncomeLoss", "funda_net_income"),
    ("StockholdersEquity", "funda_book_equity"),
    ("CommonStockSharesOutstanding", "funda_shares_out"),
    ("EntityCommonStockSharesOutstanding", "funda_shares_out"),
    ("Revenues", "funda_revenue"),
    ("Assets", "funda_assets"),
    ("Liabilities", "funda_liabilities"),
    ("CommonStockDividendsPerShareDeclared", "funda_div_per_share"),
)
NAMESPACE = "us-gaap"
SCHEMA = "struct<facts: map<string, map<string, struct<units: map<string, array<struct<filed: string, val: double>>>>>>>"
FACTS = "instrument string, filed date, field string, value double"


def parse_facts(documents: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """(instrument, filed, field, value) of rows (instrument, payload), payload being a filing document as JSON text.

    Observations without a date or value go. Of several with the same
    instrument, field and date, the last one in the order of tags, units and
    observations stays. Text that is no such document gives no rows.
    """
    facts = F.try_element_at(F.from_json("payload", SCHEMA)["facts"], F.lit(namespace))
    tags = F.array(*[F.struct(F.lit(n).alias("place"), F.lit(tag).alias("tag"), F.lit(field).alias("field")) for n, (tag, field) in enumerate(TAGS)])
    rows = documents.select("instrument", facts.alias("facts")).select("instrument", "facts", F.explode(tags).alias("t"))
    rows = rows.select("instrument", "t.place", "t.field", F.try_element_at("facts", F.col("t.tag"))["units"].alias("units"))
    rows = rows.select("instrument", "place", "field", F.posexplode(F.map_values("units")).alias("unit", "observations"))
    rows = rows.select("instrument", "place", "field", "unit", F.posexplode("observations").alias("n", "o"))
    rows = rows.select("instrument", F.col("o.filed").try_cast("date").alias("filed"), "field", F.col("o.val").alias("value"), "place", "unit", "n")
    rows = rows.filter("filed is not null and value is not null")
    last = Window.partitionBy("instrument", "field", "filed").orderBy(F.desc("place"), F.desc("unit"), F.desc("n"))
    return rows.withColumn("__last", F.row_number().over(last)).filter("__last = 1").select("instrument", "filed", "field", "value")
