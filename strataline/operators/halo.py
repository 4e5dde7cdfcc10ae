"""Long instruments in chunks of time, each with the rows before it that its windows look back to.

Rows are counted by instrument and period of days, which is a small table. From
it every period gets the chunk that it belongs to, of about so many rows, and
the later chunks whose first windows reach back into it. Joined to the rows,
that sends each row to its own chunk and, marked as halo, to those that look
back to it: a few rows are copied, and an instrument of any length is the work
of many tasks. Windows then run along (instrument, chunk), and halo rows go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a period; rows are dealt by whole periods.
PERIOD = 28
CHUNK, HALO = "__chunk", "__halo"


def with_halo(panel: DataFrame, rows_a_chunk: int, back: int, period: int = PERIOD) -> DataFrame:
    """panel (instrument, datetime, ..) with chunk and halo: its rows, and copies of those that are among the ``back`` rows of the instrument before a later chunk."""
    number = F.floor(F.datediff("datetime", F.lit("1970-01-01").cast("date")) / period).cast("long")
    counts = panel.groupBy("instrument", number.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("instrument").orderBy("period")  # one row a period
    counts = counts.withColumn("end", F.sum("n").over(along))
    counts = counts.withColumn("begin", F.col("end") - F.col("n"))
    counts = counts.withColumn("own", F.floor(F.col("begin") / rows_a_chunk).cast("long"))
    starts = counts.groupBy("instrument", "own").agg(F.min("begin").alias("start"))
    later = starts.groupBy("instrument").agg(F.collect_list(F.struct("own", "start")).alias("starts"))
    same = F.col("p.instrument").eqNullSafe(F.col("s.instrument"))
    dealt = counts.alias("p").join(later.alias("s"), same).select("p.instrument", "p.period", "p.own", "p.end", "s.starts")
    ahead = F.filter("starts", lambda s: (s["own"] > F.col("own")) & (s["start"] - back < F.col("end")))
    dealt = dealt.select(F.col("instrument").alias("__i"), F.col("period").alias("__p"), "own", F.transform(ahead, lambda s: s["own"]).alias("ahead"))
    rows = panel.withColumn("__period", number)
    met = rows.join(dealt, F.col("instrument").eqNullSafe(F.col("__i")) & F.col("__period").eqNullSafe(F.col("__p")))
    to = F.concat(F.array(F.struct(F.col("own").alias("chunk"), F.lit(False).alias("halo"))), F.transform("ahead", lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("halo"))))
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in panel.columns]
    out = met.select(*columns, F.explode(to).alias("__to"))
    return out.select(*columns, F.col("__to.chunk").alias(CHUNK), F.col("__to.halo").alias(HALO))


def without_halo(panel: DataFrame) -> DataFrame:
    return panel.filter(~F.col(HALO)).drop(CHUNK, HALO)
