"""The collection of accepted expressions: correlations, nearest members, novelty, breadth, and its files."""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.missing import pearson
from .gram import mean_correlations

#: Fixed values.
NEAREST = 3
MAX_CORRELATION = 0.8
#: Up to so many pairs are one aggregation; more are Gram matrices.
PAIRS_A_PASS = 200


def pair_correlations(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, rho): mean over dates of the correlation of two columns across instruments.

    A few pairs are one aggregation by date over columns; values are never joined
    with themselves. Many are taken from matrices of all columns, of which the
    pairs asked for are kept.
    """
    if not pairs:
        return wide.sparkSession.createDataFrame([], "a string, b string, rho double")
    if len(pairs) > PAIRS_A_PASS:
        names = list(dict.fromkeys(x for p in pairs for x in p))
        place = {n: k for k, n in enumerate(names)}
        every = mean_correlations(wide, names)
        if len(pairs) == len(names) * (len(names) - 1) // 2 and all(place[a] < place[b] for a, b in pairs):
            return every
        turned = [(*sorted(p, key=place.get), *p) for p in pairs]
        asked = wide.sparkSession.createDataFrame(turned, "i string, j string, a string, b string")
        same = (F.col("m.a") == F.col("i")) & (F.col("m.b") == F.col("j"))
        return asked.alias("q").join(every.alias("m"), same, "left").select(F.col("q.a").alias("a"), F.col("q.b").alias("b"), "m.rho")
    columns = dict.fromkeys(x for p in pairs for x in p)
    daily = wide.select("datetime", *columns).groupBy("datetime").agg(*[pearson(F.col(a), F.col(b)).alias(f"r{n}") for n, (a, b) in enumerate(pairs)])
    means = daily.agg(*[F.avg(f"r{n}").alias(f"r{n}") for n in range(len(pairs))])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{n}").alias("rho")) for n, (a, b) in enumerate(pairs)]))
    return means.select(rows.alias("p")).select("p.a", "p.b", "p.rho")


def correlation_matrix(wide: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, rho) of all ordered pairs, each with itself at 1."""
    half = pair_correlations(wide, list(itertools.combinations(names, 2)))
    other = half.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho")
    same = wide.sparkSession.createDataFrame([(n, n, 1.0) for n in names], "a string, b string, rho double")
    return half.unionByName(other).unionByName(same)


def nearest(correlations: DataFrame, n: int = NEAREST) -> DataFrame:
    """(a, rank, b, rho): for each a the n others of the largest absolute correlation, missing ones last."""
    order = Window.partitionBy("a").orderBy(F.abs("rho").desc_nulls_last(), "b")
    ranked = correlations.filter("a <> b").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).select("a", "rank", "b", "rho")


def novelty(correlations: DataFrame, limit: float = MAX_CORRELATION) -> DataFrame:
    """(a, max_abs_rho, novel): whether no other is correlated beyond the limit; missing correlations don't count."""
    most = correlations.groupBy("a").agg(F.coalesce(F.max(F.when(F.col("a") != F.col("b"), F.abs("rho"))), F.lit(0.0)).alias("max_abs_rho"))
    return most.withColumn("novel", F.col("max_abs_rho") <= limit)


def breadth(matrix: DataFrame) -> DataFrame:
    """One row: the number of members over the mean row sum of their correlations; 0 for none, missing if one is missing."""
    one = matrix.agg(F.sum("rho").alias("total"), F.count("rho").alias("known"), F.count(F.lit(1)).alias("cells"))
    value = F.when(F.col("cells") == 0, 0.0).when(F.col("known") == F.col("cells"), F.when(F.col("total") == 0, float("inf")).otherwise(F.try_divide(F.col("cells").cast("double"), F.col("total"))))
    return one.select(value.alias("breadth"))


@dataclass(frozen=True)
class Member:
    """An accepted expression, with the places of its values and daily series."""

    name: str
    rationale: str
    expression: str
    node_count: int
    metrics: dict
    validation_values_path: str
    train_daily_ic_path: str | None = None
    validation_daily_ic_path: str | None = None


@dataclass
class Collection:
    """Members in order, with their correlations in the same order; a summary that stays on the driver."""

    members: list[Member] = field(default_factory=list)
    correlations: list[list[float | None]] = field(default_factory=list)

    def add(self, member: Member, to_others: list[float | None]) -> float | None:
        """Append a member by its correlations to those that are there; the breadth that results."""
        if len(to_others) != len(self.members):
            raise ValueError("one correlation to each member is needed")
        for row, rho in zip(self.correlations, to_others, strict=True):
            row.append(rho)
        self.correlations.append([*to_others, 1.0])
        self.members.append(member)
        return self.breadth()

    def breadth(self) -> float | None:
        n = len(self.members)
        cells = [c for row in self.correlations for c in row]
        if any(c is None for c in cells):
            return None
        return 0.0 if n == 0 else float("inf") if sum(cells) == 0 else n * n / sum(cells)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON document, by Spark's file systems."""
        text = json.dumps({"members": [asdict(m) for m in self.members], "correlation_matrix": self.correlations, "breadth": self.breadth()}, indent=2)
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Collection:
        """What was saved; an empty collection if there is no such file. Older members may lack their series' places."""
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return cls()
        saved = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls([Member(**m) for m in saved.get("members", [])], saved.get("correlation_matrix", []))
