"""Mixing of sources to target weights by hash-threshold histograms.

Every document has a fixed 36-bit hash of its id. A source whose target is p
whole passes and a rest takes each document p times, and once more where the
hash lies below the source's threshold. The threshold is the largest one under
which the sizes still fit the rest. It is found without a sort: sizes are
summed by source and the hash's first 12 bits, the bucket in which the rest
runs out is the only one whose documents are summed again, by the next 12 bits,
and so once more. Larger budgets give larger thresholds, so selections are nested.

Sources are summaries (one row of two numbers each, many times fewer than
documents): ordering them by one task is meant for up to some millions of them,
which a task sorts in seconds. Defined results: a null source is a source of its
own, ordered last; null texts have size 0; rows that share a doc_id, null
included, share the hash and so the decision, each with its own size; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, named, table, written

LEVEL_BITS = 12
LEVELS = 3
#: Above so many sources their thresholds are joined, with salt for the large ones, and not broadcast.
MAX_BROADCAST_SOURCES = 50_000
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """36 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets of sources (source, source_size): weights by code point order, repeating; no more than cap times a size.

    With the sources ordered by cap over weight, those before some point are
    full and the rest share what is left by weight; the first source whose
    share is within its own cap marks that point.
    """
    everything = Window.partitionBy()
    ordered = sizes.withColumn("__n", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") - 1) % len(weights) + 1)
    ordered = ordered.withColumns({"__w": weight, "__cap": F.lit(float(cap)) * F.col("source_size")})
    by_ratio = everything.orderBy(F.col("__cap") / F.col("__w"), F.col("__n"))
    before = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    ordered = ordered.withColumn("__level", (total - before) / left)
    level = F.min(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct((F.col("__cap") / F.col("__w")).alias("r"), "__n", "__level"))).over(everything)
    ordered = ordered.withColumn("__found", level["__level"])
    target = F.when(F.col("__found").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__found") * F.col("__w")))
    return ordered.select("source", "source_size", target.alias("target"))


def _boundary(found: DataFrame, sums: DataFrame, level: int) -> DataFrame:
    """found (source, .., prefix, rest) with the bucket of sums (source, bucket, words) in which rest runs out, null where it doesn't."""
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = sums.withColumn("cum", F.sum("words").over(run))
    cum = cum.withColumnRenamed("source", "s2")
    over = cum.join(found.select(F.col("source").alias("s1"), F.col("rest").alias("r1")), F.col("s1").eqNullSafe(F.col("s2"))).filter("cum > r1")
    first = over.groupBy("s2").agg(F.min(F.struct("bucket", "cum", "words")).alias("b"))
    out = found.join(first, F.col("source").eqNullSafe(F.col("s2")), "left")
    shift = LEVEL_BITS * (LEVELS - 1 - level)
    return out.select(
        "source", "source_size", "target", "passes",
        (F.col("prefix") + F.coalesce(F.col("b.bucket"), F.lit(1 << LEVEL_BITS if level == 0 else 0)) * F.lit(1 << shift)).alias("prefix"),
        F.coalesce(F.col("rest") - (F.col("b.cum") - F.col("b.words")), F.lit(0.0)).alias("rest"),
        F.col("b").isNotNull().alias("open"),
    )


def mixing_plan(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Of rows (source, size, hash): source, source_size, target, passes and threshold of each source."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = source_targets(sizes, weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    found = found.withColumn("passes", passes.cast("int"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    found = written(found.withColumns({"rest": rest, "prefix": F.lit(0).cast("long"), "open": F.lit(True)}), "mix")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        rows = sized
        if level:
            edge = found.filter("open").select(F.col("source").alias("s1"), F.shiftright("prefix", shift + LEVEL_BITS).alias("p1"))
            rows = sized.join(edge, F.col("source").eqNullSafe(F.col("s1")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("p1")))
        bucket = F.shiftright("hash", shift).bitwiseAND((1 << LEVEL_BITS) - 1)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        found = written(_boundary(found, sums, level), "mix")
    return found.select("source", "source_size", "target", "passes", F.col("prefix").alias("threshold"))


def with_copies(df: DataFrame, plan: DataFrame, hash_of: Column, source: str = "source", salts: int = SALTS, max_broadcast: int = MAX_BROADCAST_SOURCES) -> DataFrame:
    """df with source_size, target and copies (how often the mix takes each row)."""
    plan = plan.select(F.col("source").alias("__s"), "source_size", "target", F.col("passes").alias("__p"), F.col("threshold").alias("__t"))
    df = df.withColumn("__h", hash_of)
    same = F.col(source).eqNullSafe(F.col("__s"))
    if plan.count() <= max_broadcast:
        out = df.join(F.broadcast(plan), same)
    else:
        plan = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = df.join(plan, same & (F.pmod(F.col("__h"), F.lit(salts)) == F.col("__salt"))).drop("__salt")
    copies = F.col("__p") + (F.col("__h") < F.col("__t")).cast("int")
    return out.withColumn("copies", copies).drop("__s", "__p", "__t", "__h")


def sized_documents(docs: DataFrame) -> DataFrame:
    """The narrow rows from which a plan is made, written once: doc_id, source, size, hash."""
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("hash")), "sizes")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_documents(table(spark, sf_dir, "documents"))
    out = with_copies(sized, mixing_plan(sized), F.col("hash"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it."""
    plan = mixing_plan(sized_documents(docs))
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("__row"), F.col("source"), doc_hash(F.col("doc_id")).alias("hash"))
    out = with_copies(rows, plan, F.col("hash")).filter("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS hash
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM sizes
), weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((n - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM numbered
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed
), found AS (
  SELECT arg_min(lv, (cap / w, n)) AS f FROM levels WHERE lv * w <= cap
), targets AS (
  SELECT source, source_size, CASE WHEN f IS NULL THEN cap ELSE least(cap, f * w) END AS target FROM levels CROSS JOIN found
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets
), running AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.passes,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= b.target - b.passes * b.source_size AS more
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST((passes + CASE WHEN more THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM running
"""
