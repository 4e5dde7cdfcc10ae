"""What quality filters do to each other's counts, in every order they could run in.

Documents are counted once by part and mask, the set of filters that they fail:
a part with n filters is 2 ** n cells, whatever its size. Everything else comes
from the cells. Orders are visited by swapping two neighbours at a time, so that
from one to the next only the two steps of the swap change; those alone are
taken from the cells again, and a filter's Shapley sum grows along the walk by
what it removed times the orders for which that held.

Duplicates are told by SHA-256 of the whole text. Equal texts fail the same other
filters, so one row for each text and part is enough to know its least id, and a
group of copies of any size is gathered by partial sums.

Defined results: a null text is empty, a null part is the empty string; a null
id is not larger than any other, so such rows are no duplicates and make none;
rows that share a text and the least id are all first. Labels: several rows of
one document count as 1 if one of them says so; null labels and documents
without a label are 0. An empty table gives an empty result. Only the columns
named are read, so others may have any name.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, text_or_empty
from .workers import released

#: What a cell counts: rows, those of good quality, and toxic ones.
MEASURES = ("n", "good", "toxic")
#: Parts whose orders a worker holds at once.
PARTS_A_BATCH = 64
#: The most filters; all orders of so many are 5,040 rows times their steps for each part.
MAX_FILTERS = 7
#: The letter of the filter for copies, which is told from ids and not from a text.
DUPLICATE = "E"
FAILED_BITS = "bits"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails each filter, by letter. text: never null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.size(words)
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n_words.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail; bit k is the k-th of failures, the last bit that of copies."""
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), mask.cast("int").alias(FAILED_BITS))
    rows = rows.groupBy("__id", "part", "digest", FAILED_BITS).agg(F.count(F.lit(1)).alias("n"))
    flags = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__label")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(own) for c, own in (("quality", "good"), ("toxic", "toxic"))])
    # rows without an id meet no label; by their digests they are spread over all tasks
    spread = F.when(F.col("__id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("__spread", spread)
    rows = rows.join(flags.withColumn("__none", F.lit(0).cast("long")), (F.col("__id") == F.col("__label")) & (F.col("__spread") == F.col("__none")), "left")
    rows = rows.withColumns({m: F.col("n") * F.coalesce(F.col(m), F.lit(0)) for m in ("good", "toxic")})
    sums = [F.sum(m).alias(m) for m in MEASURES]
    first = F.min(F.when(F.col("__id").isNotNull(), F.struct("__id", *MEASURES))).alias("first")
    # rows of one id, text and part are one row by now, so the least of them stands for all that share the id
    texts = rows.groupBy("digest", "part", FAILED_BITS).agg(*sums, first, *[F.sum(F.when(F.col("__id").isNull(), F.col(m)).otherwise(0)).alias(f"no_id_{m}") for m in MEASURES])
    least = F.min("first.__id").over(Window.partitionBy("digest"))  # one row a part that has the text
    texts = texts.withColumn("is_first", F.coalesce(F.col("first.__id") == least, F.lit(False)))
    kept = {m: F.when(F.col("is_first"), F.col(f"first.{m}")).otherwise(0) + F.col(f"no_id_{m}") for m in MEASURES}
    copies = 1 << len(failures)
    both = F.array(
        F.struct(F.col(FAILED_BITS).alias("mask"), *[kept[m].alias(m) for m in MEASURES]),
        F.struct(F.col(FAILED_BITS).bitwiseOR(F.lit(copies)).alias("mask"), *[(F.col(m) - kept[m]).alias(m) for m in MEASURES]),
    )
    each = texts.select("part", F.explode(both).alias("c")).select("part", "c.*").filter("n > 0")
    return each.groupBy("part", "mask").agg(*sums)


def swaps(n: int) -> Iterator[int]:
    """Places k whose swaps with k + 1, one after the other, visit all orders of n things from 0, 1, .. on, each once."""
    order, to = list(range(n)), [-1] * n
    for _ in range(math.factorial(n) - 1):
        where = {x: k for k, x in enumerate(order)}
        x = max(x for x in order if 0 <= where[x] + to[x] < n and order[where[x] + to[x]] < x)
        k = min(where[x], where[x] + to[x])
        order[k], order[k + 1] = order[k + 1], order[k]
        for y in range(x + 1, n):
            to[y] = -to[y]
        yield k


def passing(counts: np.ndarray, n: int) -> np.ndarray:
    """counts[.., mask, measure] summed over the masks that have nothing in common with a set: what is left after its filters."""
    out = counts.copy()
    for bit in range(n):
        with_bit = np.flatnonzero(np.arange(1 << n) & (1 << bit))
        out[:, with_bit] += out[:, with_bit ^ (1 << bit)]
    return out[:, (1 << n) - 1 - np.arange(1 << n)]


def walk(counts: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders in the walk's sequence; figures[part, order, step, (kept, removed, good_lost, toxic_lost)]; Shapley sums[part, filter]."""
    left = passing(counts, n)
    order = list(range(n))
    state = np.zeros((len(counts), n, 4), np.int64)
    since = [0] * n  # the order of the walk since which a filter's step is as it is
    shapley = np.zeros((len(counts), n), np.int64)

    def step(k: int) -> None:
        before = sum(1 << x for x in order[:k])
        after = before | 1 << order[k]
        state[:, k, 0] = left[:, after, 0]
        state[:, k, 1:] = left[:, before] - left[:, after]

    for k in range(n):
        step(k)
    orders, figures = [tuple(order)], [state.copy()]
    for t, k in enumerate(swaps(n), 1):
        for at in (k, k + 1):
            shapley[:, order[at]] += state[:, at, 1] * (t - since[order[at]])
            since[order[at]] = t
        order[k], order[k + 1] = order[k + 1], order[k]
        step(k)
        step(k + 1)
        orders.append(tuple(order))
        figures.append(state.copy())
    for k, x in enumerate(order):
        shapley[:, x] += state[:, k, 1] * (len(orders) - since[x])
    return orders, np.stack(figures, 1), shapley


def interactions(found: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step, from cells (part, mask, n, good, toxic); letters: the filters by bit."""
    n = len(letters)
    if n > MAX_FILTERS:
        raise ValueError(f"{MAX_FILTERS} filters at most")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PARTS_A_BATCH):
                rows = batch.slice(a, PARTS_A_BATCH)
                held = rows.column(1)
                counts = np.zeros((rows.num_rows, 1 << n, len(MEASURES)), np.int64)
                who = np.repeat(np.arange(rows.num_rows), np.diff(held.offsets.to_numpy()))
                flat = held.flatten()
                at = flat.field("mask").to_numpy()
                for m, name in enumerate(MEASURES):
                    counts[who, at, m] = flat.field(name).to_numpy()
                orders, figures, shapley = walk(counts, n)
                shape = figures.shape[:3]
                which = np.broadcast_to(np.array(orders), shape)
                part = np.arange(rows.num_rows)[:, None, None]
                fails = np.stack([counts[:, np.flatnonzero(np.arange(1 << n) & (1 << x)), 0].sum(1) for x in range(n)], 1)
                only = counts[:, 1 << np.arange(n), 0]
                names = np.array(["".join(letters[x] for x in o) for o in orders])
                long = lambda x: pa.array(np.ascontiguousarray(np.broadcast_to(x, shape)).ravel(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(long(part)), pa.array(np.broadcast_to(names[None, :, None], shape).ravel()), pa.array(np.broadcast_to(np.arange(1, n + 1, dtype=np.int32), shape).ravel()),
                        long(figures[..., 0]), long(figures[..., 1]), long(fails[part, which] - figures[..., 1]), long(only[part, which]), long(figures[..., 2]), long(figures[..., 3]), long(shapley[part, which]),
                    ],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
                )

    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # 2 ** n at most
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return parts.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None, part: str = "source") -> DataFrame:
    """Every order of the filters (failures by letter, and E for copies) over docs (doc_id, text, part)."""
    failures = text_failures(text_or_empty()) if failures is None else failures
    return interactions(cells(docs, labels, failures, part), "".join(failures) + DUPLICATE)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    letters = "ABCDE"
    orders = ", ".join(f"('{''.join(o)}')" for o in itertools.permutations(letters))
    bit = "CAST(power(2, ascii({0}) - 65) AS INT)"
    return rf"""
WITH known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), failing AS (
  SELECT x.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(x.doc_id > least, false) THEN 16 ELSE 0 END AS mask
  FROM texts x LEFT JOIN known k USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL
), steps AS (
  SELECT o AS filter_order, CAST(s AS INT) AS step, {bit.format("o[s]")} AS own, CAST(list_sum(list_transform(range(1, s), lambda k: {bit.format("o[k]")})) AS INT) AS earlier
  FROM (VALUES {orders}) v(o) CROSS JOIN range(1, 6) r(s)
), figures AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN mask & (own | coalesce(earlier, 0)) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & own <> 0 AND mask & coalesce(earlier, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM figures
"""


OP12_SQL = _sql()
