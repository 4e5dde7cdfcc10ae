"""Exact top-k inner-product search with a KD-tree per shard.

Vectors are dealt to shards by a hash of their ids, so copies spread evenly. A
shard's tree splits at medians of the widest side, and every node has the tight
bounding box of its points. A box's bound for a query is the largest inner
product that any point of the box can have. A query goes down to its most
promising leaf first, then to the others by falling bounds, until the bound is
below the k-th score that it has. That score starts from what the query found
in its first shard, which is searched before the others.

All queries meet all shards, in blocks of bounded size: a task holds at most
about SHARD vectors and BLOCK queries. Scores are whole numbers: products of
doubles as long as these are exact, of 64-bit integers or Python's beyond.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an id; vectors of another length
than the query's are no candidates; rows that share the query's id are its own.
Every row counts: a candidate that is there twice can take two ranks, and a
query that is there twice is answered twice. Ties go to the smaller id; fewer
candidates than k give fewer ranks. Scores beyond a long are its ends, and
components that are too large for a double the largest one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .vectors import binary, matrix, usable
from .workers import released

K = 20
SCALE = 64
EVERY = 20
SHARD = 8192
BLOCK = 2048
LEAF = 256
#: No score; all scores are higher.
_LOW = np.iinfo(np.int64).min
_LARGEST = np.finfo(np.float64).max
_NOWHERE = np.iinfo(np.int64).max


class KdTree:
    """Nodes in arrays; node i has the points order[begin[i]:end[i]] and the box low[i], high[i]. child < 0: a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        self.begin, self.end, self.child = [0], [len(points)], [-1]
        self.low, self.high = [points.min(0)], [points.max(0)]
        todo = [0]
        while todo:
            i = todo.pop()
            a, b = self.begin[i], self.end[i]
            side = int(np.argmax(self.high[i] - self.low[i]))
            if b - a <= leaf or self.high[i][side] == self.low[i][side]:
                continue
            own = self.order[a:b]
            mid = (b - a) // 2
            self.order[a:b] = own[np.argpartition(points[own, side], mid)]
            self.child[i] = len(self.begin)
            for x, y in ((a, a + mid), (a + mid, b)):
                todo.append(len(self.begin))
                inside = points[self.order[x:y]]
                self.begin.append(x)
                self.end.append(y)
                self.child.append(-1)
                self.low.append(inside.min(0))
                self.high.append(inside.max(0))
        self.child = np.array(self.child)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The most that a point of each node can score with each query, and what rounding may take from it."""
        high, low = self.high[nodes].T, self.low[nodes].T
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low
            wide = np.abs(queries) @ np.maximum(np.abs(high), np.abs(low))
            return np.where(wide < 2**53, most, np.nan_to_num(most + 1e-12 * wide, nan=np.inf))


class Best:
    """The scores and places of the k best points of each query so far; of equal scores, the first places."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.scores, self.places = np.full((n, k), _LOW), np.full((n, k), _NOWHERE)

    def kth(self, rows: np.ndarray) -> np.ndarray:
        """A score that a box must be able to reach."""
        return np.maximum(self.scores[rows].min(axis=1), self.least[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, places: np.ndarray, own: np.ndarray) -> None:
        """scores of the points at these places, one row for each of the queries in rows; own: which are the query's own."""
        scores = np.concatenate((self.scores[rows], np.where(own, _LOW, scores)), axis=1)
        places = np.concatenate((self.places[rows], np.where(own, _NOWHERE, places)), axis=1)
        kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k, None]
        taken = scores >= kth
        for r in np.flatnonzero(taken.sum(axis=1) > self.k):  # ties at the end
            ties = np.flatnonzero(scores[r] == kth[r])
            spare = int(taken[r].sum()) - self.k
            taken[r, ties[np.argsort(places[r, ties], kind="stable")[-spare:]]] = False
        self.scores[rows], self.places[rows] = (x[taken].reshape(-1, self.k) for x in (scores, places))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and score of all that were found."""
        query, n = np.nonzero(self.scores > _LOW)
        return query, self.places[query, n], self.scores[query, n]


def _products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, within the range of a long."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries @ points.T).astype(np.int64)
    if most < 2**62:
        return queries.astype(np.int64) @ points.astype(np.int64).T
    whole = [[int(x) for x in row] for row in points]
    end = 2**63 - 1
    return np.array([[max(-end, min(end, sum(int(a) * b for a, b in zip(q, p, strict=True)))) for p in whole] for q in queries], np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> Best:
    """The k best points (by rising id) of each query, its own left out. least: a score that the k-th of all shards has or exceeds."""
    best = Best(len(queries), k, least)
    if not len(points) or not len(queries):
        return best
    tree = KdTree(points)

    def visit(node: int, rows: np.ndarray) -> None:
        own = tree.order[tree.begin[node] : tree.end[node]]
        best.offer(rows, _products(queries[rows], points[own]), own, query_ids[rows][:, None] == ids[own])

    everyone = np.arange(len(queries))
    at = np.zeros(len(queries), np.int64)  # down to the most promising leaf
    while (inner := np.flatnonzero(tree.child[at] >= 0)).size:
        kids = tree.child[at[inner]]
        for node in np.unique(kids):
            rows = inner[kids == node]
            both = tree.bounds(queries[rows], np.array([node, node + 1]))
            at[rows] = node + (both[:, 1] > both[:, 0])
    for node in np.unique(at):
        visit(int(node), everyone[at == node])
    first = at
    rows, nodes = everyone, np.zeros(len(queries), np.int64)  # the others, from the root, as far as bounds allow
    leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        next_rows, next_nodes = [], []
        for node in np.unique(nodes):
            own = rows[nodes == node]
            bound = tree.bounds(queries[own], np.array([node]))[:, 0]
            may = bound >= best.kth(own)
            own, bound = own[may], bound[may]
            if tree.child[node] >= 0:
                for kid in (0, 1):
                    next_rows.append(own)
                    next_nodes.append(np.full(len(own), tree.child[node] + kid))
            else:
                rest = first[own] != node
                leaves.append((own[rest], np.full(int(rest.sum()), node), bound[rest]))
        rows, nodes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (next_rows, next_nodes))
    rows, nodes, bound = (np.concatenate([x[i] for x in leaves]) for i in range(3)) if leaves else [np.empty(0, np.int64)] * 3
    order = np.lexsort((-bound, rows))
    rows, nodes, bound = rows[order], nodes[order], bound[order]
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
    turn = np.where(turn < 4, turn, 4 + (turn - 4) // 8)  # falling bounds; later leaves by eights
    for step in range(int(turn.max(initial=-1)) + 1):
        now = turn == step
        own, places, limit = rows[now], nodes[now], bound[now]
        may = limit >= best.kth(own)
        own, places = own[may], places[may]
        for node in np.unique(places):
            visit(int(node), own[places == node])
    return best


def quantized(df: DataFrame, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, dim and q (whole numbers as raw doubles) of the rows that take part."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in usable(batch.column(1)):
                with np.errstate(over="ignore"):
                    q = np.clip(np.floor(scale * rows), -_LARGEST, _LARGEST) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), rows.shape[1], np.int32)), binary(q)], ["vec_id", "dim", "q"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).filter("vec_id is not null")
    return rows.mapInArrow(run, "vec_id long, dim int, q binary")


_FOUND = "query_id long, query_row long, vec_id long, score long"


def _nothing() -> pa.Table:
    return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "query_row", "vec_id", "score")})


def top_k(df: DataFrame, is_query, k: int = K, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of each row for which the condition is_query holds."""
    rows = quantized(df.filter(F.col(vec_id).isNotNull()), scale, vec_id, embedding)
    points = written(rows.withColumn("row", F.monotonically_increasing_id()), "points")
    queries = points.filter(is_query)
    n_shards, n_blocks = max(1, math.ceil(points.count() / shard)), max(1, math.ceil(queries.count() / block))
    points = points.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_blocks)))
    home = queries.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(n_shards)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>"))
    held = points.withColumn("block", every_block)
    keys = ["dim", "shard", "block"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # an absent side has no columns
            return _nothing()
        left = left.sort_by("vec_id")
        ids, query_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        best = search(matrix(right.column("query")), query_ids, matrix(left.column("q")), ids, k, right.column("least").to_numpy())
        at, places, scores = best.found()
        return pa.table({"query_id": query_ids[at], "query_row": right.column("query_row").take(pa.array(at)), "vec_id": ids[places], "score": scores})

    def met(queries: DataFrame) -> DataFrame:
        return held.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, _FOUND)

    own = {"query_id": "vec_id", "query_row": "row", "query": "q"} | {c: c for c in keys}
    asked = [F.col(c).alias(name) for name, c in own.items()]  # new columns: both sides come from the same table
    first = met(home.select(*asked, F.lit(_LOW).alias("least")))
    kth = written(first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k), "kth")
    kth = kth.select(F.col("query_row").alias("r2"), "least")
    known = queries.join(kth, F.col("row") == F.col("r2"), "left")
    known = known.select("vec_id", "row", "q", "dim", "block", F.coalesce("least", F.lit(_LOW)).alias("least"))
    everywhere = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)).cast("array<long>")))
    found = met(everywhere.select(*asked, "least"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(EVERY)) == 0)


#: One pass over all pairs, as the contract states it.
OP6_SQL = r"""
WITH ints AS (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.nth, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM ints a JOIN ints b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
