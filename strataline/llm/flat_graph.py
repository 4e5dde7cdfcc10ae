"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are told apart by label and content first, so exact copies are one node
with a count and an id of its own. Shards begin as all nodes of a label and are
split as long as they are large: centres are fitted on a bounded sample of the
shard, and a node goes to its nearest centre and, where the boundary to another
one is near, to that one's shard as well. A pair within the radius then shares
the home shard of each side, but for boundaries that lie across the pair
(MARGIN). Shards whose nodes would mostly go to several centres stay whole.
Within a shard, candidates of each node are pruned robustly (a neighbour is left
out if one already kept is much nearer to it), with some distant ones among
them. The adjacency lists of all shards are united by node. Then every node is
searched for in its home shard: greedily from the nearest medoids, and from
there as long as the range grows, over all neighbours within the radius and some
slack beyond it. All found are verified by their cosine in double precision.

A shard larger than SHARD nodes is dealt to several parts, and queries go to
all of them in blocks of BLOCK, so a group of near copies of any size is never
one task. Links stay counts: each query's number, and the smallest node that a
task's links connect it to, from which the components are made. ``audit``
measures recall against brute force on nodes drawn evenly from all, whether they
have found links or not, until these have AUDIT_LINKS true links or are all
nodes. Below MIN_RECALL, and where AUDIT_MOST nodes have too few true links to
tell, the nodes are dealt again with the margin that is certain, and all nodes
of a part are compared. The recall of what is returned is logged.

``build`` compares all nodes of a shard to choose neighbours among them, so
within a shard the graph saves searches and not comparisons; what it adds are
links across shards, by the edges that other shards gave to a node.

Defined results: vectors without a label, that are null or zero, or hold null
or non-finite components, link with nothing, and so do rows without an id (their
component is null). Vectors of different lengths link with nothing. Rows that
share an id are vectors of their own, whether they are equal or not.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ragged
from .common import drop, table, written
from .components import components
from .vectors import binary, matrix, usable
from .workers import released

COSINE = 0.98
SHARD = 4096
BLOCK = 2048
#: Centres are fitted on so many nodes of a shard, of so many bytes, at most.
SAMPLE, SAMPLE_BYTES = 20_000, 64_000_000
#: Nodes of the sample for each centre, nodes of a shard for each centre, and centres that a shard is split by at once.
PER_CENTRE, CENTRE_LOAD, CENTRES = 20, 2048, 256
#: Shards that a node goes to on average; where it would be more, splitting gains nothing.
OVERLAP = 2.0
#: Of the distance between two centres; the sine of the radius, about 0.2, would be certain.
MARGIN = 0.1
CANDIDATES, DEGREE, DISTANT = 48, 16, 8
ALPHA = 1.2
SLACK = 0.02
BEAM = 8
#: Queries that are searched for together, and pairs of query and node that are expanded together.
SEARCH, EXPAND = 256, 20_000
#: Nodes of the first sample and of the last one, each four times the one before; true links that are enough to stop, and to tell anything.
AUDIT, AUDIT_MOST, AUDIT_LINKS, LEAST_LINKS = 256, 16_384, 1000, 100
MIN_RECALL = 0.98

_log = logging.getLogger(__name__)


def _unit(rows: np.ndarray) -> np.ndarray:
    most = np.abs(rows).max(1, keepdims=True)
    rows = rows / np.where(most > 0, most, 1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True).clip(1e-300)


def nodes_of(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, dim and v, raw doubles of length one, of the rows that take part."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in usable(batch.column(2)):
                some = rows.any(axis=1)
                at, rows = pa.array(at[some]), _unit(rows[some])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(rows), rows.shape[1], np.int32)), binary(rows)], ["vec_id", "label", "dim", "v"])

    kind = df.schema[label].dataType.simpleString()
    own = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    own = own.filter("vec_id is not null and label is not null")
    return own.mapInArrow(run, f"vec_id long, label {kind}, dim int, v binary")


def centres(rows: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centres of the rows, by a few rounds of k-means from evenly spaced ones."""
    mid = rows[np.linspace(0, len(rows) - 1, max(1, k)).astype(int)]
    for _ in range(rounds):
        near = np.argmax(rows @ mid.T, axis=1)
        total = np.zeros_like(mid)
        np.add.at(total, near, rows)
        some = np.bincount(near, minlength=len(mid)) > 0
        mid = np.where(some[:, None], _unit(np.where(some[:, None], total, 1.0)), mid)
    return mid


def shards_of(rows: np.ndarray, mid: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, centre and whether it is the row's home, for each shard of each row."""
    near = rows @ mid.T
    home = near.argmax(1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * mid @ mid.T))
    inside = near[np.arange(len(rows)), home][:, None] - near <= margin * gap[home]
    row, centre = np.nonzero(inside)
    return row, centre, centre == home[row]


def robust_prune(v: np.ndarray, who: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """At most ``degree`` neighbours of each node in who, of its candidates (own place or repeats left out as -1)."""
    far = 2 - 2 * np.einsum("bd,bcd->bc", v[who], v[candidates])
    far = np.where((candidates == who[:, None]) | (candidates < 0), np.inf, far)
    out = np.full((len(who), degree), -1)
    rows = np.arange(len(who))
    for k in range(degree):
        pick = far.argmin(1)
        open_ = np.isfinite(far[rows, pick])
        if not open_.any():
            break
        chosen = candidates[rows, pick]
        out[open_, k] = chosen[open_]
        between = 2 - 2 * np.einsum("bd,bcd->bc", v[chosen], v[candidates])
        far = np.where((alpha * alpha * between <= far) | ~open_[:, None], np.inf, far)
        far[rows, pick] = np.inf
    return out


def build(v: np.ndarray, seed: int = 0) -> np.ndarray:
    """Adjacency of a shard: rows of places, -1 where there are fewer; reverse edges are not among them."""
    n = len(v)
    rng = np.random.default_rng(seed)
    out = np.full((n, DEGREE), -1)
    step = 512
    for a in range(0, n, step):
        who = np.arange(a, min(n, a + step))
        near = v[who] @ v.T
        near[np.arange(len(who)), who] = -np.inf
        m = min(CANDIDATES, n)
        candidates = np.argpartition(-near, m - 1, axis=1)[:, :m]
        candidates = np.concatenate((candidates, rng.integers(0, n, (len(who), DISTANT))), axis=1)
        out[who] = robust_prune(v, who, candidates)
    return out


def medoids(v: np.ndarray, most: int = 64) -> np.ndarray:
    """Places of nodes that stand for the shard: the nearest to each centre of its own."""
    mid = centres(v, min(most, len(v) // 32), 2)
    return np.unique((v @ mid.T).argmax(0))


class Edges:
    """Adjacency lists, one after the other; places of each node's neighbours."""

    def __init__(self, owner: np.ndarray, to: np.ndarray, n: int):
        order = np.argsort(owner, kind="stable")
        self.to = to[order]
        self.lens = np.bincount(owner, minlength=n)
        self.begins = np.cumsum(self.lens) - self.lens

    def of(self, q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and neighbour, for each neighbour of each place."""
        return np.repeat(q, self.lens[p]), self.to[ragged(self.begins[p], self.lens[p])]


def range_search(v: np.ndarray, edges: Edges, starts: np.ndarray, queries: np.ndarray, cosine: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Query and place of all found within the range. own: a query's place, or -1."""
    n = len(v)
    seen = np.zeros((len(queries), n), bool)
    found_q, found_p = [], []

    def look(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.unique(q * n + p)
        q, p = flat // n, flat % n
        new = ~seen[q, p]
        q, p = q[new], p[new]
        seen[q, p] = True
        cos = np.empty(len(q))
        for a in range(0, len(q), 65536):
            cos[a : a + 65536] = np.einsum("id,id->i", queries[q[a : a + 65536]], v[p[a : a + 65536]])
        hit = cos >= cosine
        found_q.append(q[hit])
        found_p.append(p[hit])
        return q, p, cos

    everyone = np.arange(len(queries))
    near = queries @ v[starts].T
    m = min(BEAM, len(starts))
    first = np.argpartition(-near, m - 1, axis=1)[:, :m]
    q, p = np.repeat(everyone, m), starts[first].ravel()
    if own is not None:
        q, p = np.concatenate((q, everyone[own >= 0])), np.concatenate((p, own[own >= 0]))
    best = np.full(len(queries), -np.inf)
    wide = cosine - SLACK
    q, p, cos = look(q, p)
    while len(q):
        before = best.copy()
        np.maximum.at(best, q, cos)
        order = np.lexsort((-cos, q))
        rank = np.empty(len(q), np.int64)
        rank[order] = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        better = (cos >= best[q] - SLACK) & (best[q] > before[q]) & (rank < BEAM)
        go = (cos >= wide) | better
        q, p = q[go], p[go]
        parts = []
        for a in range(0, len(q), EXPAND):  # a part's neighbours that were looked at are not looked at again
            parts.append(look(*edges.of(q[a : a + EXPAND], p[a : a + EXPAND])))
        q, p, cos = (np.concatenate([x[i] for x in parts]) for i in range(3)) if parts else (q, p, np.empty(0))
    return np.concatenate(found_q), np.concatenate(found_p)


def _table(**columns) -> pa.Table:
    return pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})


_SHARD = ("label", "dim", "centre")
_KEYS = (*_SHARD, "part")


def _same(other: str = "2"):
    return (F.col("label") == F.col(f"label{other}")) & (F.col("dim") == F.col(f"dim{other}")) & (F.col("centre") == F.col(f"centre{other}"))


def split_once(members: DataFrame, shard: int, margin: float, level: int) -> DataFrame | None:
    """members with their large shards split, or None if none is large and can be."""
    spark = members.sparkSession
    kind = members.schema["label"].dataType.simpleString()
    sizes = members.groupBy(*_SHARD).agg(F.count("*").alias("n")).filter(F.col("n") > shard)
    sizes = written(sizes.select(*[F.col(c).alias(f"{c}2") for c in _SHARD], "n"), "sizes")
    most = F.least(F.lit(SAMPLE), F.greatest(F.lit(PER_CENTRE), F.floor(F.lit(SAMPLE_BYTES) / (8 * F.col("dim")))))
    draw = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / (1 << 30)
    sample = members.join(sizes, _same()).filter(draw < most / F.col("n")).select(*_SHARD, "n", "node", "v")

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        v, n = matrix(rows.column("v")), rows.column("n")[0].as_py()
        k = min(CENTRES, math.ceil(n / CENTRE_LOAD), len(v) // PER_CENTRE)
        mid = np.unique(centres(v, k), axis=0)
        splits = len(mid) > 1 and len(shards_of(v, mid, margin)[0]) <= OVERLAP * len(v)
        own = rows.slice(0, int(splits))
        return _table(label=own.column("label"), dim=own.column("dim"), centre=own.column("centre"), n=own.column("n"), mid=pa.array([mid.tobytes()] * int(splits), pa.binary()))

    fits = written(sample.groupBy(*_SHARD).applyInArrow(fit, f"label {kind}, dim int, centre string, n long, mid binary"), "fits")
    if fits.isEmpty():
        return None
    slices = F.ceil(F.col("n") / shard)
    known = fits.select(*[F.col(c).alias(f"{c}2") for c in _SHARD], slices.alias("slices"))
    open_ = members.join(known, _same()).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices"))).select(*members.columns, "slice")
    mids = fits.select(*_SHARD, "mid", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"))

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        v = matrix(left.column("v"))
        row, centre, home = shards_of(v, matrix(right.column("mid")).reshape(-1, v.shape[1]), margin)
        own = left.select(columns).take(pa.array(row))
        names = pa.array([f"{c}.{k}" for c, k in zip(own.column("centre").to_pylist(), centre.tolist(), strict=True)], pa.string())
        own = own.set_column(columns.index("centre"), "centre", names)
        return own.set_column(columns.index("home"), "home", pa.array(home & own.column("home").to_numpy()))

    columns = list(members.columns)
    types = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    empty = pa.table({c: pa.array([], types.get(t, pa.null())) for c, t in members.dtypes})
    dealt = open_.groupBy(*_SHARD, "slice").cogroup(mids.groupBy(*_SHARD, "slice")).applyInArrow(assign, members.schema)
    closed = members.join(known, _same(), "left_anti")
    return written(closed.unionByName(dealt), "members")


def deal(nodes: DataFrame, shard: int, margin: float) -> DataFrame:
    """Nodes with the shards that they are in (home: the one that they are searched for in), and each one's part; written."""
    members = nodes.select("node", "label", "dim", "v", "copies").withColumns({"centre": F.lit("").cast("string"), "home": F.lit(True)})
    members, level = written(members, "members"), 0
    while (finer := split_once(members, shard, margin, level)) is not None:
        drop(members)
        members, level = finer, level + 1
    sizes = members.groupBy(*_SHARD).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("queries"))
    sizes = sizes.select(*[F.col(c).alias(f"{c}2") for c in _SHARD], F.ceil(F.col("n") / shard).alias("parts"), F.greatest(F.lit(1), F.ceil(F.col("queries") / BLOCK)).alias("blocks"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    out = written(members.join(sizes, _same()).withColumn("part", part).select(*members.columns, "parts", "blocks", "part"), "members")
    drop(members)
    return out


def adjacency(members: DataFrame) -> DataFrame:
    """node and its neighbours, united over the shards that it is in, with the edges of both directions."""

    def run(part: pa.Table) -> pa.Table:
        ids, v = part.column("node").to_numpy(), matrix(part.column("v"))
        edges = build(v, int(ids.min()) & 0xFFFF)
        a, k = np.nonzero(edges >= 0)
        b = edges[a, k]
        return _table(node=np.concatenate((ids[a], ids[b])), near=np.concatenate((ids[b], ids[a])))

    edges = members.select("node", "v", *_KEYS).groupBy(*_KEYS).applyInArrow(run, "node long, near long")
    return edges.groupBy("node").agg(F.collect_set("near").alias("near"))


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, the smallest place of each place's component, after the components of a[i] and b[i] are one for each i."""
    label = label.copy()
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


_FOUND = "node long, links long, root long"


def found_links(members: DataFrame, edges: DataFrame, cosine: float, everything: bool = False) -> DataFrame:
    """node, links (vectors linked in one part, for a query) and root (the smallest node that the links of a task connect it to) of each node with links."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(node=pa.array([], pa.int64()), links=pa.array([], pa.int64()), root=pa.array([], pa.int64()))
        left = left.sort_by("node")
        ids, v, copies = left.column("node").to_numpy(), matrix(left.column("v")), left.column("copies").to_numpy()
        lists = left.column("near").combine_chunks()
        lens = np.diff(lists.offsets.to_numpy())
        near = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        known = ids[at] == near
        owner = np.repeat(np.arange(len(ids)), lens)[known]
        at = at[known]
        edges = Edges(owner, at, len(ids))
        query_ids, queries = right.column("query").to_numpy(), matrix(right.column("qv"))
        own = np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
        own = np.where(ids[own] == query_ids, own, -1)
        starts = np.arange(len(ids)) if everything else medoids(v)
        every = np.union1d(ids, query_ids)
        place, query_place = np.searchsorted(every, ids), np.searchsorted(every, query_ids)
        links, root = np.zeros(len(every), np.int64), np.arange(len(every))
        for a in range(0, len(queries), SEARCH):
            b = slice(a, a + SEARCH)
            if everything:
                x, y = np.nonzero(queries[b] @ v.T >= cosine)
            else:
                x, y = range_search(v, edges, starts, queries[b], cosine, own[b])
            p, q = place[y], query_place[b][x]
            other = q != p
            np.add.at(links, q[other], copies[y[other]])
            root = united(root, q[other], p[other])
        some = (links > 0) | (root != np.arange(len(every)))
        return _table(node=every[some], links=links[some], root=every[root[some]])

    near = edges.select(F.col("node").alias("n2"), "near")
    held = members.join(near, F.col("node") == F.col("n2"), "left").select("node", "v", "copies", F.coalesce("near", F.array().cast("array<long>")).alias("near"), *_KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    asked = members.filter("home").select(
        F.col("node").alias("query"), F.col("v").alias("qv"), *[F.col(c).alias(c) for c in _KEYS[:3]],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("block"),
    )
    keys = [*_KEYS, "block"]
    return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, _FOUND)


def _drawn(nodes: DataFrame, most: int, seed: int) -> DataFrame:
    """About so many nodes, by a hash, and never more than twice as many."""
    share = min(1.0, most / max(1, nodes.count()))
    return nodes.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).limit(2 * most)


def _true_links(nodes: DataFrame, sample: DataFrame, cosine: float) -> dict[int, int]:
    """Links of each node of a sample, by brute force over all nodes."""
    by: dict[tuple, list] = {}
    for r in sample.select("node", "label", "dim", "v").collect():
        by.setdefault((r["label"], r["dim"]), []).append((r["node"], r["v"]))
    groups = {k: (np.array([n for n, _ in x]), np.frombuffer(b"".join(v for _, v in x)).reshape(len(x), -1)) for k, x in by.items()}

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims, ids, copies = (batch.column(i).to_pylist() for i in range(4))
            where: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(labels, dims, strict=True)):
                if k in groups:
                    where.setdefault(k, []).append(i)
            for k, at in where.items():
                names, rows = groups[k]
                hit = rows @ matrix(batch.column(4).take(pa.array(at))).T >= cosine
                hit &= names[:, None] != np.array([ids[i] for i in at])
                n = hit @ np.array([copies[i] for i in at])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64))], ["node", "n"])

    counts = nodes.select("label", "dim", "node", "copies", "v").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return {r["node"]: r["n"] for r in counts.collect()}


def audit(nodes: DataFrame, found: DataFrame, cosine: float) -> tuple[float | None, int]:
    """Share of the true links of evenly drawn nodes that were found, and how many true links these have; None if they are too few to tell. found: node, n (links to others)."""
    row = nodes.agg(F.max("dim"), F.count(F.lit(1))).first()
    dim, total = row[0] or 1, row[1]
    most = AUDIT
    while True:
        least = max(1, min(most, SAMPLE_BYTES // (16 * dim)))  # twice as many are within SAMPLE_BYTES
        sample = written(_drawn(nodes, least, 7), "sample")
        true = _true_links(nodes, sample, cosine)
        links = sum(true.values())
        everything = least >= total
        if links >= AUDIT_LINKS or everything or most >= AUDIT_MOST:
            break
        most *= 4
        drop(sample)
    if not everything and links < LEAST_LINKS:
        return None, links
    have = {r["node"]: r["n"] for r in found.join(sample.select(F.col("node").alias("n2")), F.col("node") == F.col("n2"), "left_semi").collect()}
    return (sum(min(n, have.get(k, 0)) for k, n in true.items()) / links if links else 1.0), links


def near_duplicates(df: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shard: int = SHARD, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links and component_id of each row that takes part."""
    rows = written(nodes_of(df, vec_id, embedding, label), "vectors")
    nodes = rows.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    for certain in (False, True):
        members = deal(nodes, shard, math.sqrt(1 - cosine * cosine) + 1e-9 if certain else margin)
        edges = written(adjacency(members), "edges")
        found = written(found_links(members, edges, cosine, certain), "found")
        links = written(found.groupBy("node").agg(F.sum("links").alias("n")), "links")
        drop(members)
        drop(edges)
        recall, seen = audit(nodes, links, cosine)
        _log.warning("recall %s over %d true links%s", "not measured" if recall is None else f"{recall:.4f}", seen, ", all nodes of a part compared" if certain else "")
        if recall is not None and recall >= MIN_RECALL:
            break
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("n3"), F.col("label").alias("component"))
    known = nodes.join(links.select(F.col("node").alias("n2"), "n"), F.col("node") == F.col("n2"), "left").join(labels, F.col("node") == F.col("n3"), "left")
    known = written(known.select("label", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "known")
    names = known.groupBy(F.col("component").alias("c2")).agg(F.min("least").alias("component_id"))
    named = known.join(names, F.col("component") == F.col("c2")).select(F.col("label").alias("l2"), F.col("v").alias("v2"), "n_links", "component_id")
    return rows.join(named, (F.col("label") == F.col("l2")) & (F.col("v") == F.col("v2"))).select("vec_id", "n_links", "component_id")


def with_all_rows(df: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **options) -> DataFrame:
    """near_duplicates, with a row for each row of df: those that take no part are alone."""
    linked = near_duplicates(df, cosine, vec_id, embedding, label, **options)
    bad = F.col("bad")
    ids = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).isNull().alias("bad"), F.col(embedding).alias("e"))
    e = F.transform("e", lambda x: x.cast("double"))
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(e, lambda x: x == 0)
    alone = ids.filter(F.coalesce(bad | F.col("e").isNull() | odd | zero, F.lit(True)) | F.col("vec_id").isNull())
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = alone.unionByName(linked)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_all_rows(table(spark, sf_dir, "embeddings"))
