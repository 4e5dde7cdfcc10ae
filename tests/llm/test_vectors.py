import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import flat_graph, topk_search
from strataline.llm.components import components


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, chains and exact copies under three labels, with all that takes no part."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        rows.append((rng.normal(size=16), k % 3))
    centre = rng.normal(size=16)
    for k in range(150):
        rows.append((centre + 0.04 * rng.normal(size=16), 0))
    step = rng.normal(size=16) * 0.05
    for k in range(30):
        rows.append((centre * 2 + k * step, 1))
    rows += [(rows[0][0], 0)] * 3 + [(3 * rows[0][0], 0)] * 2
    out = [(k, [float(np.float32(x)) for x in v], label) for k, (v, label) in enumerate(rows)]
    n = len(out)
    out += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0] * 15 + [float("nan")], 0), (n + 3, [1.0] * 15 + [None], 0), (n + 4, [float("inf")] * 16, 0), (n + 5, out[0][1], None), (n + 6, [1.0, 2.0], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [], 0), (None, out[0][1], 0)]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>, label int").repartition(3).cache()


def plain_links(rows, cosine=0.98):
    """Of each row (by its place): its number of links, and the least id of its component."""
    good = [(k, np.array(e, float), y) for k, (i, e, y) in enumerate(rows) if i is not None and y is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    near = {k: set() for k, _, _ in good}
    for k, a, y in good:
        for j, b, z in good:
            if k != j and y == z and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                near[k].add(j)
    least = {}
    for k in near:
        todo, own = [] if k in least else [k], set()
        while todo:
            x = todo.pop()
            if x not in own:
                own.add(x)
                todo += near[x]
        least |= dict.fromkeys(own, min((rows[x][0] for x in own), default=None))
    return {k: len(x) for k, x in near.items()}, least


def by_id(rows, values):
    """values (by place) as values by id, for rows whose ids differ."""
    return {rows[k][0]: v for k, v in values.items()}


@pytest.mark.parametrize("shard, margin", [(4096, 0.1), (64, 0.2)])
def test_near_duplicates(vectors, shard, margin, monkeypatch, caplog):
    monkeypatch.setattr(flat_graph, "CENTRE_LOAD", 64)
    monkeypatch.setattr(flat_graph, "BLOCK", 50)
    rows = [tuple(r) for r in vectors.collect()]
    near, label = (by_id(rows, x) for x in plain_links(rows))
    got = flat_graph.with_all_rows(vectors, shard=shard, margin=margin).collect()
    assert len(got) == len(rows)
    links = {r["vec_id"]: r["n_links"] for r in got}
    assert all(links[i] <= n for i, n in near.items())
    assert sum(links[i] for i in near) >= 0.98 * sum(near.values())
    assert sum(r["component_id"] == label.get(r["vec_id"], r["vec_id"]) for r in got) >= 0.98 * len(got)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert any("true links" in r.message and int(r.args[1]) > 1000 for r in caplog.records)


@pytest.mark.parametrize("shard", [4096, 40])
def test_a_failed_audit_compares_everything(vectors, monkeypatch, shard):
    monkeypatch.setattr(flat_graph, "MIN_RECALL", 2.0)
    monkeypatch.setattr(flat_graph, "CENTRE_LOAD", 20)
    rows = [tuple(r) for r in vectors.collect()]
    near, label = (by_id(rows, x) for x in plain_links(rows))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in flat_graph.with_all_rows(vectors, shard=shard).collect()}
    assert all(got[i] == (n, label[i]) for i, n in near.items())


def test_rows_that_share_an_id(spark):
    import collections

    rng = np.random.default_rng(6)
    v = rng.normal(size=8)
    rows = [(5, v, 0), (5, -v, 0), (6, v + 0.01 * rng.normal(size=8), 0), (5, v, 0), (4, -2 * v, 0), (9, rng.normal(size=8), 0), (9, rng.normal(size=8), 0), (3, v, 1)]
    rows = [(i, e.tolist(), y) for i, e, y in rows]
    near, least = plain_links(rows)
    want = collections.Counter((rows[k][0], near[k], least[k]) for k in near)
    got = flat_graph.with_all_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == want and want[5, 1, 4] == 1


def test_shards_are_split_as_long_as_that_helps(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "CENTRE_LOAD", 30)
    monkeypatch.setattr(flat_graph, "CENTRES", 4)
    rng = np.random.default_rng(12)
    spread = np.concatenate([c + 0.02 * rng.normal(size=(60, 16)) for c in rng.normal(size=(20, 16))])
    tight = rng.normal(size=16) + 0.005 * rng.normal(size=(300, 16))
    rows = [(k, flat_graph._unit(v[None])[0].tobytes(), 16, 1, y) for k, (v, y) in enumerate([*((v, 0) for v in spread), *((v, 1) for v in tight)])]
    nodes = spark.createDataFrame([(k, y, d, bytearray(v), c) for k, v, d, c, y in rows], "node long, label int, dim int, v binary, copies long")
    got = flat_graph.deal(nodes, 100, 0.1).collect()
    homes = [r for r in got if r["home"]]
    assert sorted(r["node"] for r in homes) == list(range(1500))  # one home each
    assert len({r["centre"] for r in got if r["label"] == 0}) > 8 and max(r["centre"].count(".") for r in got) > 1
    assert {(r["centre"], r["parts"]) for r in got if r["label"] == 1} == {("", 3)}


@pytest.mark.parametrize("shard", [4096, 4])
def test_chains_with_shuffled_ids_are_one_component(spark, monkeypatch, shard):
    monkeypatch.setattr(flat_graph, "BLOCK", 5)
    rng = random.Random(3)
    turn = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    rows = [(i, turn(10 * k), 0) for k, i in enumerate((1, 5, 6, 2))]
    rows += [(100 + i, turn(11 * k), 1) for k, i in enumerate(rng.sample(range(30), 30))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in flat_graph.with_all_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=shard).collect()}
    near, label = (by_id(rows, x) for x in plain_links(rows))
    assert got == {i: (near[i], label[i]) for i in near} and set(label.values()) == {1, 100}


def test_range_search_from_medoids_alone():
    rng = np.random.default_rng(1)
    v = flat_graph._unit(np.concatenate((rng.normal(size=(500, 8)), rng.normal(size=8) + 0.05 * rng.normal(size=(100, 8)))))
    edges = flat_graph.build(v)
    a, k = np.nonzero(edges >= 0)
    b = edges[a, k]
    both = flat_graph.Edges(np.concatenate((a, b)), np.concatenate((b, a)), len(v))
    q, p = flat_graph.range_search(v, both, flat_graph.medoids(v), v, 0.98)
    true = v @ v.T >= 0.98
    assert true[q, p].all() and len(q) >= 0.95 * true.sum()


@pytest.mark.parametrize("shard, block, k", [(8192, 2048, 20), (50, 7, 3), (50, 7, 1000)])
def test_top_k(spark, vectors, shard, block, k):
    rows = [(i, np.floor(64 * np.array(e, float)).astype(int)) for i, e, _ in map(tuple, vectors.collect()) if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for i, q in rows:
        if i % 20 == 0:
            scored = sorted((-int(q @ v), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    got = topk_search.top_k(vectors, F.pmod("vec_id", F.lit(20)) == 0, k=k, shard=shard, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_of_large_values_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    large = [(k, [float(x) for x in v], 0) for k, v in enumerate(np.round(rng.normal(size=(60, 64)) * 10.0 ** rng.integers(0, 7, (60, 1))))]
    rows = [*large, *large[:30], (100, [1e300] * 64, 0), (101, [1.7e308] * 64, 0), (120, [0.0] * 64, 0)]
    q = [(i, [max(-(10**400), min(int(np.finfo(float).max), 64 * int(x))) for x in v]) for i, v, _ in rows]
    want = []
    for i, a in q:
        if i % 20 == 0:
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), j) for j, b in q if j != i)[:7]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.pmod("vec_id", F.lit(20)) == 0, k=7, shard=25, block=3)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 7 * 7


def test_search_agrees_with_its_sql(spark, vectors, tmp_path):
    import duckdb

    vectors.filter("vec_id is not null").union(vectors.filter("vec_id < 45")).write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.sql(topk_search.OP6_SQL).fetchall()
    assert sorted(map(tuple, topk_search.op6_topk_search(spark, str(tmp_path)).collect())) == sorted(want)


def test_trees_with_equal_points():
    points = np.ones((1000, 4))
    best = topk_search.search(points[:3], np.arange(3), points, np.arange(1000), 5, np.full(3, topk_search._LOW))
    query, places, scores = best.found()
    assert sorted(zip(query.tolist(), places.tolist(), strict=True)) == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 0), (1, 2), (1, 3), (1, 4), (1, 5), (2, 0), (2, 1), (2, 3), (2, 4), (2, 5)]
    assert set(scores.tolist()) == {4}


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert flat_graph.with_all_rows(none).count() == 0
    assert topk_search.top_k(none, F.col("vec_id") == 0).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    want = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(want[a], want[b])
            changed |= want[a] != low or want[b] != low
            want[a] = want[b] = low
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: y for x, y in want.items() if any(x in link and link[0] != link[1] for link in links)}


@pytest.mark.parametrize("kind, bits", [("pairs", 0), ("pairs", 6), ("numbers", 6), ("sketch", 0), ("sketch", 6), ("crowded sketch", 3)])
def test_counts_are_answered_to_all_chunks(spark, monkeypatch, bits, kind):
    from strataline.llm import dealt
    from strataline.llm.dealt import column, distinct
    from strataline.llm.words import mixed

    monkeypatch.setattr(dealt, "range_bits", lambda n: bits)
    monkeypatch.setattr(dealt, "CHUNK", 40)
    rng = np.random.default_rng(8)
    plain = rng.integers(0, 3000, 5000)
    df = spark.createDataFrame([(str(x),) for x in plain], "x string").repartition(9)
    sketch = dealt.CountMin.sized(60 if "crowded" in kind else 5000)

    def hashes(rows):
        values = mixed(column(rows, "x").cast("uint64").to_numpy() + np.uint64(1))
        return np.stack((values >> np.uint64(50), values), 1) if kind == "pairs" else values  # many share the first half

    def keys(rows, known):
        own, back = distinct(hashes(rows))
        counts = np.minimum(np.bincount(back), 255)
        return sketch.sketch(own, counts) if "sketch" in kind else (own, counts)

    chunks = dealt.chunked(df, "x", 5000, "test")
    found = dealt.with_answers(chunks, dealt.answers(chunks, keys, 5000, "a", kind == "pairs"))
    true = dict(zip(*np.unique(plain, return_counts=True), strict=True))
    rows = right = 0
    for _, own, (answer,) in dealt.each(iter(found.toArrow().to_batches())):
        values = dealt.column(own, "x").cast("int64").to_numpy()
        rows += len(values)
        each, back = dealt.distinct(hashes(own))
        counts = sketch.estimates(each, answer) if "sketch" in kind else answer
        for x, got in zip(values.tolist(), counts[back].tolist(), strict=True):
            least = int(true[x]).bit_length()
            assert got >= least and ("sketch" in kind or got == least)
            right += got == least
    assert rows == 5000 and (right > 4900) == ("crowded" not in kind)


@pytest.fixture(scope="module")
def families(spark):
    """20,000 nodes, of which 40 groups of 10 are near copies, and the links of each node within its group."""
    rng = np.random.default_rng(9)
    v = flat_graph._unit(rng.normal(size=(20_000, 16)))
    for g in range(40):
        v[g * 10 : g * 10 + 10] = flat_graph._unit(v[g * 10] + 0.01 * rng.normal(size=(10, 16)))
    nodes = spark.createDataFrame([(0, 16, k, 1, x.tobytes()) for k, x in enumerate(v)], "label int, dim int, node long, copies long, v binary").repartition(4).cache()
    return nodes, [(k, 9) for k in range(400)]


@pytest.mark.parametrize("lost, recall", [(0, 1.0), (20, 0.5), (32, 0.2)])
def test_audit_is_not_misled_by_what_was_found(spark, families, lost, recall):
    nodes, links = families
    found = spark.createDataFrame([x for x in links if x[0] >= 10 * lost], "node long, n long")
    measured, seen = flat_graph.audit(nodes, found, 0.98)
    assert seen >= flat_graph.AUDIT_LINKS and abs(measured - recall) < 0.1


def test_audit_says_when_it_cannot_tell(spark, families, monkeypatch):
    nodes, links = families
    monkeypatch.setattr(flat_graph, "AUDIT_MOST", 256)
    assert flat_graph.audit(nodes, spark.createDataFrame(links, "node long, n long"), 0.98)[0] is None
    few = nodes.filter("node >= 19900")
    assert flat_graph.audit(few, spark.createDataFrame([], "node long, n long"), 0.98) == (1.0, 0)  # all of them were compared


def test_an_unmeasured_graph_takes_the_certain_way(spark, families, monkeypatch, caplog):
    nodes, links = families
    monkeypatch.setattr(flat_graph, "AUDIT_MOST", 256)
    df = nodes.select(F.col("node").alias("vec_id"), "label", "v").rdd.map(lambda r: (r[0], np.frombuffer(r[2]).tolist(), r[1])).toDF("vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in flat_graph.near_duplicates(df).collect()}
    assert {k: n for k, n in got.items() if n} == dict(links)
    assert "not measured" in caplog.text and "compared" in caplog.text
