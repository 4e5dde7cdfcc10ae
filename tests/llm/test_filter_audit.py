"""The audit of filters against a plain simulation of every order."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from strataline.llm import filter_audit

from .test_text_operators import empty


def plain(rows, labels):
    """Rows (part, order, step, kept, ..) by running each order over all documents."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= set() if len(words) >= 200 else {"A"}
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            fails.add("E")
        docs.append((source or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[f] += len(gone)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(total[f])
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 80, 2)] + [(4, 1, 1), (6, None, None), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_audit(spark, documents, labels):
    rows = documents.collect()
    marked = [(1000 + k, (r["text"] or "") + m, r["lang"], "s0", 1) for k, r in enumerate(rows[:20]) for m in ("", " #", " ABCDEF")]
    docs = documents.unionByName(spark.createDataFrame(marked, documents.schema))
    docs = docs.withColumns({c: F.lit("x") for c in ("part", "mask", "bits", "a.b", "digest")})
    want = plain([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == want


def test_audit_of_nothing(spark, labels):
    none = filter_audit.audit(empty(spark), labels)
    assert none.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"] and none.isEmpty()
    one = spark.createDataFrame([(None, None, None), (None, None, "")], "doc_id long, text string, source string")
    found = filter_audit.audit(one, labels.limit(0)).collect()
    assert len(found) == 600 and {r["part"] for r in found} == {""} and all(r["removed"] == 2 * (r["filter_order"][r["step"] - 1] == "A") for r in found)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), set()
    seen.add(tuple(order))
    for k in filter_audit.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(order)))


def test_too_many_filters(spark, documents, labels):
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(documents, labels, {c: F.lit(True) for c in "ABCDFGHI"})
