"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strataline.llm import spelling_variants as sv

from .test_text_operators import empty


def near(a, b):
    """Distance one, by dynamic programming."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] == 1


def plain_counts(rows, every=97, length=5, count=3):
    found = collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= count}


def plain_variants(words):
    forms, out = {}, []
    for w, n in words.items():
        own = [(-m, x) for x, m in words.items() if near(w, x)]
        best = min(own, default=(0, None))
        forms[w] = (best[1], -best[0], len(own)) if -best[0] >= 2 * n else (None, None, len(own))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, forms[w][0], root, n, forms[w][2], forms[w][1]))
    return collections.Counter(out)


def some_words(seed, n):
    rng = random.Random(seed)
    words = {}
    base = ["".join(rng.choices("abé", k=rng.randint(2, 9))) for _ in range(n)] + ["x" * 200, "ab" * 64 + "c", "y" * 65]
    for w in base:
        words[w] = rng.randint(1, 40)
        for _ in range(3):
            k = rng.randrange(len(w))
            other = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("abéz") + w[k:], w[:k] + rng.choice("abéz") + w[k + 1 :]))
            if len(other) > 1:
                words[other] = rng.choice((1, 1, 2, 80))
    return words


@pytest.mark.parametrize("owners", [20_000, 7])
def test_variants(spark, owners):
    words = some_words(owners, 120)
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({c: F.lit(1) for c in ("key", "side", "form", "a.b")})
    assert collections.Counter(map(tuple, sv.variants(df, owners=owners).collect())) == plain_variants(words)


def test_chain_of_forms(spark):
    """Each word's form is the next one, for 20 words."""
    words = {"q" * (2 + k): 2**k for k in range(20)}
    found = {r["word"]: r["root"] for r in sv.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(found.values()) == {"q" * 21} and found == {r[0]: r[2] for r in plain_variants(words)}


@pytest.mark.parametrize("every", [97, 2, None])
def test_word_counts(spark, documents, every):
    extra = [(900 + k, t, None, None, 0) for k, t in enumerate(["NAÏVE naïve Naïve nAÏve", "straße STRASSE ÿÿÿÿÿ×÷×÷×", "a1bcdef_ghijk", "w" * 300_000 + " é" * 5])] * 4
    docs = documents.unionByName(spark.createDataFrame(extra, documents.schema)).withColumns({c: F.lit("x") for c in ("word", "n", "doc")})
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {r["word"]: r["n"] for r in sv.word_counts(docs, every).collect()}
    assert found == plain_counts(rows, every) and any(len(w) >= 299_999 for w in found)


def test_whole_query(spark, documents, table_dir):
    folder = table_dir(documents=documents)
    want = plain_variants(plain_counts([(r["doc_id"], r["text"]) for r in documents.collect()]))
    assert collections.Counter(map(tuple, sv.op11_spelling_variants(spark, folder).collect())) == want and sum(want.values()) > 20


def test_nothing(spark, table_dir):
    found = sv.op11_spelling_variants(spark, table_dir(documents=empty(spark)))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"] and found.isEmpty()


def test_one_edit():
    words = list(some_words(5, 60))
    assert all(sv.one_edit(a, b) == near(a, b) for a in words for b in words if max(len(a), len(b)) < 90)
