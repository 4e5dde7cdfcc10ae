"""The byte network: gradients, windows, defined results and held-out accuracy."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataline.llm import language_net as ln

from .test_text_operators import empty


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = ln.ByteNet(3)
    for name in ("embed", "filters", "bias", "weights", "shift"):
        setattr(net, name, getattr(net, name).astype(np.float64) + (rng.standard_normal(getattr(net, name).shape) * 0.1 if name in ("bias", "shift") else 0))
    windows = rng.integers(97, 110, (5, 40)).astype(np.uint8)
    windows[2, 20:] = 0
    labels = np.array([0, 1, 2, 1, 0])

    def loss():
        return -np.log(net.probabilities(windows)[np.arange(5), labels]).mean()

    for p, g in zip(net.parameters(), net.gradients(windows, labels), strict=True):
        for at in [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g), axis=None)[:6]]:
            kept = p[at]
            p[at] = kept + 1e-6
            up = loss()
            p[at] = kept - 1e-6
            down = loss()
            p[at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4 * max(1, abs(g[at]))


@pytest.mark.parametrize("piece", [1 << 20, 600])
def test_windows_cover_whole_texts(monkeypatch, piece):
    monkeypatch.setattr(ln, "PIECE", piece)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, ln.STRIDE, ln.WINDOW, ln.WINDOW + 1, 5000, 0, 3)]
    bounds = np.cumsum([0, *map(len, texts)])
    wide = max(ln.WIDTHS)
    grams = [set() for _ in texts]
    for windows, who, sizes in ln.windows_of(np.frombuffer(b"".join(texts), np.uint8), bounds):
        for w, k, size in zip(windows, who, sizes, strict=True):
            data = bytes(w[:size])
            assert not w[size:].any() and data in texts[k]
            grams[k].update(data[j : j + wide] for j in range(max(0, size - wide + 1)))
    assert grams == [{t[j : j + wide] for j in range(max(0, len(t) - wide + 1))} for t in texts]


def test_plain_forward_pass():
    """Windows at once against one filter at one place at a time."""
    rng = np.random.default_rng(5)
    net = ln.ByteNet(4)
    windows = rng.integers(0, 256, (3, 30)).astype(np.uint8)
    for w, got in zip(windows, net.probabilities(windows), strict=True):
        padded = [*w.tolist(), 0, 0, 0]
        hidden = []
        for f in range(net.filters.shape[1]):
            width = ln.WIDTHS[f // ln.FILTERS]
            best = max(sum(float(net.embed[padded[p + j]] @ net.filters[j * ln.EMBED : (j + 1) * ln.EMBED, f]) for j in range(width)) for p in range(30))
            hidden.append(max(0.0, best + float(net.bias[f])))
        x = np.exp(np.array(hidden) @ net.weights + net.shift)
        assert np.allclose(got, x / x.sum(), atol=1e-4)


def test_whole_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = ln.op13_language_net(spark, folder).collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(list(truth))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in held]) > 0.97


def test_defined_results(spark, documents):
    docs = documents.withColumns({c: F.lit("x") for c in ("label", "window", "place", "id", "a.b", "lang_pred")})
    model = ln.learn(docs, epochs=1)
    assert model.languages == ["de", "en"]
    found = collections.Counter(map(tuple, ln.predict_language(docs.select("doc_id", "text"), model, keep=("doc_id", "text")).collect()))
    assert sum(found.values()) == docs.count()
    for _, text, lang, score in found:
        assert (lang, score) == ("und", 0.0) if not any(map(str.isalpha, text or "")) else lang in ("de", "en") and 0 < score <= 1
    assert {lang for _, text, lang, _ in found if text is None or text.startswith("😀")} == {"und"}
    odd = pa.array(["١٢٣", "中文", "?!", None, "é", "", "²"])
    assert [x == "und" for x in model.predict(odd)[0]] == [True, False, True, True, False, True, True]


def test_nothing_labelled(spark, documents, table_dir):
    assert ln.op13_language_net(spark, table_dir(documents=empty(spark))).isEmpty()
    none = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in ln.predict_language(none, ln.learn(none)).collect()} == {("und", 0.0)}


def test_labels_outside_the_sample_are_not_read(spark, documents):
    """The model is the same whatever held-out rows say."""
    other = documents.withColumn("lang", F.when(ln.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = ln.learn(documents, epochs=1), ln.learn(other, epochs=1)
    assert a.languages == b.languages and all(np.array_equal(x, y) for x, y in zip(a.net.parameters(), b.net.parameters(), strict=True))
