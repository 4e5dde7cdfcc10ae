"""Language of whole texts by a convolutional network over bytes.

A window of bytes goes through an embedding, filters of several widths, the
maximum of each filter over the window, and a softmax. The network is trained in
numpy, by one task, on windows of a bounded sample: at most MAX_LABELLED rows
outside the held-out third, as many of each language as there are, but no more
than its even share, chosen by a hash of their ids. It is applied on the
executors to all windows of every text; they overlap by the widest filter less
one byte, so that no run of bytes is missed. A text's probabilities are the mean
of those of its windows, by their bytes.

Only texts and languages are learned from; neither language, source nor id is an
input of a prediction. Defined results: texts that are null or have no letter
are ``und`` with score 0, and so is everything if nothing is labelled; rows
without an id are not held out and not learned from; rows that are there twice
are learned from twice. An empty table gives an empty result. Only the columns
named are read, so others may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .workers import released

#: Labelled rows that are learned from, and windows of each. Languages that are learned: the commonest so many.
MAX_LABELLED, WINDOWS_A_ROW = 8_000, 2
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: Bytes of a window; widths of filters, filters of each width, size of the embedding.
WINDOW = 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
#: Windows that go through the network at once.
AT_ONCE = 32
EPOCHS, STEP, BATCH = 6, 0.01, 64
#: Of a text that is cut into windows, the bytes from one window to the next.
STRIDE = WINDOW - max(WIDTHS) + 1
#: Bytes of a batch that are windows at a time.
PIECE = 1 << 20
#: Capitals A-Z count as their small letters.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class ByteNet:
    """Embedding [256, e], filters [widest * e, f] with zeros beyond a filter's width, their bias [f], and the softmax's weights [f, c] and bias [c]. Byte 0 fills windows up and is nothing."""

    def __init__(self, classes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n, wide = FILTERS * len(WIDTHS), max(WIDTHS)
        self.used = np.zeros((wide * EMBED, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.used[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.embed = draw(256, EMBED, scale=0.5)
        self.embed[0] = 0
        self.filters = draw(wide * EMBED, n, scale=0.3) * self.used
        self.bias = np.zeros(n, np.float32)
        self.weights = draw(n, classes, scale=0.1)
        self.shift = np.zeros(classes, np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """[windows, places, widest * e]: the embedded bytes that filters see at each place."""
        wide = max(WIDTHS)
        padded = np.zeros((len(windows), windows.shape[1] + wide - 1), np.uint8)
        padded[:, : windows.shape[1]] = windows
        x = self.embed[padded]
        n, length, _ = x.shape
        places = np.lib.stride_tricks.as_strided(x, (n, length - wide + 1, wide * EMBED), x.strides)
        return places

    def _pooled(self, places: np.ndarray) -> np.ndarray:
        n, length, size = places.shape
        return (np.ascontiguousarray(places).reshape(-1, size) @ self.filters).reshape(n, length, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """[windows, classes] of windows [windows, bytes]."""
        out = []
        for a in range(0, len(windows), AT_ONCE):
            top = self._pooled(self._columns(windows[a : a + AT_ONCE])).max(1)
            out.append(_softmax(np.maximum(top + self.bias, 0) @ self.weights + self.shift))
        return np.concatenate(out) if out else np.empty((0, len(self.shift)), np.float32)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of parameters()."""
        n, wide = len(windows), max(WIDTHS)
        places = self._columns(windows)
        seen = self._pooled(places)
        at = seen.argmax(1)
        hidden = np.maximum(np.take_along_axis(seen, at[:, None], 1)[:, 0] + self.bias, 0)
        error = _softmax(hidden @ self.weights + self.shift)
        error[np.arange(n), labels] -= 1
        error /= n
        back = (error @ self.weights.T) * (hidden > 0)  # reaches a filter's best place only
        best = places[np.arange(n)[:, None], at]  # [n, f, widest * e]
        filters = np.einsum("nf,nfk->kf", back, best) * self.used
        into = (back[:, :, None] * self.filters.T[None]).reshape(n, -1, wide, EMBED)
        padded = np.zeros((n, windows.shape[1] + wide - 1), np.uint8)
        padded[:, : windows.shape[1]] = windows
        letters = padded[np.arange(n)[:, None, None], at[:, :, None] + np.arange(wide)]
        embed = np.zeros_like(self.embed)
        np.add.at(embed, letters.ravel(), into.reshape(-1, EMBED))
        embed[0] = 0
        return [embed, filters, back.sum(0), hidden.T @ error, error.sum(0)]

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weights, self.shift]

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> ByteNet:
        """Adam over shuffled batches, steps getting smaller to the end. A third of the windows is cut short each time, so that short texts are known too."""
        rng = np.random.default_rng(seed)
        own = self.parameters()
        first, second = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        steps = max(1, epochs * -(-len(windows) // BATCH))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), BATCH):
                some = order[a : a + BATCH]
                shown = windows[some].copy()
                for k in np.flatnonzero(rng.random(len(some)) < 1 / 3):
                    shown[k, rng.integers(12, WINDOW) :] = 0
                rate = STEP * (1 - t / steps)
                t += 1
                for p, g, m, v in zip(own, self.gradients(shown, labels[some]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def windows_of(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of texts data[bounds[k]:bounds[k + 1]], some at a time: [windows, WINDOW] filled up with 0, each one's text, and its bytes."""
    lens = np.diff(bounds)
    counts = np.maximum(1, -(-(lens - (WINDOW - STRIDE)) // STRIDE))
    who = np.repeat(np.arange(len(lens)), counts)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = bounds[:-1][who] + nth * STRIDE
    sizes = np.minimum(WINDOW, bounds[1:][who] - starts)
    padded = np.concatenate((_FOLD[data[: bounds[-1]]], np.zeros(WINDOW, np.uint8)))
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    most = max(1, PIECE // WINDOW)
    for a in range(0, len(who), most):
        own, size = views[starts[a : a + most]], sizes[a : a + most]
        short = np.flatnonzero(size < WINDOW)
        own[short] *= np.arange(WINDOW) < size[short, None]
        yield own, who[a : a + most], size


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; null has none."""
    out = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False).copy()
    for k in np.flatnonzero(~out):
        out[k] = any(map(str.isalpha, texts[int(k)].as_py() or ""))
    return out


class LanguageModel:
    """Languages and the network that tells them; no network without languages."""

    def __init__(self, languages: list[str], net: ByteNet | None):
        self.languages, self.net = languages, net

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        known = has_letter(texts) & (self.net is not None)
        scores = np.zeros(len(texts))
        best = np.zeros(len(texts), np.int64)
        at = np.flatnonzero(known)
        if len(at):
            large = texts.take(pa.array(at)).cast(pa.large_binary())
            _, offsets, data = large.buffers()
            bounds = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
            sums = np.zeros((len(at), len(self.languages)))
            for windows, who, sizes in windows_of(np.frombuffer(data, np.uint8), bounds):
                np.add.at(sums, who, self.net.probabilities(windows) * sizes[:, None])
            best[at] = sums.argmax(1)
            scores[at] = np.minimum(1.0, sums.max(1) / sums.sum(1))
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], scores


def training_windows(rows: DataFrame, languages: list[str], shares: list[float]) -> DataFrame:
    """label, place and window (up to WINDOW bytes): some windows of a share of each language's rows (id, text, lang)."""
    number = {lang: k for k, lang in enumerate(languages)}

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(has_letter(batch.column(0)))
            out: list[tuple[int, int, bytes]] = []
            for k in keep.tolist():
                data, label = batch.column(0)[k].as_py().encode(), number[batch.column(1)[k].as_py()]
                h = crc32(data)
                starts = {(h * (2 * j + 1)) % max(1, len(data) - WINDOW + 1) for j in range(WINDOWS_A_ROW)}
                out += [(label, h, data[s : s + WINDOW]) for s in sorted(starts)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["label", "place", "window"])

    least = F.lit(None).cast("double")
    for lang, share in zip(languages, shares, strict=True):
        least = F.when(F.col("lang") == lang, F.lit(share * 1_000_000)).otherwise(least)
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < least)
    return some.select("text", "lang").mapInArrow(run, "label int, place long, window binary")


def learn(docs: DataFrame, most: int = MAX_LABELLED, epochs: int = EPOCHS) -> LanguageModel:
    """A model from docs (doc_id, text, lang), less the held-out rows."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("doc_id").alias("id"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return LanguageModel([], None)
    languages = sorted(r["lang"] for r in sizes)
    n = {r["lang"]: r["n"] for r in sizes}
    sample = training_windows(rows, languages, [min(1.0, most / len(languages) / n[lang]) for lang in languages])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((x["place"], x["window"], x["label"]) for b in batches for x in b.to_pylist())
        windows = np.zeros((len(held), WINDOW), np.uint8)
        for k, (_, window, _) in enumerate(held):
            windows[k, : len(window)] = _FOLD[np.frombuffer(window, np.uint8)]
        net = ByteNet(len(languages)).fit(windows, np.array([x[2] for x in held], np.int64), epochs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.parameters())], pa.binary())], ["net"])

    net = ByteNet(len(languages))
    net.embed, net.filters, net.bias, net.weights, net.shift = pickle.loads(sample.repartition(1).mapInArrow(train, "net binary").first()["net"])
    return LanguageModel(languages, net)


def predict_language(df: DataFrame, model: LanguageModel, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Columns ``keep`` of df with lang_pred and score of each row's text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = model.predict(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(languages, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    listed = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, f"{listed}lang_pred string, score double")


def op13_language_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict_language(docs, learn(docs), keep=("doc_id",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
