"""Removal of repeated passages, with a count-min prefilter over merged partition sketches.

A window is ``size`` consecutive words. Its anchor is the smallest of the
hashes of the ``GRAM`` consecutive words within it, so equal windows have equal
anchors, at different places. In the first pass every chunk of texts counts its
anchors in a count-min sketch of its own, whose cells are sent, dealt by cell
range, and not the anchors. Each range adds up the sketches of all chunks and
answers them with the merged counts of their cells. The least of an anchor's
cells is never below the number of times that any of its windows starts, so the
merged sketch overestimates window counts, and a window whose estimate is one is
unique for certain.

The second pass sends on only windows with an estimate of two or more. They are
dealt by their own hashes, each distinct one once for each chunk, and counted
exactly; an answer comes back to the chunk. So neither an anchor that stands in
many texts nor a passage that a third of them share gathers anywhere: it costs
one entry of a few bytes for each chunk. The sketch grows with the input, and
nothing of it is broadcast.

Windows are told by 128 bits, two keyed hashes of their words' 64-bit hashes.

Defined results: null and empty texts have no words and keep the empty text;
a text of fewer words than a window is kept whole; rows repeated with the same
id are two texts that equal each other; whole texts are read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import ragged
from .common import table, text_or_empty, written
from .dealt import CountMin, answers, chunked, column, distinct, each, text_bytes, with_answers
from .words import TOP, Words, grams, mixed, sliding, words_of
from .workers import released

SIZE = 35
GRAM = 8
#: What the second hash of a window begins with.
_SECOND = np.uint64(0x2545F4914F6CDD1D)
#: Bytes of text for each anchor and for each window that may be repeated, about.
ANCHOR_BYTES, WINDOW_BYTES = 80, 12


def anchors(words: Words, size: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts: each window's anchor, whether a window starts there, and the anchors of all places that are some window's smallest."""
    counts = words.after - words.first
    left = np.repeat(words.after, counts) - np.arange(len(words.hashes))
    if len(words.hashes) < size:
        return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.uint64)
    g = grams(words.hashes, gram)
    g = np.where(left[: len(g)] >= gram, np.minimum(g, TOP - np.uint64(1)), TOP)
    span = size - gram + 1
    least = sliding(g, span, np.minimum)
    starts = left[: len(least)] >= size
    least = np.where(starts, least, np.uint64(0))
    none = np.zeros(span - 1, np.uint64)
    most = sliding(np.concatenate((none, least, none)), span, np.maximum)
    return least, starts, g[(most == g) & (g != TOP)]


def _words(rows: pa.Table) -> Words:
    """Words of all texts of a chunk."""
    return next((w for _, _, w in words_of(column(rows, "text"), most=1 << 60)), Words(*[np.empty(0, np.int64)] * 6))


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, back = distinct(values)
    return own, np.minimum(np.bincount(back, minlength=len(own)), 255)


def _repeatable(words: Words, merged: np.ndarray, sketch: CountMin, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows whose anchors are estimated to stand at two places or more. merged: the counts of the chunk's cells."""
    least, starts, places = anchors(words, size, gram)
    at = np.flatnonzero(starts)
    if not len(at):
        return at, np.empty((0, 2), np.uint64)
    keys = np.unique(places)
    at = at[sketch.estimates(keys, merged)[np.searchsorted(keys, least[at])] > 1]
    return at, np.stack([grams(h, size)[at] for h in (words.hashes, mixed(words.hashes ^ _SECOND, 1))], 1)


def _kept(words: Words, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Kept words of each text, joined by blanks, and their numbers."""
    lens = (words.ends - words.starts)[keep] + 1
    data = np.append(words.data, np.uint8(32))[ragged(words.starts[keep], lens)]
    ends = np.cumsum(lens)
    data[ends - 1] = 32
    total = np.concatenate(([0], np.cumsum(keep)))
    first, after = total[words.first], total[words.after]
    bounds = np.concatenate(([0], ends))
    begin, end = bounds[first], np.maximum(bounds[first], bounds[after] - 1)  # without the last blank
    sizes = end - begin
    flat = data[ragged(begin, sizes)]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).cast(pa.string()), after - first


def remove_repeats(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM) -> DataFrame:
    """doc_id, kept_text (the kept words, joined by blanks), n_words and n_removed of each row of docs."""
    if not 1 <= gram <= size:
        raise ValueError("an anchor is no longer than a window")
    own = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    n_bytes = text_bytes(own, "text")
    chunks = chunked(own, "text", n_bytes, "texts")

    n_anchors = n_bytes // ANCHOR_BYTES
    sketch = CountMin.sized(n_anchors)

    def cells(rows: pa.Table, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return sketch.sketch(*_counted(anchors(_words(rows), size, gram)[2]))

    def windows(rows: pa.Table, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return _counted(_repeatable(_words(rows), known[0], sketch, size, gram)[1])

    estimates = written(answers(chunks, cells, 2 * n_anchors, "estimates"), "estimates")
    estimated = with_answers(chunks, estimates)
    repeats = answers(estimated, windows, n_bytes // WINDOW_BYTES, "repeats", pairs=True)

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, (merged, repeats) in each(batches):
            words = _words(rows)
            at, found = _repeatable(words, merged, sketch, size, gram)
            at = at[repeats[distinct(found)[1]] > 1]
            edge = np.zeros(len(words.hashes) + 1, np.int64)
            edge[at] += 1
            np.subtract.at(edge, at + size, 1)
            kept, n_kept = _kept(words, np.cumsum(edge[:-1]) == 0)
            n_words = words.after - words.first
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), kept, pa.array(n_words), pa.array(n_words - n_kept)], ["doc_id", "kept_text", "n_words", "n_removed"])

    schema = T.StructType([own.schema["doc_id"], *[T.StructField(c, k) for c, k in (("kept_text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType()))]])
    return with_answers(estimated, repeats).mapInArrow(cut, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
