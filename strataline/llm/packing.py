"""Harmonic packing of tokenized documents into sequences.

A document is first cut into whole sequences; what is left, its rest, is shorter
than the capacity C. Rests are dealt to reciprocal classes by their length: class
k takes lengths above C / (k + 1) up to C / k, for k up to CLASSES, and beyond
that k is a power of two. A sequence of class k takes exactly k rests, which
always fit. Where they leave a gap of more than C / GAP tokens, it is topped up
from one waiting rest, which is cut for it; smaller gaps are padding. So padding
is below 1 / GAP of any sequence, and about one document a sequence is cut
beyond its whole sequences.

Each task fills its own classes from the rows it reads: there is no shuffle, and
a task keeps fewer than k rests of class k. Those left at its end are laid one
after the other and cut at whole sequences, and the last of that by powers of
two: such sequences need no padding.

Defined results: a null text is empty, so its document is just the end id; a
null doc_id is kept; repeated rows are packed each by itself; an empty table
gives no rows; columns but doc_id and text are left out. Sequence ids are the
task's number and a count within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import UnicodeTables, chunks, engine, unicode_tables
from .common import bounded, table
from .token_counts import tokenizer_path
from .workers import released

_FLUSH = 4096


#: Classes up to here are all reciprocals; beyond, only powers of two.
CLASSES = 32
#: Gaps of this part of the capacity, or less, stay padding.
GAP = 128


class Piece(NamedTuple):
    """Tokens of a document from start on."""

    doc: object
    start: int
    ids: np.ndarray
    total: int  # tokens of the document

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])


#: A piece with its sequence and its place there.
Placed = tuple[Piece, int, int]


class HarmonicBins:
    """Waiting rests by class, and the one that gaps are topped up from. All methods give the pieces of sequences that are complete."""

    def __init__(self, capacity: int, first_id: int, classes: int = CLASSES, gap: int = GAP):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("the capacity is a power of two")
        self.capacity, self.next_id, self.classes, self.least_gap = capacity, first_id, classes, capacity // gap
        self.waiting: dict[int, list[Piece]] = {}
        self.filler: Piece | None = None
        self.short: list[Piece] = []  # a sequence whose gap nothing was there to fill

    def class_of(self, length: int) -> int:
        k = self.capacity // length
        return k if k <= self.classes else 1 << (k.bit_length() - 1)

    def document(self, doc: object, ids: np.ndarray) -> Iterator[Placed]:
        whole = len(ids) // self.capacity * self.capacity
        for a in range(0, whole, self.capacity):
            yield from self._close([Piece(doc, a, ids[a : a + self.capacity], len(ids))])
        if whole < len(ids):
            yield from self.rest(Piece(doc, whole, ids[whole:].copy(), len(ids)))

    def rest(self, piece: Piece) -> list[Placed]:
        if self.short:
            self.filler, own = piece, self.short
            self.short = []
            return self._top_up(own)
        k = self.class_of(len(piece.ids))
        own = self.waiting.setdefault(k, [])
        own.append(piece)
        return self._top_up(self.waiting.pop(k)) if len(own) == k else []

    def _top_up(self, own: list[Piece]) -> list[Placed]:
        gap = self.capacity - sum(len(p.ids) for p in own)
        while gap > self.least_gap:
            if self.filler is None:
                if not self.waiting:
                    self.short = own
                    return []
                k = min(self.waiting)
                self.filler = self.waiting[k].pop()
                if not self.waiting[k]:
                    del self.waiting[k]
            part, left = self.filler.cut(gap)
            self.filler = left if len(left.ids) else None
            own.append(part)
            gap -= len(part.ids)
        return self._close(own)

    def last(self) -> Iterator[Placed]:
        """All that still waits, in full sequences and powers of two."""
        todo = [*self.short, *([self.filler] if self.filler else []), *[p for k in sorted(self.waiting) for p in self.waiting[k]]]
        self.waiting, self.filler, self.short = {}, None, []
        left = sum(len(p.ids) for p in todo)
        todo.reverse()
        while left:
            size = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= size
            own: list[Piece] = []
            while size:
                part, rest = todo.pop().cut(size)
                if len(rest.ids):
                    todo.append(rest)
                own.append(part)
                size -= len(part.ids)
            yield from self._close(own)

    def _close(self, own: list[Piece]) -> list[Placed]:
        at, out = 0, []
        for piece in own:
            out.append((piece, self.next_id, at))
            at += len(piece.ids)
        self.next_id += 1
        return out


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless left out, its ids."""
    long = T.LongType()
    fields = [T.StructField("doc_id", df.schema[doc_id].dataType)] + [T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    tables = df.sparkSession.sparkContext.broadcast(tuple(unicode_tables()))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(path, True, UnicodeTables(*tables.value))
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        done: list[Placed] = []
        kind = None

        def flush() -> pa.RecordBatch:
            pieces = [p for p, _, _ in done]
            numbers = ([p.start for p in pieces], [len(p.ids) for p in pieces], [zlib.crc32(p.ids) for p in pieces], [p.total for p in pieces], [s for _, s, _ in done], [at for _, _, at in done])
            columns = [pa.array([p.doc for p in pieces], kind), *[pa.array(x, pa.int64()) for x in numbers]]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(numbers[1]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p.ids for p in pieces]).astype(np.int32))))
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

        for batch in batches:
            kind = batch.column(1).type
            texts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, counts = bpe.encode(texts[a:b], end_id)
                at = 0
                for key, total in zip(keys[a:b], counts.tolist(), strict=True):
                    done += bins.document(key, ids[at : at + total])
                    at += total
                    if len(done) >= _FLUSH:
                        yield flush()
        done += bins.last()
        if done:
            yield flush()

    return df.select(F.col(text).alias("__text"), F.col(doc_id).alias("__id")).mapInArrow(run, T.StructType(fields))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the corpus, with their ids."""
    bounded(spark)
    return pack(docs, tokenizer_path())
