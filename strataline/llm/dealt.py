"""Counts of keys over all texts, dealt by hash range.

Rows are first laid into chunks, which are written once, bucketed by chunk, so
that what is found out about a chunk is joined to it without moving it again.
Every chunk sends its distinct keys, with the number of times that it has them,
to the tasks of their ranges: one row for each chunk and range. A range's task
adds up what all chunks have and answers each of them by one byte for each of
its keys, the number of binary digits of the count. So nothing is broadcast or
sent to the driver, ranges grow in number with the keys, and a key that is
everywhere costs a few bytes a chunk.

Keys are 64 bits, of which 32 beyond the range's own are told apart, so counts
are never less than the true ones; or pairs of 64 bits, which are told apart
whole. ``CountMin`` makes a chunk's keys into the chunk's own count-min sketch,
whose cells are what is sent then: ranges of cells add up the sketches of all
chunks, and what a chunk gets back are the merged counts of its cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, written_in_buckets
from .words import mixed
from .workers import released

#: Bytes of text in a chunk: so many at least, and more with the input, but no more than fits a worker.
CHUNK, MOST_CHUNK, CHUNKS = 1_000_000, 32_000_000, 20_000
#: Bytes of text in a bucket of chunks.
BUCKET = 24_000_000
#: Rows of a count-min sketch, bits that tell them apart, and cells of a row for each key.
ROWS, _ROW_BITS, CELLS_A_KEY = 2, 1, 4
_ROW_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

#: Of a chunk, and of what is known about it by now: its distinct keys in order (for pairs, of their first halves), and how often it has each (255: as often or more).
Keys = Callable[[pa.Table, list[np.ndarray]], tuple[np.ndarray, np.ndarray]]


def chunked(df: DataFrame, weight: str, n_bytes: int, name: str) -> DataFrame:
    """chunk and payload: the rows of df in chunks of about the same bytes in column weight; written."""
    spark = bounded(df.sparkSession)
    most = min(MOST_CHUNK, max(CHUNK, n_bytes // CHUNKS))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "payload"])

        for batch in batches:
            lens = pc.fill_null(pc.binary_length(batch.column(weight)), 0).to_numpy(zero_copy_only=False)
            total = np.cumsum(lens)
            a = 0
            while a < batch.num_rows:
                before = total[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(total, before + most - size, side="right")))
                held.append(batch.slice(a, b - a))
                size += int(total[b - 1] - before)
                a = b
                if size >= most or a < batch.num_rows:
                    yield chunk()
                    number, size = number + 1, 0
                    held.clear()
        if held:
            yield chunk()

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / BUCKET))
    return written_in_buckets(df.mapInArrow(run, "chunk long, payload binary"), "chunk", buckets, name)


def opened(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_all().combine_chunks()


def column(rows: pa.Table, name: str) -> pa.Array:
    """A column of a chunk in one piece."""
    chunks = rows.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], rows.schema.field(name).type)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, list[np.ndarray]]]:
    """Chunk, its rows and the answers that were joined to it, of rows (chunk, payload, answers ..)."""
    for batch in batches:
        for chunk, payload, *answers in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
            replies = [np.frombuffer(b"".join(x["reply"] for x in a.as_py() or ()), np.uint8) for a in answers]
            yield chunk.as_py(), opened(payload.as_py()), replies


def range_bits(n_keys: int) -> int:
    """So many ranges that both a range's keys and a chunk's share of a range grow with the input."""
    return max(0, math.ceil(0.6 * math.log2(max(1, n_keys))) - 7)


class CountMin(NamedTuple):
    """A count-min sketch of ROWS rows with 2 ** bits cells each. Every chunk has one of its own, of which only the cells that aren't zero are kept."""

    bits: int

    @classmethod
    def sized(cls, n_keys: int) -> CountMin:
        return cls(max(8, math.ceil(math.log2(max(1, CELLS_A_KEY * n_keys)))))

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        """The cell of each key, as the first bits of a number that begins with the row."""
        cell = mixed(keys ^ _ROW_SEEDS[row], row & 1) >> np.uint64(64 - self.bits)
        return (np.uint64(row) << np.uint64(64 - _ROW_BITS)) | (cell << np.uint64(64 - _ROW_BITS - self.bits))

    def sketch(self, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's sketch of its keys: its cells in order, and their counts."""
        found = [np.unique(self.cells(keys, row), return_inverse=True) for row in range(ROWS)]
        sums = [np.bincount(back, counts, len(cells)) for cells, back in found]
        return np.concatenate([cells for cells, _ in found]), np.minimum(np.concatenate(sums), 255)

    def estimates(self, keys: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Of keys that a chunk's sketch was made of, by the merged counts of its cells: the least of each key's cells, never below its count."""
        out, begin = None, 0
        for row in range(ROWS):
            cells, back = np.unique(self.cells(keys, row), return_inverse=True)
            own = merged[begin : begin + len(cells)][back]
            begin += len(cells)
            out = own if out is None else np.minimum(out, own)
        return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    _, back = distinct(keys)
    return np.bincount(back, counts)[back]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the place of each key among them. keys: numbers, or rows of two."""
    if keys.ndim == 1:
        return np.unique(keys, return_inverse=True)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ordered = keys[order]
    new = np.append(True, (ordered[1:] != ordered[:-1]).any(1))[: len(keys)]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], back


def digits(counts: np.ndarray) -> np.ndarray:
    """Binary digits of counts: 1 for once, 2 for two or three times, and so on."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def answers(chunks: DataFrame, keys: Keys, n_keys: int, name: str, pairs: bool = False) -> DataFrame:
    """c2 (a chunk) and, under a name, the answers to its keys. chunks: chunk, payload and earlier answers; n_keys: about how many are sent; pairs: keys are rows of two numbers."""
    bits = range_bits(n_keys)
    kind = np.dtype((np.uint64, 2)) if pairs else np.dtype(np.uint32)

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows, known in each(batches):
            own, counts = keys(rows, known)
            if not len(own):
                continue
            first = own[:, 0] if pairs else own
            top = (first >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
            rest = own if pairs else ((own << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            begins = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
            ends = np.append(begins[1:], len(top))
            counts = counts.astype(np.uint8)
            data = [rest[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(top[begins]), pa.array(np.full(len(begins), chunk)), pa.array(data, pa.binary())], ["range", "chunk", "data"])

    def count(rows: pa.Table) -> pa.Table:
        data = rows.column("data").to_pylist()
        sizes = np.array([len(d) // (kind.itemsize + 1) for d in data])
        own = np.concatenate([np.frombuffer(d, kind, n) for d, n in zip(data, sizes.tolist(), strict=True)])
        times = np.concatenate([np.frombuffer(d, np.uint8, n, n * kind.itemsize) for d, n in zip(data, sizes.tolist(), strict=True)])
        found = digits(_summed(own, times)).tobytes()
        ends = np.cumsum(sizes).tolist()
        replies = [found[b - n : b] for n, b in zip(sizes.tolist(), ends, strict=True)]
        return pa.table({"chunk": rows.column("chunk"), "range": rows.column("range"), "reply": pa.array(replies, pa.binary())})

    sent = chunks.mapInArrow(send, "range long, chunk long, data binary")
    replies = sent.groupBy("range").applyInArrow(count, "chunk long, range long, reply binary")
    return replies.groupBy(F.col("chunk").alias("c2")).agg(F.sort_array(F.collect_list(F.struct("range", "reply"))).alias(name))


def with_answers(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """chunks with replies, joined where the chunks are."""
    return chunks.join(replies, F.col("chunk") == F.col("c2"), "left").drop("c2")


def text_bytes(df: DataFrame, text: str) -> int:
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)
