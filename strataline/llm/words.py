"""Words of whole texts as arrays of 64-bit hashes, straight from Arrow's bytes.

A word is a run of bytes other than blank and the ASCII controls 9 to 13, which
are never part of a longer UTF-8 character. Hashes are keyed and taken block by
block, with a bijective mixing between blocks: different words of up to 8 bytes
and equal length never share one, and no structure of longer words (repeats,
regular sequences of two letters) cancels out, as it does in polynomials modulo
2 ** 64. Runs of words are hashed in the same manner, by doubling. Two hashes
that meet agree by chance once in 2 ** 64; what that means for a result is said
where they are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_SEED, _STEP = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_32, _29 = np.uint64(32), np.uint64(29)
TOP = np.uint64(2**64 - 1)
#: The first so many bytes of a block that belong to a run.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer runs are hashed one by one.
LONG = 256


def mixed(h: np.ndarray, which: int = 0) -> np.ndarray:
    """A bijection of 64 bits."""
    h = h ^ (h >> _32)
    h *= _MUL[which]
    h ^= h >> _29
    h *= _MUL[which]
    h ^= h >> _32
    return h


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs data[start:end] of bytes."""
    lens = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    blocks = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
    h = mixed(lens.astype(np.uint64) * _STEP + _SEED)
    who, at, left = np.arange(len(lens)), starts, lens
    if (lens > LONG).any():
        for k in np.flatnonzero(lens > LONG).tolist():
            digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=b"runs").digest()
            h[k] ^= np.uint64(int.from_bytes(digest, "little"))
        who = np.flatnonzero(lens <= LONG)
        at, left = starts[who], lens[who]
    whole = len(who) == len(h)
    while len(who):
        own = blocks[at] & _FIRST[np.minimum(left, 8)]
        if whole:
            h = mixed(h ^ own)
        else:
            h[who] = mixed(h[who] ^ own)
        more = left > 8
        if more.all():
            at, left = at + 8, left - 8
        else:
            who, at, left, whole = who[more], at[more] + 8, left[more] - 8, False
    return h


class Words(NamedTuple):
    """Words of consecutive texts: their hashes, byte ranges in data, and each text's first word and the one after its last."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    first: np.ndarray
    after: np.ndarray


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and each one's bounds in them."""
    texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), bounds


def words_of(texts: pa.Array, lower: bool = False, most: int = 2_000_000) -> Iterator[tuple[int, int, Words]]:
    """Ranges of texts of about so many bytes, one text at least, with their words. lower: A-Z count as a-z."""
    data, bounds = _bytes(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + most, side="right")) - 1)
        yield begin, end, _words(data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin], lower)
        begin = end


def _words(data: np.ndarray, bounds: np.ndarray, lower: bool) -> Words:
    n = len(data)
    inside = ~_SEPARATES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = bounds[:-1][bounds[:-1] < n]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    closes = inside
    closes = closes.copy()
    closes[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    closes[last] = inside[last]
    ends = np.flatnonzero(closes) + 1
    hashes = run_hashes(_LOWER[data] if lower else data, starts, ends)
    return Words(hashes, starts, ends, data, np.searchsorted(starts, bounds[:-1]), np.searchsorted(starts, bounds[1:]))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on, as far as there are so many."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    power, have, out, done = hashes, 1, None, 0  # power: of 1, 2, 4 .. words
    while True:
        if size & have:
            rest = power[done : done + n - size + 1]
            out = mixed(rest + _SEED) if out is None else mixed(out * _STEP ^ rest)
            done += have
        if 2 * have > size:
            return out
        power = mixed(power[:-have] * _STEP ^ power[have:], 1)
        have *= 2


def sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each ``size`` neighbours, by doubling."""
    have, out = 1, values
    while 2 * have <= size:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(values) - size + 1], out[size - have :][: len(values) - size + 1]) if have < size else out
