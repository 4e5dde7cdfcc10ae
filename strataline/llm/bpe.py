"""Byte-pair encoding with word ends, rank-synchronous over ragged numpy arrays.

A batch of texts becomes one array of code points. Pre-tokens are the runs that
the vocabulary's pattern finds, taken from a table of character classes; equal
ones are told by a 64-bit hash and then compared by their characters. The
distinct new ones are laid out as one ragged array of byte symbols, and in each
round every sequence applies all occurrences of its own lowest-rank pair at the
same time. What survives are the tokens. This holds only for vocabularies in
which a pair never ranks before a merge that makes one of its parts; that, the
normalizer, the pattern and the special tokens are verified when the file is
read.

Classes, lower case and normal forms are those of the tokenizer library, whose
Unicode version isn't Python's: ``unicode_tables`` asks it once, on the driver.
Only texts with characters that can join others in a normal form, or whose lower
case isn't one character, go through the library's normalizer.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from .words import run_hashes

#: What follows an apostrophe that starts a run by itself.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_NONE = np.int32(2**31 - 1)
_CODES = 0x110000
#: Code points beyond are unassigned or private: no letters, numbers or spaces, and their own normal form.
_ASSIGNED = (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000))
#: The normalizer and the pre-tokenizer that the engine carries out.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "|".join("'" + c for c in CONTRACTIONS) + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class UnicodeTables(NamedTuple):
    """Of every code point: its class, its lower case, and whether a text that has it needs the library's normalizer."""

    kind: np.ndarray
    lower: np.ndarray
    special: np.ndarray


def unicode_tables() -> UnicodeTables:
    """The tables of the tokenizer library at hand, made once a process. For the driver; workers get them."""
    if "unicode" not in _kept():
        _kept()["unicode"] = _asked_tables()
    return _kept()["unicode"]


def _asked_tables() -> UnicodeTables:
    from tokenizers import Regex, normalizers, pre_tokenizers

    codes = [c for c in _ASSIGNED if c != 10]
    places = np.array(codes)
    chars = list(map(chr, codes))

    def each(normalizer) -> list[str]:
        return normalizer.normalize_str("\n".join(chars)).split("\n")

    def where(pattern: str) -> np.ndarray:
        out = np.zeros(_CODES, bool)
        text = "".join(chars)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[places[a:b]] = True
        return out

    kind = np.full(_CODES, _OTHER, np.uint8)
    for pattern, which in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        kind[where(pattern)] = which
    kind[10] = _SPACE
    lower, special = np.arange(_CODES, dtype=np.uint32), where(r"\p{M}+")
    for c, char, composed, apart, small in zip(codes, chars, each(normalizers.NFC()), each(normalizers.NFD()), each(normalizers.Lowercase()), strict=True):
        if composed != char or len(small) != 1:
            special[c] = True
        else:
            lower[c] = ord(small)
        special[list(map(ord, apart[1:]))] = True
    return UnicodeTables(kind, lower, special)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in kept)}
    return [chr(moved.get(b, b)) for b in range(256)]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, .. of all runs, one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


class Encoded(NamedTuple):
    """Tokens of consecutive texts: their ids, and how many each text has. ids is None if only counted."""

    ids: np.ndarray | None
    counts: np.ndarray


class WordBpe:
    """The vocabulary of one file, and a bounded memory of the pre-tokens seen so far."""

    def __init__(self, path: str, with_ids: bool, tables: UnicodeTables, max_known: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        verify(spec)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=lambda t: (-len(t), t))
        self.specials = re.compile("|".join(map(re.escape, longest_first))) if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        last_made = np.full(max(vocab.values()) + 1, -1)
        last_made[made] = np.arange(len(made))  # of several merges that make a symbol, the last
        if not (np.maximum(last_made[left], last_made[right]) < np.arange(len(made))).all():
            raise ValueError("a pair ranks before a merge that makes its part")
        self.size = int(max(vocab.values())) + 1
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        self.tables = tables
        self.with_ids, self.max_known = with_ids, max_known
        self.forget()

    def forget(self) -> None:
        """Entry k of the memory has the hash hashes[k], so many characters and tokens from these places on in chars and flat."""
        self.known = np.empty(0, np.uint64)  # hashes in order, and the entry of each
        self.entry = np.empty(0, np.int64)
        self.lens = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.char_lens = np.empty(0, np.int64)
        self.char_starts = np.empty(0, np.int64)
        self.chars = np.empty(0, np.uint32)
        self.flat = np.empty(0, np.uint16 if self.size <= 65536 else np.int32)
        self.odd: dict[bytes, int] = {}  # entries of pre-tokens whose hash another one has

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE)

    def merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of the sequences of so many symbols each (1 at least), and their numbers."""
        out_lens = lens.copy()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        who = np.arange(len(lens))
        n = len(sym)
        if n == 0:
            return sym, out_lens
        rank = np.full(n, _NONE, np.int32)
        rank[:-1] = self.pair_ranks(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = _NONE
        while len(lens):
            starts = np.cumsum(lens) - lens
            least = np.minimum.reduceat(rank, starts)
            live = least != _NONE
            if not live.all():
                over = ~live
                at = np.repeat(live, lens)
                done.append((who[over], sym[~at]))
                out_lens[who[over]] = lens[over]
                sym, rank, who, lens, least = sym[at], rank[at], who[live], lens[live], least[live]
                if not len(lens):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lens))
            if (near := np.flatnonzero(np.diff(hit) == 1)).size:  # a run of one symbol: every other pair of it
                run = np.arange(len(hit))
                first = np.ones(len(hit), bool)
                first[near + 1] = False
                run -= np.maximum.accumulate(np.where(first, run, 0))
                hit = hit[run % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            owner = np.searchsorted(np.cumsum(lens), hit, side="right")
            sym, rank = sym[keep], rank[keep]
            now = hit - np.arange(len(hit))
            lens = lens - np.bincount(owner, minlength=len(lens))
            finals = np.cumsum(lens) - 1
            around = np.concatenate((now, now[now > 0] - 1))
            around = around[around < len(sym) - 1]
            rank[around] = self.pair_ranks(sym[around], sym[around + 1])
            rank[finals] = _NONE
        flat = np.empty(int(out_lens.sum()), np.int64)
        begins = np.cumsum(out_lens) - out_lens
        for seqs, symbols in done:
            flat[ragged(begins[seqs], out_lens[seqs])] = symbols
        return flat, out_lens

    def _learn(self, cps: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Add pre-tokens of so many characters, one after the other in cps; their entries."""
        data = np.frombuffer(cps.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        wide = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
        byte_lens = np.add.reduceat(wide, np.cumsum(lens) - lens)
        sym = self.inner[data]
        last = np.cumsum(byte_lens) - 1
        sym[last] = self.final[data[last]]
        ids, counts = self.merge(sym, byte_lens)
        entries = len(self.lens) + np.arange(len(lens))
        self.char_starts = np.concatenate((self.char_starts, len(self.chars) + np.cumsum(lens) - lens))
        self.char_lens = np.concatenate((self.char_lens, lens))
        self.chars = np.concatenate((self.chars, cps))
        self.lens = np.concatenate((self.lens, counts.astype(np.int32)))
        if self.with_ids:
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
            self.flat = np.concatenate((self.flat, ids.astype(self.flat.dtype)))
        return entries

    def _pretokens(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each pre-token."""
        kind = self.tables.kind[chars]
        cut = np.empty(len(kind), bool)
        cut[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == _NUMBER
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(kind))
        what = kind[starts]
        quote = np.flatnonzero((what[:-1] == _OTHER) & (what[1:] == _LETTER) & (ends[:-1] - starts[:-1] == 1) & (chars[starts[:-1]] == 39))
        if quote.size:
            drop = []
            for q in quote.tolist():
                s, e = int(starts[q + 1]), int(ends[q + 1])
                word = "".join(map(chr, chars[s : min(e, s + 2)].tolist()))
                part = next((c for c in CONTRACTIONS if word.startswith(c)), None)
                if part:
                    ends[q] = s + len(part)
                    if s + len(part) == e:
                        drop.append(q + 1)
                    else:
                        starts[q + 1] = s + len(part)
            if drop:
                starts, ends, what = (np.delete(x, drop) for x in (starts, ends, what))
        words = what != _SPACE
        return starts[words], ends[words]

    def _entries(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of the pre-tokens in the memory; learns those that are new."""
        lens = ends - starts
        distinct, first, back = np.unique(run_hashes(chars.view(np.uint8), 4 * starts, 4 * ends), return_index=True, return_inverse=True)
        if len(self.lens) + len(distinct) > self.max_known:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            one = first[new]
            entries = self._learn(chars[ragged(starts[one], lens[one])], lens[one])
            places = np.searchsorted(self.known, distinct[new])
            self.known, self.entry = np.insert(self.known, places, distinct[new]), np.insert(self.entry, places, entries)
            at = np.searchsorted(self.known, distinct)
        out = self.entry[at][back]
        for k in self._unlike(chars, starts, lens, out).tolist():
            own = chars[starts[k] : ends[k]]
            if (key := own.tobytes()) not in self.odd:
                self.odd[key] = int(self._learn(own, lens[k : k + 1])[0])
            out[k] = self.odd[key]
        return out

    def _unlike(self, chars: np.ndarray, starts: np.ndarray, lens: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Places of pre-tokens whose characters aren't those of their entries."""
        unlike = self.char_lens[entries] != lens
        at = np.flatnonzero(~unlike)
        lens = lens[at]
        same = chars[ragged(starts[at], lens)] == self.chars[ragged(self.char_starts[entries[at]], lens)]
        if not same.all():
            unlike[at] = np.logical_not(np.logical_and.reduceat(same, np.cumsum(lens) - lens))
        return np.flatnonzero(unlike)

    def _normalized(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the pieces, each followed by a blank, and their numbers with it."""
        sizes = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
        chars = np.frombuffer((" ".join(pieces) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        special = self.tables.special[chars]
        if special.any():
            odd = np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(special), side="right"))
            pieces = list(pieces)
            for k in odd.tolist():
                pieces[k] = _library().normalize_str(pieces[k])
            sizes = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
            chars = np.frombuffer((" ".join(pieces) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.tables.lower[chars], sizes

    def encode(self, texts: list[str | None], then: int | None = None) -> Encoded:
        """Tokens of each text (null: none); then: an id after each text."""
        pieces: list[str] = []
        after: list[int] = []  # id after the piece, or -1
        owner: list[int] = []
        for k, text in enumerate(texts):
            text, at = text or "", 0
            for m in self.specials.finditer(text) if self.specials else ():
                pieces.append(text[at : m.start()])
                after.append(self.special[m.group()])
                owner.append(k)
                at = m.end()
            pieces.append(text[at:] if at else text)
            after.append(-1 if then is None else then)
            owner.append(k)
        chars, sizes = self._normalized(pieces)
        starts, ends = self._pretokens(chars)
        where = self._entries(chars, starts, ends) if len(starts) else np.empty(0, np.int64)
        of = np.searchsorted(np.cumsum(sizes), starts, side="right")
        lens = self.lens[where].astype(np.int64)
        extra = np.array(after, np.int64)
        per_piece = np.bincount(of, lens, len(pieces)).astype(np.int64) + (extra >= 0)
        counts = np.bincount(np.array(owner), per_piece, len(texts)).astype(np.int64)
        if not self.with_ids:
            return Encoded(None, counts)
        ids = np.empty(int(counts.sum()), np.uint32)
        begins = np.cumsum(per_piece) - per_piece
        mine = self.flat[ragged(self.starts[where], lens)] if len(where) else self.flat[:0]
        ids[ragged(begins, per_piece - (extra >= 0))] = mine
        ids[(begins + per_piece - 1)[extra >= 0]] = extra[extra >= 0]
        return Encoded(ids, counts)


def verify(spec: dict) -> None:
    """Raise unless the engine carries out what the vocabulary file asks for."""
    splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] != "ByteLevel"]
    levels = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "ByteLevel"]
    model = spec["model"]
    for what, fits in (
        ("normalizer", (spec["normalizer"] or {}).get("normalizers") == _NORMALIZER),
        ("pre-tokenizer", len(splits) == 1 and splits[0] == {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}),
        ("byte level", len(levels) == 1 and not levels[0]["add_prefix_space"] and not levels[0]["use_regex"]),
        ("model", model["type"] == "BPE" and model["end_of_word_suffix"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))),
        ("added tokens", all(t["content"] and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])),
    ):
        if not fits:
            raise ValueError(f"the file's {what} is none that the engine knows")


def _library():
    """NFC of the tokenizer library; lower case follows by table, or at once where it is several characters."""
    from tokenizers import normalizers

    if "normalizer" not in _kept():
        _kept()["normalizer"] = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    return _kept()["normalizer"]


def _kept() -> dict:
    """What this process keeps from task to task. Functions are shipped by value, so a module's own globals would not last."""
    return sys.__dict__.setdefault("_strataline_kept", {})


def engine(path: str, with_ids: bool, tables: UnicodeTables) -> WordBpe:
    """The engine of this worker process. It stays from task to task, with its bounded memory."""
    key = ("bpe", path, with_ids)
    if key not in _kept():
        _kept()[key] = WordBpe(path, with_ids, tables)
    return _kept()[key]


def chunks(texts: list, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters, one text at least."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield begin, k
            begin, size = k, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)
