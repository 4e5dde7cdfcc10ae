"""Secret scans: fixed patterns, and guess costs of values that stand in a credential's place.

Three patterns give the base spans. Beside them, every value that follows a
credential word (``pwd is ...``, ``passphrase: ...``) and no base span touches
is judged by its guess cost: the cheapest segmentation into words, dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming.
Values that cost at least 10 ** MIN_LOG10_GUESSES guesses are added as kind
``guess``; ``the token is important`` is no secret, ``the pwd is t7#Kp!x2wQ`` is.

Words are ranked: those that guessers try first, then those of a vocabulary
file in its order. A repeat is a unit, of any length, as often as it follows on
itself, and costs what the unit's own segmentation costs, times its number; a walk
goes along one row of keys in one direction. Of values of any length only places
that are reached for less than the threshold are gone on from, and repeats are
looked for from those alone, so memory is that of the value.

Positions are code points, ends exclusive. Defined results: a null text has no
spans and stays null when redacted, an empty one has none; texts are scanned
whole; rows that are there twice are scanned twice; an empty table gives an empty
result; other columns may have any name. Letters are ASCII.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, named, table
from .token_counts import tokenizer_path
from .workers import released

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10_GUESSES = 8.0
#: Most bytes of a word list, which is broadcast.
MAX_WORD_BYTES = 16_000_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run is a match of [0-9a-f]+; shorter ones are dropped anyway.
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|credentials?|secret|token|api[_-]?key|private[_-]?key|login)["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+(?:is|was)\x20+)["']?([^\s"'<>,;]{6,})""",
    re.I | re.A,
)
#: One of these is in every text that _ASSIGN or _CONTEXT match.
_HINTS = ("pass", "pwd", "credential", "secret", "token", "key", "login")

#: Words that guessers try first, commonest first.
WORDS = (
    "password", "qwerty", "welcome", "admin", "letmein", "monkey", "dragon", "master", "login", "princess",
    "football", "baseball", "sunshine", "shadow", "superman", "batman", "trustno", "hello", "freedom", "whatever",
    "secret", "summer", "winter", "spring", "autumn", "love", "flower", "hunter", "killer", "soccer",
    "hockey", "ranger", "george", "charlie", "michael", "jordan", "jennifer", "daniel", "andrew", "thomas",
    "robert", "matthew", "jessica", "ashley", "nicole", "pepper", "ginger", "cookie", "cheese", "banana",
    "orange", "purple", "silver", "golden", "diamond", "computer", "internet", "server", "default", "guest",
    "root", "user", "test", "demo", "temp", "pass", "word", "code", "token", "change", "changeme",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "company", "office", "access",
    "important", "required", "invalid", "expired", "missing", "correct", "incorrect", "unknown", "example", "please",
)
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_WALKS = tuple(row[::way] for row in _ROWS for way in (1, -1))
_WALK_STARTS = math.log10(2 * sum(map(len, _ROWS)))
_DATES = tuple((re.compile(p), math.log10(n)) for p, n in (
    (r"(?:19|20)\d\d", 140), (r"(?:19|20)\d\d[-./_]?(?:0[1-9]|1[0-2])[-./_]?(?:0[1-9]|[12]\d|3[01])", 365 * 140),
    (r"(?:0?[1-9]|[12]\d|3[01])[-./_]?(?:0?[1-9]|1[0-2])[-./_]?(?:19|20)?\d\d", 365 * 140 * 2),
))
#: Capitals as small letters, and letters that stand for others.
_LOWER = {c: c + 32 for c in range(65, 91)}
_LEET = str.maketrans("4@310$5!7", "aaeiossit")
#: A segment more makes guessing harder than the product of its parts.
_SEGMENT = math.log10(2)
#: Units from this length on are looked for by their first so many characters.
_PROBE = 8


def _alphabet(value: str) -> int:
    kinds = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    size = sum(n for is_kind, n in kinds if any(map(is_kind, value)))
    return size + (33 if any(not c.isalnum() for c in value) else 0) or 100


def ranked_words(path: str) -> tuple[str, ...]:
    """WORDS, and then the words of three ASCII letters or more of a vocabulary file, in its order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    whole = (t.removesuffix(end) for t in sorted(model["vocab"], key=model["vocab"].get) if t.endswith(end))
    return tuple(dict.fromkeys([*WORDS, *(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())]))


def common(value: str, a: int, b: int) -> int:
    """Equal characters from places a and b on; b > a."""
    n, step = 0, 32
    while b + n + step <= len(value) and value[a + n : a + n + step] == value[b + n : b + n + step]:
        n, step = n + step, 2 * step
    while step:
        if b + n + step <= len(value) and value[a + n : a + n + step] == value[b + n : b + n + step]:
            n += step
        else:
            step //= 2
    return n


def repeats_from(value: str, i: int) -> Iterator[tuple[int, int]]:
    """The units (their lengths) that begin at a place and follow at least once on themselves, and where that ends. Units are no repeats themselves.

    Within a run of a unit, no longer unit begins at the same place: the next one reaches beyond the run.
    """
    most, unit = (len(value) - i) // 2, 1
    while unit <= most:
        if unit < _PROBE:
            same = value.startswith(value[i : i + unit], i + unit)
        else:  # its first characters come again where it begins again
            at = value.find(value[i : i + _PROBE], i + unit, i + most + _PROBE)
            if at < 0:
                return
            unit = at - i
            same = value[i : at] == value[at : at + unit]
        if same:
            end = i + unit + common(value, i, i + unit)
            yield unit, i + (end - i) // unit * unit
            unit = max(unit, end - i - unit)
        unit += 1


class Guesser:
    """Guess costs by a ranked list of words."""

    def __init__(self, words: Iterable[str] = WORDS):
        self.rank = {w: n for n, w in reversed(list(enumerate(words, 1)))}
        self.longest = max(map(len, self.rank), default=0)

    def log10_guesses(self, value: str, limit: float = math.inf) -> float:
        """Cost of the cheapest segmentation of value, as a power of ten; infinite if it reaches the limit."""
        return self._cost(value, math.log10(_alphabet(value)), limit, {})

    def _cost(self, value: str, each: float, limit: float, known: dict[str, float]) -> float:
        """The cost with brute force at each a character. Only places that cost less than the limit are gone on from, so few of a long value are; known: of values so far."""
        if value in known:
            return known[value]
        n = len(value)
        low = value.translate(_LOWER)
        plain = low.translate(_LEET)
        best, ahead = {0: 0.0}, [0]

        def reach(j: int, cost: float) -> None:
            if cost < limit and cost < best.get(j, math.inf):
                if j not in best:
                    heapq.heappush(ahead, j)
                best[j] = cost

        while ahead and ahead[0] < n:
            i = heapq.heappop(ahead)
            reach(i + 1, best[i] + each)
            so_far = best[i] + (_SEGMENT if i else 0)
            for j in range(i + 3, min(n, i + self.longest) + 1):
                if (rank := self.rank.get(low[i:j])) or (rank := 4 * self.rank.get(plain[i:j], 0)):
                    upper = sum(map(str.isupper, value[i:j]))
                    reach(j, so_far + math.log10(rank * (1 if not upper else 2 if upper in (1, j - i) else 2**upper) + 1))
            for row in _WALKS:
                at = row.find(low[i])
                length = 1
                while 0 <= at and at + length < len(row) and low.startswith(row[at + length], i + length):
                    length += 1
                    if length >= 3:
                        reach(i + length, so_far + _WALK_STARTS + math.log10(length))
            for unit, j in repeats_from(value, i):
                if j - i >= 3 and best.get(j, limit) > so_far:
                    own = each if unit == 1 else self._cost(value[i : i + unit], each, limit, known)
                    reach(j, so_far + own + math.log10((j - i) // unit))
            for pattern, cost in _DATES:
                if m := pattern.match(value, i):
                    reach(m.end(), so_far + cost)
        known[value] = best.get(n, math.inf)
        return known[value]


class Span(NamedTuple):
    """value_start is where the secret itself begins; a span's start may be the name before it."""

    kind: str
    start: int
    end: int
    value_start: int


def scan(text: str | None, guesser: Guesser, least: float = MIN_LOG10_GUESSES) -> list[Span]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    out = []
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [Span("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        taken = sorted((s.start, s.end) for s in out)
        for m in _CONTEXT.finditer(text):
            a, b = m.span(1)
            b = a + len(m[1].rstrip(".:!?)"))
            if b - a >= 6 and not any(x < b and a < y for x, y in taken) and guesser.log10_guesses(text[a:b], least) >= least:
                out.append(Span("guess", a, b, a))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def redacted(text: str | None, spans: list[Span], mark: str = "[secret]") -> str | None:
    """text with every secret value, or run of overlapping ones, replaced."""
    if not spans:
        return text
    parts, at = [], 0
    for _, _, end, begin in sorted(spans, key=lambda s: s.value_start):
        if begin >= at:
            parts += [text[at:begin], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), redact: bool = False, least: float = MIN_LOG10_GUESSES, words: Iterable[str] = WORDS) -> DataFrame:
    """Columns ``keep`` of df with the array secret_spans of each row's text, and the text without them as redacted_text if asked for. words: ranked, the commonest first."""
    words = tuple(words)
    if sum(map(len, words)) > MAX_WORD_BYTES:
        raise ValueError(f"more than {MAX_WORD_BYTES} bytes of words; they are broadcast")
    shared = df.sparkSession.sparkContext.broadcast(words)
    added = [T.StructField("secret_spans", SPANS)] + [T.StructField("redacted_text", T.StringType())] * redact
    names = [*keep, *[f.name for f in added]]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(shared.value)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [scan(t, guesser, least) for t in texts]
            new = [pa.array([[{"kind": s.kind, "start": s.start, "end": s.end} for s in spans] for spans in found], _SPANS_ARROW)]
            if redact:
                new.append(pa.array([redacted(t, spans) for t, spans in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names)

    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, T.StructType([*[df.schema[c] for c in keep], *added]))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), keep=("doc_id",), words=ranked_words(tokenizer_path()))
    spans = F.col("secret_spans")
    counts = [_count(spans, k).alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter(spans, lambda s: s["kind"] != "guess")
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret's value replaced; n_chars follows the text."""
    bounded(spark)
    keep = tuple(c for c in docs.columns if c != "text")
    rows = docs.select("text", F.struct(*map(named, keep)).alias("__row"))
    found = find_secrets(rows, keep=("__row",), redact=True, words=ranked_words(tokenizer_path()))
    columns = {c: F.col("__row")[c] for c in keep} | {"text": F.col("redacted_text")}
    if "n_chars" in columns:
        length = F.length("redacted_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size("secret_spans") > 0, length).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])
