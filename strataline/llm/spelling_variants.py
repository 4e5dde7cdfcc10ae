"""Spelling variants of words: which ones are one edit apart, and which is the usual form.

Two words one edit apart share a half: with a word cut in the middle, either its
first half begins the other word or its second half ends it. Automaton shards
(Aho-Corasick) hold the two halves of every word. All words are scanned; an
occurrence counts if it lies where the half has to be and the lengths differ by
one at most, and the distance is verified on what is left of the two words: the
rests of a half's words are kept by what one edit can make of them, so that a
scanned word meets those at distance one and not all that share the half.

A word is sent only to shards that may hold a half of it: a half is dealt by its
side, its word's length and its outer letters, so every word is in two places as
an owner of halves and in six to be scanned. Places with too many owners become
grids of shards, by owner and by scanned word. What leaves a shard is one row for
each word with a variant, its number of variants and the best.

Defined results: null and empty texts have no words; a null id counts as an empty
text in front of the colon; repeated rows count again; an empty table gives an
empty result. Words may have any length. Only the columns doc_id and text are
read, so others may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, table, written
from .workers import released

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A word of a document loses a letter if this divides its hash; None: never.
DROP_EVERY = 97
#: A form has so many times the word's occurrences at least.
RATIO = 2
#: Letters by which halves are dealt, and halves in a shard.
OUTER, OWNERS = 4, 20_000
#: Different words after which a task gives on its counts.
HELD = 200_000
#: Rests of words up to this length are kept by what one edit makes of them, longer ones by their halves.
LONG = 64
#: Marks of kept rests: an open letter, a rest less a letter, a rest as it is. No word has them.
ANY, LESS, SAME = "\x00", "\x01", "\x02"

#: Latin-1 letters of words, A-Z lower-cased; everything else separates.
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def misspelled(word: bytes, begun: int, every: int) -> bytes:
    """The word, less one letter if its hash says so. begun: CRC-32 of what comes before the word."""
    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, every: int | None = DROP_EVERY, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word and n of all words of docs (doc_id, text) with so many letters and occurrences."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begun = crc32(f"{doc}:".encode())
                for word, n in Counter(words_of(text)).items():
                    if len(word) < length:
                        continue
                    if every is not None:
                        word = misspelled(word, begun, every)
                        if len(word) < length:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield part()
                    held.clear()
        if held:
            yield part()

    rows = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _routes(words: DataFrame, owners: int, shards: int) -> DataFrame:
    """shard, word, n, side, scanned of rows (word, n). side: 0 or 1 where the shard holds that half of the word, else null; scanned: whether it is looked at in the shard.

    A crowded place is a grid of shards: a word is an owner in all blocks of its
    part, and scanned in all parts of its block, so each owner meets each scanned
    word once and a shard has about so many of either.
    """
    m = F.length("word")
    places = []
    for d in (-1, 0, 1):
        size = m + d  # of a word whose halves are looked for in this one
        half = F.floor(size / 2).cast("int")
        for side, letters in ((0, F.substring(F.col("word"), F.lit(1), F.least(half, F.lit(OUTER)))), (1, F.right(F.col("word"), F.least(size - half, F.lit(OUTER)).cast("int")))):
            places.append(F.struct(F.concat_ws(":", F.lit(str(side)), size.cast("string"), letters).alias("key"), F.lit(side if d == 0 else None).cast("int").alias("side")))
    rows = words.select("word", "n", F.explode(F.array(*places)).alias("p")).select("word", "n", "p.*")
    many = rows.groupBy("key").agg(F.count("side").alias("owned")).filter(F.col("owned") > owners)
    rows = rows.join(many.withColumnRenamed("key", "crowded"), F.col("key") == F.col("crowded"), "left")
    parts = F.coalesce(F.ceil(F.col("owned") / owners), F.lit(1)).cast("int")
    every = F.sequence(F.lit(0), parts - 1)
    own_part, own_block = (F.pmod(F.xxhash64("word", F.lit(k)), parts).cast("int") for k in (0, 1))
    scans = F.transform(every, lambda p: F.struct(p.alias("part"), own_block.alias("block"), F.when(p == own_part, F.col("side")).alias("side"), F.lit(True).alias("scanned")))
    others = F.filter(every, lambda b: (b != own_block) & F.col("side").isNotNull())
    owns = F.transform(others, lambda b: F.struct(own_part.alias("part"), b.alias("block"), F.col("side").alias("side"), F.lit(False).alias("scanned")))
    rows = rows.select("word", "n", "key", (parts > 1).alias("grid"), F.explode(F.concat(scans, owns)).alias("p"))
    shard = F.when(F.col("grid"), F.xxhash64("key", "p.part", "p.block")).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)))
    return rows.select(shard.alias("shard"), "word", "n", "p.side", "p.scanned")


class Shard:
    """Halves of words in one automaton, with the rests of each half's words."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.words: list[str] = []
        self.halves: dict[str, list[dict | None]] = {}

    def add(self, word: str, side: int) -> None:
        half = len(word) // 2
        first, second = word[:half], word[half:]
        segment, rest = (second, first) if side else (first, second)
        rests = self.halves.setdefault(segment, [None, None])
        if rests[side] is None:
            rests[side] = {}
        own, k = rests[side], len(self.words)
        self.words.append(word)
        for pattern in edits_of(rest):
            own.setdefault(pattern, []).append(k)

    def ready(self) -> None:
        for segment, rests in self.halves.items():
            self.automaton.add_word(segment, (len(segment), rests))
        if self.halves:
            self.automaton.make_automaton()

    def near(self, word: str) -> Iterator[int]:
        """Places of words at distance one. A pair that both halves find is given by the first one; halves of long rests may repeat a place."""
        m = len(word)
        for end, (size, rests) in self.automaton.iter(word):
            if rests[0] is not None and end == size - 1 and 2 * size - 1 <= m <= 2 * size + 2:
                yield from self._verified(word, word[size:], rests[0])
            if rests[1] is not None and end == m - 1 and 2 * size - 2 <= m <= 2 * size + 1:
                for k in self._verified(word, word[: m - size], rests[1]):
                    own = self.words[k]
                    half = len(own) // 2
                    if word[:half] != own[:half]:  # else the first half finds the pair
                        yield k

    def _verified(self, word: str, rest: str, rests: dict) -> Iterator[int]:
        for pattern in questions_of(rest):
            for k in rests.get(pattern, ()):
                own = self.words[k]
                if own != word and (type(pattern) is str or one_edit(own, word)):
                    yield k


def edits_of(rest: str) -> Iterator:
    """Under what a rest is kept: with each letter open, less each letter, and itself; long ones by their halves."""
    n = len(rest)
    if n > LONG:
        yield "first", n, rest[: n // 2]
        yield "second", n, rest[n // 2 :]
        return
    for k in range(n):
        yield rest[:k] + ANY + rest[k + 1 :]
    yield from {LESS + rest[:k] + rest[k + 1 :] for k in range(n)}
    yield SAME + rest


def questions_of(rest: str) -> Iterator:
    """What edits_of gives for a rest that is one edit away: each such rest is found by one of these strings, long ones by one tuple or two."""
    n = len(rest)
    if n <= LONG:
        for k in range(n):
            yield rest[:k] + ANY + rest[k + 1 :]
    if n < LONG:
        yield LESS + rest
    if n <= LONG + 1:
        yield from {SAME + rest[:k] + rest[k + 1 :] for k in range(n)}
    for size in range(max(n - 1, LONG + 1), n + 2):
        first, second = rest[: size // 2], rest[n - (size - size // 2) :]
        yield "first", size, first
        yield "second", size, second


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    low, high = 0, len(a)  # letters that both begin with
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _variants(words: DataFrame, n_words: int, owners: int) -> DataFrame:
    """word, n_near and best (less: minus its n; word) of the words' variants in each shard."""

    def scan(rows: pa.Table) -> pa.Table:
        counts: dict[str, int] = {}
        shard = Shard()
        for word, n, side, scanned in zip(*(rows.column(c).to_pylist() for c in ("word", "n", "side", "scanned")), strict=True):
            if scanned:
                counts[word] = n
            if side is not None:
                shard.add(word, side)
        shard.ready()
        number = [0] * len(shard.words)
        best: list[tuple[int, str] | None] = [None] * len(shard.words)
        if shard.words:
            for word, n in counts.items():
                for k in set(shard.near(word)):
                    number[k] += 1
                    if best[k] is None or (-n, word) < best[k]:
                        best[k] = (-n, word)
        some = [k for k, x in enumerate(number) if x]
        return pa.table(
            {
                "word": pa.array([shard.words[k] for k in some], pa.string()),
                "n_near": pa.array([number[k] for k in some], pa.int64()),
                "less": pa.array([best[k][0] for k in some], pa.int64()),
                "form": pa.array([best[k][1] for k in some], pa.string()),
            }
        )

    rows = _routes(words, owners, max(1, math.ceil(2 * n_words / owners)))
    found = rows.groupBy("shard").applyInArrow(scan, "word string, n_near long, less long, form string")
    return found.select("word", "n_near", F.struct("less", F.col("form").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of rows (word, form): where the chain of forms ends. Each round doubles how far it is followed; chains double counts, so they are short."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("w2"), F.col("root").alias("r2"))
        further = now.join(ahead, F.col("root") == F.col("w2"), "left")
        then = written(further.select("word", F.coalesce("r2", "root").alias("root"), F.col("r2").isNotNull().alias("moved")), "roots")
        drop(now)
        now = then
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, ratio: float = RATIO, owners: int = OWNERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of rows (word, n), each word once and of two letters at least. ratio: how many times a word's n its form has at least."""
    words = written(words.select("word", "n"), "words")
    found = _variants(words, words.count(), owners)
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: long, word: string>").alias("best"))
    every = none.unionByName(found.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    usual = -F.col("best.less") >= ratio * F.col("n")
    every = written(every.select("word", "n", "n_near", F.when(usual, F.col("best.word")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n")), "variants")
    drop(words)
    ends = roots(every.filter(F.col("form").isNotNull())).withColumnRenamed("word", "w2")
    out = every.join(ends, F.col("word") == F.col("w2"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")))


#: CRC-32 byte by byte, by a table from its polynomial; near words by what is left of them without a letter.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
), counted AS (
  SELECT doc, run, count(*) AS c, hex(encode(doc || ':' || run)) AS x FROM runs WHERE length(run) >= 5 GROUP BY doc, run
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS INT), 2) AS BIGINT))),
                                 lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS INT)])), 4294967295) AS h FROM counted CROSS JOIN crc
), spelled AS (
  SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), shorter AS (
  SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.d = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS last, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON c.last = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(last, steps) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN ends USING (word)
"""
