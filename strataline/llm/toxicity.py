"""Toxicity by a lexicon trie intersected with Levenshtein automata.

The lexicon is learned from labelled rows: words, and stems with any ending,
that stand in toxic documents and in varied places, but hardly in others. A
trie of its terms is run together with the automata of one edit (a letter more,
less or another, or two swapped), as one deterministic automaton that is built
as far as words reach it. Each hit has a probability, learned by term and, for
exact hits, by whether one word of the text or several are the term; for words
one edit away by the very spelling where it was seen often enough. A window of
words around it tells quotation from abuse: quotation marks and single words
near hits have weights, which are learned from how often hits with them stand in
toxic documents, and begin at QUOTED for marks and words of reporting. The
score is one minus the product of what the hits leave; labels, languages,
sources and ids are no inputs.

The learner reads at most MAX_LABELLED labelled rows outside the held-out
quarter, chosen by a hash of their ids; every count runs on the executors and
only terms come to the driver, all that the tests below let pass. Defined results: null and
empty texts score as texts without hits; rows without a doc_id count as not
held out; with no labels at all the lexicon is empty and every score is 0; a
document with several labels counts as toxic if one says so; rows that are there
twice are scored twice; an empty table gives an empty result; other columns may
have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, named, table, written
from .workers import released

MAX_LABELLED = 20_000
THRESHOLD = 0.3
#: Terms of so many letters at least are also found with one edit.
FUZZY_FROM = 5
#: Features are words and their first so many letters.
STEMS = range(4, 8)
MIN_PRECISION = 0.85
#: Toxic documents, and different words before it, that a term has at least.
LEAST = 3
#: How unlikely a term's toxic documents have to be by chance. Only those with different words before the
#: term count: copies of one passage count once.
BY_CHANCE = 1e-7
#: A task gives on what it has counted once that is so many words before features.
HELD = 500_000
PRIOR_FUZZY = 0.9
WINDOW = 6
#: What a hit in quotation marks, or near a word of reporting, counts until labels say otherwise; in toxic and clean documents so many.
QUOTED, PRIOR_DOCS = 0.3, 4
REPORTS = frozenset("said says quoted quote wrote written called word words term phrase insult slur reported reports alleged dit écrit mot sagte schrieb wort dijo escribió palabra".split())
#: The feature of a hit between quotation marks; no word has a mark.
MARKS = '"'

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile(r"""["“”„«»]""")


class Term(NamedTuple):
    text: str
    stem: bool  # with any ending


class Hit(NamedTuple):
    term: int
    edits: int


class LexiconAutomaton:
    """Trie of terms and Levenshtein automata in one; states are numbered as words reach them."""

    def __init__(self, terms: Iterable[Term], fuzzy_from: int = FUZZY_FROM):
        self.terms = list(terms)
        self.child: list[dict[str, int]] = [{}]
        self.edits_left = [0]  # the most edits that a term below the node allows
        self.whole: dict[int, int] = {}
        self.stems: dict[int, int] = {}
        for k, (text, stem) in enumerate(self.terms):
            node, allowed = 0, int(len(text) >= fuzzy_from)
            self.edits_left[0] = max(self.edits_left[0], allowed)
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.edits_left.append(0)
                node = self.child[node][c]
                self.edits_left[node] = max(self.edits_left[node], allowed)
            (self.stems if stem else self.whole)[node] = k
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.go: list[dict[str, int]] = []
        self.found: list[Hit | None] = []
        self.dead = self._number(frozenset())
        self.start = self._number(self._close({(0, 0)}))

    def _close(self, items: set) -> frozenset:
        """items with those that a left-out letter reaches. An item is a node with edits so far, or a stem (below 0) that is complete; edits of 2 and more wait for that letter, which was swapped with the one before."""
        out = set(items)
        for node, edits in items:
            if node >= 0 and edits == 0:
                out.update((x, 1) for x in self.child[node].values() if self.edits_left[x])
        for node, edits in list(out):
            if node in self.stems and edits < 2 and (edits == 0 or len(self.terms[self.stems[node]].text) >= FUZZY_FROM):
                out.add((-1 - self.stems[node], edits))
        return frozenset((node, edits) for node, edits in out if edits == 0 or (node, 0) not in out)

    def _number(self, items: frozenset) -> int:
        if items not in self.numbers:
            self.numbers[items] = len(self.sets)
            self.sets.append(items)
            self.go.append({})
            ends = [Hit(-1 - node, edits) for node, edits in items if node < 0]
            ends += [Hit(self.whole[node], edits) for node, edits in items if node in self.whole and edits < 2 and (edits == 0 or len(self.terms[self.whole[node]].text) >= FUZZY_FROM)]
            self.found.append(min(ends, key=lambda h: (h.edits, -len(self.terms[h.term].text), h.term), default=None))
        return self.numbers[items]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if node < 0:
                out.add((node, edits))
                continue
            if edits >= 2:
                if c == chr(edits - 2):
                    out.add((node, 1))
                continue
            if c in self.child[node]:
                out.add((self.child[node][c], edits))
            if edits == 0:
                if self.edits_left[node]:
                    out.add((node, 1))
                out.update((x, 1) for k, x in self.child[node].items() if k != c and self.edits_left[x])
                out.update((self.child[x][c], 2 + ord(k)) for k, x in self.child[node].items() if k != c and c in self.child[x] and self.edits_left[self.child[x][c]])
        out = {(n, e) for n, e in out if e == 0 or n < 0 or self.edits_left[n]}
        self.go[state][c] = to = self._number(self._close(out))
        return to

    def match(self, word: str) -> Hit | None:
        """The term that word is, or begins with, by the fewest edits."""
        state = self.start
        for c in word:
            state = self.go[state].get(c, -1) if c in self.go[state] else self._step(state, c)
            if state == self.dead:
                return None
        return self.found[state]


class ToxicityModel:
    """Terms and probabilities: of a term's exact hits by how many different words hit (1, or 2 and more), of words one edit away by term, or by word where it is known; near: weights of hits by what is near them."""

    def __init__(self, terms: list[Term], exact: list[tuple[float, float]], fuzzy: list[float], spelling: dict[str, float], base: float, near: dict[str, float] | None = None):
        self.terms, self.exact, self.fuzzy, self.spelling, self.base = terms, exact, fuzzy, spelling, base
        self.near = dict.fromkeys((MARKS, *REPORTS), QUOTED) if near is None else near

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its automaton and a bounded memory of words that don't hit."""

    def __init__(self, model: ToxicityModel, max_known: int = 150_000):
        self.model, self.automaton = model, LexiconAutomaton(model.terms)
        self.clean: set[str] = set()
        self.hits: dict[str, Hit] = {}
        self.max_known = max_known

    def spellings(self, text: str) -> dict[str, Hit]:
        """The words of a text (lower case) that hit, each once."""
        out = {}
        if len(self.clean) > self.max_known:
            self.clean.clear()
            self.hits.clear()
            self.automaton = LexiconAutomaton(self.model.terms)  # its states grow with the words seen
        words = set(_WORD.findall(text))
        words -= self.clean
        for w in words:
            hit = self.hits.get(w) or self.automaton.match(w)
            if hit:
                out[w] = self.hits[w] = hit
            else:
                self.clean.add(w)
        return out

    def score(self, text: str | None) -> float:
        left = 1 - self.model.base
        text = (text or "").lower()
        found = self.spellings(text)
        if found:
            weights = contexts(text, found, self.model.near)
            exact: dict[int, list[str]] = {}
            for w, hit in found.items():
                if hit.edits:
                    left *= 1 - self.model.spelling.get(w, self.model.fuzzy[hit.term]) * weights[w]
                else:
                    exact.setdefault(hit.term, []).append(w)
            for term, own in exact.items():
                left *= 1 - self.model.exact[term][len(own) > 1] * max(weights[w] for w in own)
        return 1 - left


def places(text: str, found: dict[str, Hit]) -> Iterator[tuple[str, bool, list[str]]]:
    """Each place of the words that hit: the word, whether it stands in quotation marks, and the window of words around it, itself included."""
    spans = [(m.start(), m.group()) for m in _WORD.finditer(text)]
    marks = [m.start() for m in _QUOTES.finditer(text)]
    lines = [m.start() for m in re.finditer("\n", text)] if marks else []
    hit_at = [k for k, (_, w) in enumerate(spans) if w in found]
    inside = _quoted([spans[k][0] for k in hit_at], marks, lines)
    for n, k in enumerate(hit_at):
        yield spans[k][1], inside[n], [w for _, w in spans[max(0, k - WINDOW) : k + WINDOW + 1]]


def contexts(text: str, found: dict[str, Hit], near: dict[str, float]) -> dict[str, float]:
    """The weight of each word that hits: the most that one of its places has, which is the least by what is near it. Other hits around make it more, but for quotation marks."""
    out = dict.fromkeys(found, 0.0)
    for word, inside, around in places(text, found):
        others = sum(w in found for w in around) - 1
        by_words = min((near[w] for w in around if w in near), default=1.0)
        weight = min(1.0, by_words * (1 + others), near[MARKS] if inside else 1.0)
        out[word] = max(out[word], weight)
    return out


def _quoted(places: list[int], marks: list[int], lines: list[int]) -> list[bool]:
    """Whether each place (ascending) stands between an opening and a closing mark of its line."""
    out, m, n, opened = [], 0, 0, False
    for p in places:
        while m < len(marks) and marks[m] < p:
            while n < len(lines) and lines[n] < marks[m]:
                n, opened = n + 1, False
            m, opened = m + 1, not opened
        while n < len(lines) and lines[n] < p:
            n, opened = n + 1, False
        close = m < len(marks) and (n == len(lines) or marks[m] < lines[n])
        out.append(opened and close)
    return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Text and toxic (0 or 1) of about ``most`` labelled rows that aren't held out, chosen by a hash of their ids."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    own = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("text"))
    return own.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("text", "toxic")


def _features(text: str | None) -> dict[str, int]:
    """Words (ending in $) and stems of a text, each with a hash of the word before one of its places."""
    out, before = {}, ""
    for w in _WORD.findall((text or "").lower()):
        if len(w) >= 3:
            h = crc32(before.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
            out[w + "$"] = h
            for n in STEMS:
                if len(w) > n:
                    out[w[:n]] = h
        before = w
    return out


def _counted(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """feature, n_docs and n_contexts (different words before it) of the texts; only: of these features, without contexts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[str, int] = {}
        seen: dict[str, set[int]] = {}

        def part() -> pa.RecordBatch:
            held = [list(seen.get(f, ())) for f in docs]
            return pa.RecordBatch.from_arrays([pa.array(list(docs)), pa.array(list(docs.values()), pa.int64()), pa.array(held, pa.list_(pa.int32()))], ["feature", "n", "contexts"])

        held = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for f, h in _features(text).items():
                    if only is None:
                        docs[f] = docs.get(f, 0) + 1
                        seen.setdefault(f, set()).add(h)
                        held += 1
                    elif f in only:
                        docs[f] = docs.get(f, 0) + 1
                if held >= HELD:
                    yield part()
                    docs.clear()
                    seen.clear()
                    held = 0
        if docs:
            yield part()

    parts = rows.select("text").mapInArrow(run, "feature string, n long, contexts array<int>")
    return parts.groupBy("feature").agg(F.sum("n").alias("n_docs"), F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("n_contexts"))


def unlikely(toxic: int, clean: int, rate: float) -> float:
    """Minus the logarithm of a bound (Chernoff's) on the chance of so many toxic documents among all that have a term."""
    n = toxic + clean
    share = toxic / n
    if share <= rate:
        return 0.0
    rest = (1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0
    return n * (share * math.log(share / rate) + rest)


def chosen_terms(toxic: dict[str, int], contexts: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[Term]:
    """Terms among counted features: words that are precise beyond chance, and such stems whose endings vary."""
    rate = max(n_toxic, 1) / max(n_toxic + n_clean, 1)

    def precise(f: str) -> bool:
        a, b = toxic[f] / max(n_toxic, 1), (clean.get(f, 0) + 0.5) / max(n_clean, 1)
        varied = min(toxic[f], contexts[f])
        return a / (a + b) >= MIN_PRECISION and unlikely(varied, clean.get(f, 0), rate) >= -math.log(BY_CHANCE)

    good = sorted((f for f in toxic if precise(f)), key=lambda f: (-toxic[f], f))
    words = [f[:-1] for f in good if f[-1] == "$"]
    longer: dict[str, list[str]] = {}  # stems that begin with each
    most: dict[str, int] = {}  # documents of the commonest word that begins with each
    for f in good:
        for n in STEMS:
            if f[-1] == "$" and len(f) > n:
                most.setdefault(f[:n], toxic[f])
            elif f[-1] != "$" and len(f) >= n:
                longer.setdefault(f[:n], []).append(f)
    begins = lambda f, known: any(f[:n] in known for n in range(1, len(f) + 1))
    stems: list[str] = []
    covered: set[str] = set()
    for f in sorted((f for f in good if f[-1] != "$"), key=len):
        if begins(f, covered):
            continue
        covered.add(f)
        longest = max((g for g in longer[f] if toxic[g] >= 0.95 * toxic[f]), key=len)
        if most.get(f, 0) < 0.8 * toxic[f]:
            stems.append(longest)
    known = set(stems)
    kept = [Term(s, True) for s in stems] + [Term(w, False) for w in words if not begins(w, known)]
    return sorted(kept, key=lambda t: (-toxic[t.text + "$" * (not t.stem)], t))


def learn(sample: DataFrame) -> ToxicityModel:
    """A model from rows (text, toxic)."""
    sizes = {int(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return ToxicityModel([], [], [], {}, 0.0)
    rate = n_toxic / (n_toxic + n_clean)  # what would not be beyond chance without clean documents is not with some
    varied = F.least("n_docs", "n_contexts")
    found = _counted(sample.filter("toxic = 1")).filter((varied >= LEAST) & (varied * -math.log(rate) >= -math.log(BY_CHANCE) - 1e-6)).collect()
    toxic, contexts = ({r["feature"]: min(r[c], r["n_docs"]) for r in found} for c in ("n_docs", "n_contexts"))
    clean = {r["feature"]: r["n_docs"] for r in _counted(sample.filter("toxic = 0"), frozenset(toxic)).collect()}
    terms = chosen_terms(toxic, contexts, clean, n_toxic, n_clean)
    blank = ToxicityModel(terms, [(1.0, 1.0)] * len(terms), [1.0] * len(terms), {}, 0.0)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text: its terms with the number of words that are one of them (word null), its words one edit away, or a row without a term."""
        scorer = blank.scorer()
        for batch in batches:
            rows: list[tuple[str | None, int, int, int]] = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = scorer.spellings((text or "").lower())
                exact = Counter(h.term for h in found.values() if not h.edits)
                rows += [(None, term, min(n, 2), int(y)) for term, n in exact.items()]
                rows += [(w, h.term, 0, int(y)) for w, h in found.items() if h.edits]
                rows += [] if found else [(None, -1, 0, int(y))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["word", "term", "words", "toxic"])

    hits = sample.select("text", "toxic").mapInArrow(run, "word string, term long, words long, toxic long")
    by = hits.groupBy("word", "term", "words").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    by = by.groupBy("term", "words", F.when(F.col("n") >= 5, F.col("word")).alias("word")).agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    rows = by.collect()
    pools: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        own = pools.setdefault((r["term"], r["words"]), [0, 0])
        own[0] += r["t"]
        own[1] += r["n"]

    def above(t: int, n: int, prior: float) -> float:
        """A share, drawn to its prior, beyond what the rate of toxic documents explains."""
        return max(0.0, ((t + 2 * prior) / (n + 2) - rate) / (1 - rate))

    def pooled(term: int, words: int) -> tuple[int, int]:
        return tuple(pools.get((term, words), (0, 0)))

    exact = [tuple(above(*pooled(k, words), MIN_PRECISION) for words in (1, 2)) for k in range(len(terms))]
    counts = [pooled(k, 0) for k in range(len(terms))]
    shares = [(t + 2 * PRIOR_FUZZY) / (n + 2) for t, n in counts]
    spelling = {r["word"]: above(r["t"], r["n"], shares[r["term"]]) for r in rows if r["word"] is not None}
    t, n = pooled(-1, 0)
    fuzzy = [above(t, n, PRIOR_FUZZY) for t, n in counts]
    return ToxicityModel(terms, exact, fuzzy, spelling, min(0.2, t / max(1, n)), near_weights(sample, blank))


def near_weights(sample: DataFrame, blank: ToxicityModel) -> dict[str, float]:
    """Weights of what is near hits: the share of toxic documents among those where it is near one, of that among all with hits. Words that aren't of reporting have one if clean documents have them beyond chance."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = blank.scorer()
        for batch in batches:
            rows: list[tuple[str, int]] = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (text or "").lower()
                if found := scorer.spellings(text):
                    features = {""}  # the document itself
                    for _, inside, around in places(text, found):
                        features.update(w for w in around if w not in found)
                        features.update(MARKS * inside)
                    rows += [(f, int(y)) for f in features]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int64())], ["feature", "toxic"])

    by = sample.select("text", "toxic").mapInArrow(run, "feature string, toxic long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    known = ("", MARKS, *REPORTS)
    found = {r["feature"]: (r["t"], r["c"]) for r in by.filter((F.col("c") >= LEAST) | F.col("feature").isin(*known)).collect()}
    t, c = found.pop("", (0, 0))
    share = (t + 1) / (t + c + 2)
    near = {}
    for f in {*found, *known[1:]}:
        t, c = found.get(f, (0, 0))
        prior = QUOTED if f in known else 1.0
        if f in known or unlikely(c, t, 1 - share) >= -math.log(BY_CHANCE):
            near[f] = min(1.0, (t + PRIOR_DOCS * prior * share) / (t + c + PRIOR_DOCS) / share)
    return near


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """Columns ``keep`` of df with the score of each row's text under a name."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            scores = pa.array([scorer.score(t) for t in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[skip:], scores], [*keep, name])

    skip = int(keep[:1] != (text,))  # a kept text that comes first isn't sent twice
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.DoubleType())])
    return df.select(*[F.col(text).alias("__text")] * skip, *keep).mapInArrow(run, schema)


def model_for(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> ToxicityModel:
    sample = written(labelled_sample(docs, labels, most), "toxic")
    model = learn(sample)
    drop(sample)
    return model


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, model_for(docs, table(spark, sf_dir, "labels")), keep=("doc_id",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below the threshold."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*map(named, others)).alias("others"))
    out = score_toxicity(rows, model_for(docs, table(spark, sf_dir, "labels")), keep=("text", "others")).filter(F.col("score") < THRESHOLD)
    return out.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns])
