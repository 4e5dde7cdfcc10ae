"""N-gram Jaccard join by prefixes under several global orders.

A document's set holds the hashes of its distinct five-word shingles. Equal
sets are one node from the start. Two sets of sizes x and y with a similarity
of t or more share an element of their first n - ceil(t * n) + 1 elements under
every global order of the elements. All orders used here put rare elements
first, by the binary digits of how many sets have them: an element that stands
in no other set can't be shared, and a set whose first elements are all of that
kind is linked with nothing and leaves the join at once. Among equally frequent
elements each order goes by a hash of its own.

Counts are dealt by hash range and answered to the texts (``dealt``), first
those of a half of all elements, by which most unlinked sets leave, then those
of all elements of the sets that are left. Nothing is broadcast.

Links are needed only for components, so copies are not expanded into pairs:

1. For each of several orders, sets with the same least element meet, and each
   is compared with the group's centre, the set with the fewest elements of its
   own. Families of near copies collapse here around their originals.
2. Sets of different components that share an element of their first ones under
   the first order are compared with the element's centre.
3. As far as an element still joins several components, all its pairs of sets
   of different components are candidates. Elements of few sets are joined with
   themselves. Elements of many sets tie their sets to families. Sets of a
   family whose sizes lie in neighbouring bands, a ratio of t apart, can be
   linked; those outside of the largest component are set against all, in blocks
   of bounded size, and candidates exist only within a block. No row is made for
   a pair.

Every candidate must share a prefix element under each of the orders before its
whole sets are intersected. No link between different components is lost: a
pair that is never compared is one component already.

Shingles and sets are told by keyed hashes of 64 and 128 bits; different ones
share a hash by chance only, once in 2 ** 64 pairs of shingles.

Defined results: null and empty texts, and texts without words, have size 0 and
link with nothing; one to four words are one shingle; a null doc_id takes part
with its set but names no component, and its component is null where no other
id is in it; rows repeated under one id are judged by their texts, each by
itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, named, table, written
from .components import components
from .dealt import answers, chunked, column, each, opened, text_bytes, with_answers
from .words import grams, mixed, words_of
from .workers import released

WORDS = 5
PERCENT = 75
#: Global orders; the first is joined on, the others filter its candidates.
ORDERS = 3
#: Orders whose least elements gather families first.
GATHER = 2
#: Only elements whose hash has this bit unset are counted first: half of them certify as much.
_HALF = np.uint64(1)
#: Bytes of text for each element that is counted first, about.
ELEMENT_BYTES = 12
_SALT = np.array([0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC6A4A7935BD1E995], np.uint64)
#: Elements of so many sets at most are joined with themselves; a set meets few others by them.
FEW = 16
BLOCK, AGAINST = 1000, 2000


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts with the hashes of their shingles, sorted and distinct within each text, and their numbers."""
    for begin, end, words in words_of(texts, lower=True, most=500_000):
        counts = words.after - words.first
        docs = np.repeat(np.arange(end - begin), counts)
        left = np.repeat(words.after, counts) - np.arange(len(words.hashes))
        g = grams(words.hashes, size)
        whole = left[: len(g)] >= size
        docs_of, hashes = [docs[: len(g)][whole]], [g[whole]]
        for n in range(1, size):  # the texts of fewer words
            at = words.first[counts == n]
            if len(at):
                hashes.append(grams(words.hashes, n)[at])
                docs_of.append(np.flatnonzero(counts == n))
        of, h = np.concatenate(docs_of), np.concatenate(hashes)
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        of, h = of[new], h[new]
        yield begin, end, h, np.bincount(of, minlength=end - begin)


def set_ids(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits that tell sets apart, as two columns."""
    ends = np.cumsum(sizes)
    out = np.zeros((len(sizes), 2), np.uint64)
    for which in (0, 1):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(elements ^ _SALT[which], which))))
        out[:, which] = mixed((total[ends] - total[ends - sizes]) + sizes.astype(np.uint64) * _SALT[2], which)
    return out


def _sid_array(ids: np.ndarray) -> pa.Array:
    offsets = np.arange(0, 16 * len(ids) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


def _binary(lens: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lens * values.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - math.ceil(n * percent / 100) + 1


def _prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-n * percent) // 100 + 1


def order_hash(elements: np.ndarray, order: int) -> np.ndarray:
    return mixed(elements ^ _SALT[order], order % 2)


def prefix(elements: np.ndarray, digits: np.ndarray, n: int, order: int, percent: int = PERCENT) -> np.ndarray:
    """Those of the first elements of a set of n under an order that others have as well; elements: all that others have; digits: of their counts."""
    size = prefix_size(n, percent) - (n - len(elements))
    if size <= 0:
        return elements[:0]
    return elements[np.lexsort((order_hash(elements, order), digits))[:size]]


def similar(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (n_a + n_b - common)


def _sets(rows: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all texts of a chunk, and their numbers."""
    parts = [(e, n) for _, _, e, n in shingle_sets(column(rows, "text"), size)]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, (np.uint64, np.int64)[k]) for k in (0, 1))


def _sets_of(chunks: DataFrame, size: int, doc_id: T.StructField) -> DataFrame:
    """doc_id, chunk, place in it, n_shingles and sid of each row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows, _ in each(batches):
            elements, sizes = _sets(rows, size)
            columns = [column(rows, "doc_id"), pa.array(np.full(len(sizes), chunk)), pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(sizes), _sid_array(set_ids(elements, sizes))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk", "place", "n_shingles", "sid"])

    schema = T.StructType([doc_id, *[T.StructField(c, k) for c, k in (("chunk", T.LongType()), ("place", T.IntegerType()), ("n_shingles", T.LongType()), ("sid", T.BinaryType()))]])
    return chunks.mapInArrow(run, schema)


def _firsts(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each set is not empty and the first of its kind, and the ids of all."""
    ids = set_ids(elements, sizes)
    first = np.zeros(len(sizes), bool)
    first[np.unique(ids, axis=0, return_index=True)[1]] = True
    return first & (sizes > 0), ids


def _counted(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, counts = np.unique(elements, return_counts=True)
    return distinct, np.minimum(counts, 255)


def _first_keys(rows: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Half of the elements of a chunk's distinct sets, with how many of these have them."""
    elements, sizes = _sets(rows, size)
    first, _ = _firsts(elements, sizes)
    elements = elements[np.repeat(first, sizes)]
    return _counted(elements[elements & _HALF == 0])


def _active_sets(chunks: DataFrame, size: int, percent: int) -> DataFrame:
    """The distinct sets that may be linked: sid, n and the elements that others may have. chunks: with answers to _first_keys."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, (digits,) in each(batches):
            elements, sizes = _sets(rows, size)
            first, ids = _firsts(elements, sizes)
            of = np.repeat(np.arange(len(sizes)), sizes)
            maybe = first[of]
            sure = maybe & (elements & _HALF == 0)
            maybe[sure] = digits[np.unique(elements[sure], return_inverse=True)[1]] > 1
            lens = np.bincount(of[maybe], minlength=len(sizes))
            active = first & (sizes - lens < _prefix_sizes(sizes, percent))
            if active.any():
                kept = _binary(lens[active], elements[maybe & active[of]])
                yield pa.RecordBatch.from_arrays([_sid_array(ids[active]), pa.array(sizes[active].astype(np.int32)), kept], ["sid", "n", "elements"])

    return chunks.mapInArrow(run, "sid binary, n int, elements binary").dropDuplicates(["sid"])


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all sets of a chunk of sets, and their numbers."""
    lists = column(rows, "elements").to_pylist()
    return np.frombuffer(b"".join(lists), np.uint64), np.array([len(e) // 8 for e in lists], np.int64)


def _ranked_sets(chunks: DataFrame, percent: int) -> DataFrame:
    """Those of the sets that may still be linked: with the elements that others have and the digits of their counts, own (how many others don't have) and the least element under each gathering order. chunks: of sets, with answers to their elements."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, (digits,) in each(batches):
            sizes = column(rows, "n").to_numpy()
            elements, lens = _flat(rows)
            digits = digits[np.unique(elements, return_inverse=True)[1]]
            of = np.repeat(np.arange(len(lens)), lens)
            often = digits > 1
            lens = np.bincount(of[often], minlength=len(lens))
            stay = (sizes - lens < _prefix_sizes(sizes, percent)) & (lens > 0)
            if not stay.any():
                continue
            which = often & stay[of]
            kept, lens = elements[which], lens[stay]
            begins = np.cumsum(lens) - lens
            least = [pa.array(np.minimum.reduceat(order_hash(kept, k), begins).view(np.int64)) for k in range(GATHER)]
            at = pa.array(np.flatnonzero(stay))
            own = pa.array((sizes[stay] - lens).astype(np.int32))
            yield pa.RecordBatch.from_arrays([column(rows, "sid").take(at), column(rows, "n").take(at), own, _binary(lens, kept), _binary(lens, digits[which]), *least], ["sid", "n", "own", "elements", "digits", *[f"m{k}" for k in range(GATHER)]])

    gathered = ", ".join(f"m{k} long" for k in range(GATHER))
    return chunks.mapInArrow(run, f"sid binary, n int, own int, elements binary, digits binary, {gathered}")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs (a, n_a, e_a, d_a, b, n_b, e_b, d_b): the filters of all orders, and then the whole sets."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, list] = {}

        def prefixes(sid: bytes, elements: np.ndarray, digits: bytes, n: int) -> list:
            if sid not in memory:
                if len(memory) >= 2000:
                    memory.clear()
                memory[sid] = [prefix(elements, np.frombuffer(digits, np.uint8), n, k, percent) for k in range(ORDERS)]
            return memory[sid]

        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for a, n_a, e_a, d_a, b, n_b, e_b, d_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(e_a, np.uint64), np.frombuffer(e_b, np.uint64)
                if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
                    continue
                if all(np.isin(p, q).any() for p, q in zip(prefixes(a, x, d_a, n_a), prefixes(b, y, d_b, n_b), strict=True)) and similar(x, y, n_a, n_b, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    return pairs.select("a", "n_a", "e_a", "d_a", "b", "n_b", "e_b", "d_b").mapInArrow(run, "a binary, b binary")


def _side(active: DataFrame, name: str) -> DataFrame:
    return active.select(F.col("sid").alias(name), F.col("n").alias(f"n_{name}"), F.col("elements").alias(f"e_{name}"), F.col("digits").alias(f"d_{name}"))


def _with_sets(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sets; few different ones stand in column b."""
    firsts = _side(active, "b").join(pairs.select("b").distinct(), "b", "left_semi")
    return pairs.join(_side(active, "a"), "a").join(firsts, "b")


def _prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """element, sid and own, for each set and each element of its prefix under the first order that others have."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(np.frombuffer(e, np.uint64), np.frombuffer(d, np.uint8), n, 0, percent) for n, e, d in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True)]
            lens = np.array([len(f) for f in found], np.int64)
            elements = np.concatenate(found) if found else np.empty(0, np.uint64)
            rows = pa.array(np.repeat(np.arange(len(lens)), lens))
            yield pa.RecordBatch.from_arrays([pa.array(elements.view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows)], ["element", "sid", "own"])

    return sets.select("sid", "n", "own", "elements", "digits").mapInArrow(run, "element long, sid binary, own int")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("node").alias("sid"), "label")
    return rows.select("element", "sid", "own").join(own, "sid", "left").select("element", "sid", "own", F.coalesce("label", "sid").alias("label"))


def _mixed_elements(rows: DataFrame) -> DataFrame:
    """Of rows (element, sid, own, label), those whose element joins several components; with its number of sets, and its centre and the centre's component."""
    by = rows.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("sets"), F.min(F.struct("own", "sid", "label")).alias("centre"))
    several = written(by.filter("low <> high").select(F.col("element").alias("e2"), "sets", "centre"), "mixed")
    return written(rows.join(several, F.col("element") == F.col("e2")).select("element", "sid", "own", "label", "sets", "centre"), "mixed")


def _incidence(lists: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    """Rows of zeros and ones: which of the sorted names are in each list."""
    out = np.zeros((len(lists), len(names)), np.float32)
    of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists) if lists else np.empty(0, np.uint64)
    at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
    known = names[at] == flat if len(names) else np.zeros(len(flat), bool)
    out[of[known], at[known]] = 1
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Common elements of each list in a with each in b."""
    out = np.zeros((len(a), len(b)), np.float32)
    names = np.intersect1d(np.concatenate(a), np.concatenate(b)) if a and b else np.empty(0, np.uint64)
    for k in range(0, len(names), width):
        some = names[k : k + width]
        out += _incidence(a, some) @ _incidence(b, some).T
    return out


def _block_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of a family, of rows (sid, label, family): those outside its largest component against all whose sizes allow it."""
    by_label = families.groupBy("family", "label").agg(F.count("*").alias("c"))
    main = by_label.groupBy(F.col("family").alias("f2")).agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    own = families.select(F.col("sid").alias("s2"), "label", "family")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    rows = sets.select("sid", "n", "elements", "digits", band.alias("band")).join(own, F.col("sid") == F.col("s2"))
    rows = written(rows.join(main, F.col("family") == F.col("f2")).drop("s2", "f2"), "families")
    columns = [F.col(c).alias(c) for c in ("sid", "n", "elements", "digits", "label", "family")]
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    asking = rows.filter("label <> main").select(*columns, near.alias("band"))
    asked = rows.select(*columns, "band")
    sizes = rows.groupBy("family", "band").agg(F.count("*").alias("members")).join(asking.groupBy("family", "band").agg(F.count("*").alias("askers")), ["family", "band"])
    sizes = written(sizes.select(F.col("family").alias("f2"), F.col("band").alias("b2"), F.ceil(F.col("askers") / BLOCK).alias("asks"), F.ceil(F.col("members") / AGAINST).alias("parts")), "sizes")
    there = (F.col("family") == F.col("f2")) & (F.col("band") == F.col("b2"))
    ask, part = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("asks")), F.pmod(F.xxhash64("sid", F.lit(2)), F.col("parts"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = asking.join(sizes, there).select(*columns, "band", ask.alias("ask"), all_of("parts").alias("part"))
    asked = asked.join(sizes, there).select(*columns, "band", part.alias("part"), all_of("asks").alias("ask"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            lists = [[np.frombuffer(e, np.uint64) for e in t.column("elements").to_pylist()] for t in (left, right)]
            digits = [[np.frombuffer(d, np.uint8) for d in t.column("digits").to_pylist()] for t in (left, right)]
            sizes = [t.column("n").to_numpy().astype(np.int64) for t in (left, right)]
            may = np.array(left.column("label").to_pylist(), object)[:, None] != np.array(right.column("label").to_pylist(), object)
            for k in range(ORDERS):
                may &= overlaps(*([prefix(e, d, int(n), k, percent) for e, d, n in zip(x, ds, ns, strict=True)] for x, ds, ns in zip(lists, digits, sizes, strict=True))) > 0
            if may.any():
                common = overlaps(*lists)
                both = sizes[0][:, None] + sizes[1]
                a, b = np.nonzero(may & (100 * common >= percent * (both - common)))
                x, y = (t.column("sid").to_pylist() for t in (left, right))
                _, first = np.unique(np.stack((a, _codes(right.column("label"))[b])), axis=1, return_index=True)  # one link to each component is enough
                found = [(x[a[i]], y[b[i]]) for i in first]
        return pa.table({c: pa.array([f[i] for f in found], pa.binary()) for i, c in enumerate("ab")})

    keys = ["family", "band", "ask", "part"]
    return asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "a binary, b binary")


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


def jaccard_links(chunks: DataFrame, n_bytes: int, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between the sids of different sets, enough of them to connect every component. chunks: of texts of so many bytes."""
    first = answers(chunks, lambda rows, _: _first_keys(rows, size), n_bytes // ELEMENT_BYTES, "first")
    active = written(_active_sets(with_answers(chunks, first), size, percent), "active")
    n_active = text_bytes(active, "elements")
    held = chunked(active, "elements", n_active, "active")
    drop(active)
    counts = answers(held, lambda rows, _: _counted(_flat(rows)[0]), n_active // 8, "counts")
    sets = written(_ranked_sets(with_answers(held, counts), percent), "sets")
    drop(held)

    candidates = []
    for k in range(GATHER):
        by = sets.groupBy(F.col(f"m{k}").alias("m")).agg(F.min(F.struct("own", "sid")).alias("centre"), F.count("*").alias("c"))
        centres = by.filter("c > 1").select("m", F.col("centre.sid").alias("b"))
        centres = written(centres.join(_side(sets, "b"), "b").select("m", "b", "n_b", "e_b", "d_b"), "centres")
        members = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("elements").alias("e_a"), F.col("digits").alias("d_a"), F.col(f"m{k}").alias("m0"))
        candidates.append(members.join(centres, F.col("m0") == F.col("m")).filter("a <> b").drop("m", "m0"))
    found = written(_verified(reduce(DataFrame.unionByName, candidates), percent), "links")
    labels = components(found)

    rows = _mixed_elements(_labelled(written(_prefix_rows(sets, percent), "prefix"), labels))
    stars = rows.filter(F.col("label") != F.col("centre.label")).select(F.col("sid").alias("a"), F.col("centre.sid").alias("b")).distinct()
    more = written(_verified(_with_sets(written(stars, "stars"), sets), percent), "links")
    found = found.unionByName(more)
    if not more.isEmpty():
        labels = components(found)
        rows = _mixed_elements(_labelled(rows, labels))

    few = F.col("sets") <= FEW
    x, y = (rows.filter(few).select(F.col("element").alias(f"{e}e"), F.col("sid").alias(e), F.col("label").alias(f"{e}l")) for e in "ab")
    pairs = x.join(y, (F.col("ae") == F.col("be")) & (F.col("a") < F.col("b")) & (F.col("al") != F.col("bl"))).select("a", "b").distinct()
    last = _verified(_with_sets(written(pairs, "candidates"), sets), percent)
    tied = written(rows.filter(~few).select(F.col("sid").alias("a"), F.col("centre.sid").alias("b"), "label").distinct(), "tied")
    if not tied.isEmpty():
        family = components(tied.select("a", "b")).select("node", F.col("label").alias("family"))
        families = tied.select("a", "label").distinct().join(family, F.col("a") == F.col("node")).select(F.col("a").alias("sid"), "label", "family")
        last = last.unionByName(_block_links(written(families, "families"), sets, percent))
    last = written(last, "links")
    return found.unionByName(last)


def _labels(sets: DataFrame, links: DataFrame, first) -> DataFrame:
    """sid, first (the least of what the rows of the set are) and label (of the set's component), of each set that is not empty; written."""
    labels = components(links).select(F.col("node").alias("s2"), "label")
    by_set = sets.filter("n_shingles > 0").groupBy("sid").agg(F.min(first).alias("first"))
    return written(by_set.join(labels, F.col("sid") == F.col("s2"), "left").select("sid", "first", F.coalesce("label", "sid").alias("label")), "by_set")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id linked, itself included) of each row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    n_bytes = text_bytes(own, "text")
    chunks = chunked(own, "text", n_bytes, "texts")
    sets = written(_sets_of(chunks, size, own.schema["doc_id"]), "sets")
    links = jaccard_links(chunks, n_bytes, size, percent)
    drop(chunks)
    by_set = _labels(sets, links, F.col("doc_id"))
    of_label = by_set.groupBy(F.col("label").alias("l2")).agg(F.min("first").alias("component_id"))
    of_set = by_set.join(of_label, F.col("label") == F.col("l2")).select(F.col("sid").alias("s2"), "component_id")
    out = sets.join(of_set, (F.col("sid") == F.col("s2")) & (F.col("n_shingles") > 0), "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", alone).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of those with its smallest doc_id (nulls last) the first one. Rows without words stay; all columns do."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id"), F.col("text"), F.struct(*map(named, others)).alias("others"))
    n_bytes = text_bytes(docs, "text")
    chunks = chunked(rows, "text", n_bytes, "texts")
    sets = written(_sets_of(chunks, WORDS, docs.schema["doc_id"]), "sets")
    links = jaccard_links(chunks, n_bytes)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "chunk", "place")
    firsts = _labels(sets, links, order).groupBy("label").agg(F.min("first").alias("first")).select("first.chunk", "first.place")
    kept = firsts.unionByName(sets.filter("n_shingles = 0").select("chunk", "place"))
    kept = kept.groupBy(F.col("chunk").alias("c2")).agg(F.sort_array(F.collect_list("place")).alias("places"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, places in zip(batch.column(0), batch.column(1), strict=True):
                own = opened(payload.as_py())
                yield pa.RecordBatch.from_arrays([column(own, c).take(places.values) for c in ("text", "others")], ["text", "others"])

    found = chunks.join(kept, F.col("chunk") == F.col("c2")).select("payload", "places")
    out = found.mapInArrow(run, T.StructType([rows.schema["text"], rows.schema["others"]]))
    return out.select(*[F.col("text") if c == "text" else F.col("others")[c].alias(c) for c in docs.columns])
