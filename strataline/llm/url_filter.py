"""URL filtering by a trie over reversed host labels and path segments.

The rules are compiled once on the driver into flat arrays, whose bytes are
checked against a bound, and broadcast. Every url is then judged by one walk
down the host labels, right to left, and from each label that ends a rule's host
one walk along the path segments. An edge is found by bisection among its
node's.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and gets the default verdict. Two rules with the same host and
path are an error. Only the url column is read; all kept columns stay, but for
those that have the name of a result. Of equally long rules the longer host wins.
"""

from __future__ import annotations

import pickle
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .workers import released

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query over ``pages``.
PAGE_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


#: Labels of edges that no host label and no path segment has: to the path of a rule, and to a rule's last part.
_PATH, _LAST = b"/", b"?"


class RuleTrie:
    """Edges of node n are edges begin[n] to begin[n + 1], in order of their labels; edge e leads to node e + 1.

    A rule is an edge for each label of its host, right to left, one to its
    path, and one for each whole segment. Its last part may be the beginning of
    a url's segment, so its edge is marked, and the node there has the rule.
    """

    def __init__(self, rules: Iterable[Rule], max_rules: int = 500_000, max_bytes: int = 64_000_000):
        found: dict[tuple[bytes, ...], Rule] = {}
        for rule in rules:
            if len(found) >= max_rules:
                raise ValueError(f"more than {max_rules} rules; they are broadcast")
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"verdict of {rule.text} is neither allow nor block")
            *whole, last = rule.path.split("/")
            labels = [*reversed(rule.host.translate(_LOWER).split(".")), _PATH.decode(), *whole, _LAST.decode() + last]
            key = tuple(x.encode("utf-8", "surrogatepass") for x in labels)
            if key in found:
                raise ValueError(f"{rule.text} is there twice")
            found[key] = rule
        keys = sorted(found)
        self.texts, self.verdicts = [found[k].text for k in keys], [found[k].verdict for k in keys]
        self.begin, self.ends, self.rule = array("i", [0]), array("i", [0]), array("i", [-1])
        labels = bytearray()
        level = [(0, len(keys), 0)]  # nodes of one depth: the keys that go through each
        while level:
            below = []
            for lo, hi, depth in level:
                while lo < hi:
                    label = keys[lo][depth]
                    to = bisect_left(keys, True, lo, hi, key=lambda k: k[depth] > label)  # noqa: B023
                    labels += label
                    self.ends.append(len(labels))
                    self.rule.append(lo if len(keys[lo]) == depth + 1 else -1)
                    below.append((lo + (self.rule[-1] >= 0), to, depth + 1))
                    lo = to
                self.begin.append(len(self.ends) - 1)
            level = below
        self.labels = bytes(labels)
        size = len(self.labels) + sum(x.itemsize * len(x) for x in (self.begin, self.ends, self.rule)) + sum(2 * len(t.encode("utf-8", "surrogatepass")) for t in self.texts)
        if size > max_bytes:
            raise ValueError(f"more than {max_bytes} bytes of rules; they are broadcast")

    def _label(self, edge: int) -> bytes:
        return self.labels[self.ends[edge] : self.ends[edge + 1]]

    def _child(self, node: int, label: bytes) -> int | None:
        lo, hi = self.begin[node], self.begin[node + 1]
        if lo < hi and (at := bisect_left(range(lo, hi), label, key=self._label) + lo) < hi and self._label(at) == label:
            return at + 1
        return None

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule text and verdict of the longest rule that fits, by host and path together."""
        best = -1
        node, parts = 0, None
        for label in reversed(host.encode("utf-8", "surrogatepass").split(b".")):
            node = self._child(node, label)
            if node is None:
                break
            if (root := self._child(node, _PATH)) is not None:
                parts = path.encode("utf-8", "surrogatepass").split(b"/") if parts is None else parts
                best = self._along(root, parts, best)
        return (self.texts[best], self.verdicts[best]) if best >= 0 else None

    def _last(self, node: int, part: bytes) -> int:
        """The rule of the longest last part of a node that part begins with, or -1. The greatest label up to part is that one, or shares no more with part than that one does."""
        lo, hi = self.begin[node], self.begin[node + 1]
        while True:
            hi = bisect_right(range(lo, hi), part, key=self._label) + lo
            if hi == lo or not (label := self._label(hi - 1)).startswith(_LAST):
                return -1
            if part.startswith(label):
                return self.rule[hi]
            part = commonprefix((label, part))

    def _along(self, node: int, parts: list[bytes], best: int) -> int:
        """best, or the rule that ends along the path. Hosts grow from call to call, so of equally long rules the longer host wins."""
        for part in parts:
            own = self._last(node, _LAST + part)
            if own >= 0 and (best < 0 or len(self.texts[own]) >= len(self.texts[best])):
                best = own
            node = self._child(node, part)
            if node is None:
                break
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    for k, c in enumerate(rest):
        if c in "?#":
            return rest[:k].translate(_LOWER), ""
        if c == "/":
            host, rest = rest[:k].translate(_LOWER), rest[k:]
            return host, rest.partition("#")[0].partition("?")[0]
    return rest.translate(_LOWER), ""


def judge_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", keep: tuple[str, ...] = (), default: str = "allow", max_rules: int = 500_000) -> DataFrame:
    """Columns ``keep`` of df (but for names of results) with host, path, rule and verdict of each row's url; one row out for each row in."""
    names = ("host", "path", "rule", "verdict")
    shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(RuleTrie(rules, max_rules)))  # a broadcast by itself would name the class
    keep = tuple(c for c in keep if c not in names)
    fields = [df.schema[c] for c in keep]
    added = [T.StructField(c, T.StringType()) for c in names]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = pickle.loads(shared.value)
        for batch in batches:
            hosts, paths, texts, verdicts = [], [], [], []
            for u in batch.column(0).to_pylist():
                host, path = split_url(u)
                hit = trie.match(host, path)
                hosts.append(host)
                paths.append(path)
                texts.append(hit and hit[0])
                verdicts.append(hit[1] if hit else default)
            new = [pa.array(x, pa.string()) for x in (hosts, paths, texts, verdicts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], [*keep, *names])

    return df.select(F.col(url).alias("__url"), *keep).mapInArrow(run, T.StructType([*fields, *added]))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), PAGE_RULES, keep=("page_id",))


OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules(rh, rp, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""
