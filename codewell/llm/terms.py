"""Frequency of every term by burst tries with adaptive prefixes.

Each task counts its own records into one burst trie: a node is either a branch by next letter or a container of suffixes
that bursts into a branch when it grows too large. A task sends each container once, packed, so the shuffle carries
distinct terms per task, never occurrences. Containers of different tasks burst at different depths; a routing table of
adaptive prefixes, made from the sizes per short prefix only, says to which subtree each of them belongs, and matching
subtrees are merged per prefix. The work per route is bounded by the vocabulary below a prefix, not by how often a hot term
occurs. Neither tries nor routes go deeper than ``DEEP`` letters, as drawn-out words ("lalala...") of any length share thousands:
a container of that depth does not burst, and a route of that depth that is still too large is parted by the terms' hash.

Defined results: NULL and blank texts count as no record with content; a record id written twice counts once (rows with
a NULL id are dropped); a text without any term adds nothing but, unless it is blank, counts as a record; an empty table
gives an empty frame; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Container, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewell.runtime import cut, parallelism

TERM = re.compile("[a-z]+")
#: Letters by which routes are refined at a time, terms after which a task sends its trie and begins another, and letters down to
#: which containers burst and routes are refined.
STEP, FLUSH, DEEP = 3, 1_000_000, 30
_TOTAL = "#"  # the route of the record counter; no term begins with it


class BurstTrie:
    """Occurrence and record counters per term; containers of more than ``burst`` suffixes become branches, down to DEEP letters.

    A container maps suffixes to places in two compact arrays of counters that the whole trie shares.
    """

    __slots__ = ("branches", "burst", "depth", "occurrences", "places", "records")

    def __init__(self, burst: int = 512, parent: BurstTrie | None = None):
        self.burst, self.depth = burst, 0 if parent is None else parent.depth + 1
        self.occurrences, self.records = (array("q"), array("q")) if parent is None else (parent.occurrences, parent.records)
        self.places: dict[str, int] = {}
        self.branches: dict[str, BurstTrie] | None = None

    def __len__(self) -> int:
        return len(self.occurrences)

    def add(self, suffix: str, occurrences: int, records: int) -> None:
        """Add counters to a term, given below this node's prefix."""
        node = self._down(suffix)
        suffix = suffix[len(suffix) - node[1] :]
        node = node[0]
        place = node.places.get(suffix)
        if place is None:
            node.places[suffix] = len(self.occurrences)
            self.occurrences.append(occurrences)
            self.records.append(records)
            if node.branches is None and node._too_large():
                node._split()
        else:
            self.occurrences[place] += occurrences
            self.records[place] += records

    def _down(self, suffix: str) -> tuple[BurstTrie, int]:
        """The container of a term and how many of its letters are left there."""
        node, at = self, 0
        while node.branches is not None and at < len(suffix):
            child = node.branches.get(suffix[at])
            if child is None:
                child = node.branches[suffix[at]] = BurstTrie(self.burst, self)
            node, at = child, at + 1
        return node, len(suffix) - at

    def _too_large(self) -> bool:
        return len(self.places) > self.burst and self.depth < DEEP

    def _split(self) -> None:
        """Burst: the container keeps only the term that ends here."""
        whole, self.places, self.branches = self.places, {}, {}
        for suffix, place in whole.items():
            node, left = self._down(suffix)
            node.places[suffix[len(suffix) - left :]] = place
        for child in self.branches.values():
            if child._too_large():
                child._split()

    def containers(self, prefix: str = "") -> Iterator[tuple[str, dict[str, list[int]]]]:
        """All containers with the prefix under which they hang."""
        if self.places:
            yield prefix, {s: [self.occurrences[p], self.records[p]] for s, p in self.places.items()}
        for letter, child in (self.branches or {}).items():
            yield from child.containers(prefix + letter)

    def terms(self) -> Iterator[tuple[str, int, int]]:
        """All terms with their counters."""
        for prefix, counts in self.containers():
            for suffix, (occurrences, records) in counts.items():
                yield prefix + suffix, occurrences, records


def _shared(a: str, b: str) -> int:
    """Letters that two terms share from the beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def pack(terms: dict[str, list[int]]) -> str:
    """A container as text: sorted, each term by the length shared with the one before and its rest."""
    out, last = [], ""
    for term in sorted(terms):
        k = _shared(term, last)
        out.append(f"{k}{term[k:]} {terms[term][0]} {terms[term][1]}")
        last = term
    return "\n".join(out)


_ENTRY = re.compile(r"(\d+)(\S*) (\d+) (\d+)")


def unpack(payload: str) -> Iterator[tuple[str, int, int]]:
    """The entries of a packed container."""
    last = ""
    for line in payload.split("\n") if payload else ():
        shared, rest, occurrences, records = _ENTRY.fullmatch(line).groups()
        last = last[: int(shared)] + rest
        yield last, int(occurrences), int(records)


def _count_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed containers of a task's trie. Tokens are combined per Arrow batch before they enter it: a descent in Python costs
    some 1.5 microseconds, so 30 million tokens would take 45 seconds where counting them first takes 5."""
    trie, records = BurstTrie(), 0

    def packed() -> pd.DataFrame:
        rows = [(p, len(c), pack({p + s: n for s, n in c.items()})) for p, c in trie.containers()]
        return pd.DataFrame(rows, columns=["prefix", "n", "payload"], dtype=object)

    for batch in batches:
        occurrences, holders = Counter(), Counter()
        for text in batch["text"]:
            if text is None or not text.strip(" \t\r\n"):
                continue
            records += 1
            found = TERM.findall(text.lower())
            occurrences.update(found)
            holders.update(set(found))
        for term, n in occurrences.items():
            trie.add(term, n, holders[term])
        if len(trie) >= FLUSH:
            yield packed()
            trie = BurstTrie()
    yield packed()
    if records:
        yield pd.DataFrame({"prefix": [_TOTAL], "n": [1], "payload": [pack({"": [records, records]})]})


def adaptive_routes(sizes: list[tuple[str, int]], budget: int) -> frozenset[str]:
    """Prefixes at which subtrees are merged: a prefix that holds more than ``budget`` entries is refined by a letter."""
    total: Counter[str] = Counter()
    for prefix, n in sizes:
        for d in range(len(prefix) + 1):
            total[prefix[:d]] += n
    return frozenset(p for p in total if all(total[p[:d]] > budget for d in range(len(p))))


def route_of(term: str, routes: Container[str]) -> str:
    """The longest route that is a prefix of the term."""
    depth = 0
    while depth < len(term) and term[: depth + 1] in routes:  # with a route all its prefixes are routes
        depth += 1
    return term[:depth]


def _routes(trees: DataFrame, budget: int) -> dict[str, int]:
    """Adaptive routes over packed containers ``(prefix, payload)`` with the number of parts of each: one, but for a route of DEEP
    letters that holds more than ``budget`` entries.

    The driver sees entries per prefix of STEP letters, then STEP letters further below each prefix that is still too large, and
    so on down to DEEP: at most 27 ** STEP numbers for every ``budget`` entries. Deep containers are counted unopened.
    """
    found: list[tuple[str, int]] = []
    depth, below = STEP, frozenset([""])
    while below and depth <= DEEP:

        def count(batches: Iterator[pd.DataFrame], depth: int = depth, below: frozenset[str] = below) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sizes: Counter[str] = Counter()
                for prefix, payload in zip(batch["prefix"], batch["payload"], strict=True):
                    if len(prefix) >= depth:
                        if prefix[: depth - STEP] in below:
                            sizes[prefix[:depth]] += payload.count("\n") + 1
                    elif any(b.startswith(prefix) or prefix.startswith(b) for b in below):
                        sizes.update(t[:depth] for t, _, _ in unpack(payload) if t[: depth - STEP] in below)
                yield pd.DataFrame({"prefix": list(sizes), "n": list(sizes.values())}, dtype=object)

        rows = [tuple(r) for r in trees.mapInPandas(count, "prefix string, n long").groupBy("prefix").agg(F.sum("n")).collect()]
        below = frozenset(p for p, n in rows if len(p) == depth and n > budget) if depth < DEEP else frozenset()
        found += [(p, n) for p, n in rows if p not in below]
        depth += STEP
    sizes = {p: n for p, n in found if len(p) == DEEP}
    return {r: -(-sizes.get(r, 1) // budget) for r in adaptive_routes(found, budget)}


def count_terms(texts: DataFrame, ident: str = "chunk_id", text: str = "text", budget: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """``(term, occurrences, records)`` of all maximal a-z runs of the lower-cased texts, and the one-row ``(n_records)``.

    Two shuffles: the texts once, by id, to count a repeated record once; the packed containers of each task, by route.
    What the driver gathers are sizes per prefix, see _routes().
    """
    spark = texts.sparkSession
    once = texts.select(F.col(ident).alias("id"), F.col(text).alias("text")).where("id is not null").dropDuplicates(["id"])
    packed = cut(once.select("text").mapInPandas(_count_texts, "prefix string, n long, payload string"))
    trees = packed.where(F.col("prefix") != _TOTAL)
    routes = _routes(trees.select("prefix", "payload"), budget)
    ends = {r for r in routes.keys() - {r[:-1] for r in routes if r} if routes[r] == 1}

    def reroute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prefix, payload in zip(batch["prefix"], batch["payload"], strict=True):
                if route_of(prefix, routes) in ends:  # the whole container belongs to one route
                    rows.append((route_of(prefix, routes), 0, payload))
                    continue
                parts: dict[tuple[str, int], dict[str, list[int]]] = {}
                for term, o, n in unpack(payload):
                    route = route_of(term, routes)
                    parts.setdefault((route, zlib.crc32(term.encode()) % routes[route]), {})[term] = [o, n]
                rows += [(r, part, pack(t)) for (r, part), t in parts.items()]
            yield pd.DataFrame(rows, columns=["route", "part", "payload"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        trie = BurstTrie()
        for payload in group["payload"]:
            for entry in unpack(payload):
                trie.add(*entry)
        return pd.DataFrame(list(trie.terms()), columns=["term", "occurrences", "records"])

    routed = trees.mapInPandas(reroute, "route string, part int, payload string")
    terms = routed.repartition(parallelism(spark), "route", "part").groupBy("route", "part").applyInPandas(merge, "term string, occurrences long, records long")
    n_records = packed.where(F.col("prefix") == _TOTAL).select(
        F.coalesce(F.sum(F.split("payload", " ")[1].cast("long")), F.lit(0)).alias("n_records")
    )
    return terms, n_records
