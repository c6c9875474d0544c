"""Evaluation passages inside training documents by size-partitioned MinHash containment search.

An item leaks into a document that holds at least ``window`` successive words of it with at most ``slack`` words changed,
missing or added. Both sides are reduced to words without case, accents, punctuation, markup and repeat marks. The queries
are all windows of an item; the domains are blocks of documents, overlapping so far that every altered window lies wholly in
one block. Domains are partitioned by size: the larger a block's shingle set, the smaller the Jaccard similarity that the
containment guarantees, and the more hash functions are looked up; their number keeps the chance of missing a case at the
bound below ``MISS``. Candidates are verified by exact shingle containment (an altered window keeps at least
``window - 4 - 5 * slack`` of its five-word shingles) and then by the exact number of word edits.

The evaluation items travel to the documents, never the other way: items are taken in slices of at most ``SLICE_WORDS`` words,
whose sizes are counted first. A pass over the documents, without a shuffle, searches each batch of them for up to
``PASS_SLICES`` slices in turn, so a hundred times a usual benchmark is still one pass.

Defined results: NULL, empty and blank texts and texts of fewer words hold nothing; items of fewer than ``window`` words cannot
leak; repeated rows and several occurrences give a pair once, with the best match; an item equal to another leaks wherever
that one does; very long texts are searched whole; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewell.llm.plain import WordHashes, without_marks
from codewell.runtime import spread

SHINGLE = 5
CELL = 18  # shingles, as many as a window of 20 words has with two more; every run of so many lies in two successive cells
BLOCK = 2 * CELL + SHINGLE - 1  # words
#: Words searched at once.
GROUP_WORDS = 400_000
#: Upper size of each partition in words, and the chance that a case at the bound is missed.
PARTITIONS, MISS = (24, 32, BLOCK), 1e-4
#: Item words per slice: a slice's tables take a few dozen MB in each worker.
SLICE_WORDS = 400_000
#: Slices searched in one pass.
PASS_SLICES = 16
#: A tag: one word, or a name and attributes with "="; a short comment or declaration. Other text between < and > is text.
_TAG = r"""<[^\s<>]{1,60}>|</?[a-z][\w:.-]*(?:\s+[\w:@.-]+\s*=\s*(?:"[^"<>]{0,200}"|'[^'<>]{0,200}'|[^\s<>"']{1,200})){0,20}\s*/?>|<![^\s<>]*(?:\s+[^\s<>]+){0,8}\s*>"""
_MARKUP = re.compile(_TAG + r"|\[/?[^\]\[\n]{0,12}\]|\((?:x ?\d+|\d+ ?x|bis)\)|(?<!\w)(?:x\d+|\d+x)(?!\w)", re.IGNORECASE)
_MAYBE = re.compile(r"[<\[(\d]")  # in any markup
_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ`´](?=\w)")


def words_of(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, markup and repeat marks."""
    if not text:
        return []
    text = html.unescape(text) if "&" in text else text
    text = _MARKUP.sub(" ", text) if _MAYBE.search(text) else text
    return _WORD.findall(_APOSTROPHE.sub("", without_marks(text.casefold())))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for every run of SHINGLE words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def hash_count(size: int, window: int, slack: int) -> int:
    """Hash functions for blocks of up to ``size`` words, from the Jaccard similarity that the containment guarantees."""
    query, domain = window - SHINGLE + 1, max(window, size) - SHINGLE + 1
    kept = query - SHINGLE * slack
    return math.ceil(math.log(MISS) / math.log(1 - kept / (query + domain - kept)))


def multipliers(count: int) -> np.ndarray:
    """Odd multipliers of the hash functions."""
    return np.random.default_rng(7).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _min_hashes(shingles: np.ndarray, rows: np.ndarray, mult: np.uint64) -> np.ndarray:
    """Per row of indices the smallest value of one hash function."""
    x = shingles * mult
    x ^= x >> np.uint64(32)
    return x[rows].min(axis=1)


def edit_distance_within(pattern: list[int], text: list[int]) -> int:
    """Least edits between the pattern and any run of the text, bit-parallel over the pattern (at most 64 words)."""
    m, masks = len(pattern), {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += (ph & high != 0) - (mh & high != 0)
        ph, mh = ph << 1 & full, mh << 1 & full  # free start in the text
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        best = min(best, score)
    return best


class ItemIndex:
    """MinHash tables of all windows of a slice of items."""

    def __init__(self, items: list[tuple[int, str]], window: int, slack: int):
        self.window, self.slack = window, slack
        self.enough = max(1, window - SHINGLE + 1 - SHINGLE * slack)
        hasher = WordHashes()
        self.ids, self.words, self.shingles = [], [], []
        for ident, text in items:
            w = hasher.of(words_of(text))
            if len(w) >= window:
                self.ids.append(ident)
                self.words.append(w)
                self.shingles.append(shingle_hashes(w))
        self.lists = [x.tolist() for x in self.shingles]
        # every shingle of the items, and how often it stands in one of them at most
        each = [np.unique(x, return_counts=True) for x in self.shingles]
        known, most = (np.concatenate([e[i] for e in each]) if each else np.empty(0, np.uint64) for i in (0, 1))
        order = np.lexsort((most, known))
        last = np.flatnonzero(np.append(known[order][1:] != known[order][:-1], True)) if len(order) else order
        self.known, self.most = known[order][last], most[order][last]
        self.counts = [hash_count(size, window, slack) for size in PARTITIONS]
        self.mults = multipliers(max(self.counts))
        span = window - SHINGLE + 1
        self.tables = []
        for mult in self.mults:
            keys, owners = [], []
            for i, s in enumerate(self.shingles):
                mins = np.unique(_min_hashes(s, np.arange(len(s) - span + 1)[:, None] + np.arange(span), mult))
                keys.append(mins)
                owners.append(np.full(len(mins), i))
            k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            o = np.concatenate(owners) if owners else np.empty(0, np.int64)
            order = np.argsort(k, kind="stable")
            self.tables.append((k[order], o[order]))

    def search(self, words: np.ndarray) -> dict[int, tuple[int, int]]:
        """Items held by one document: item → (edits, position in the document) of the best window."""
        return self.search_all([words])[0]

    def search_all(self, docs: list[np.ndarray]) -> list[dict[int, tuple[int, int]]]:
        """The same for many documents at once: each hash function is one pass over all their shingles.

        Shingles are cut into cells; a block is two successive cells and the next block starts a cell on.
        """
        found: list[dict[int, tuple[int, int]]] = [{} for _ in docs]
        usable = [d for d, w in enumerate(docs) if len(w) >= max(self.window - self.slack, SHINGLE)]
        if not usable or not self.ids:
            return found
        shingles = [shingle_hashes(docs[d]) for d in usable]
        flat = np.concatenate(shingles)
        lengths = np.array([len(s) for s in shingles])
        base = np.cumsum(lengths) - lengths
        cells = -(-lengths // CELL)
        cell_base = np.cumsum(cells) - cells
        cell_at = np.concatenate([b + np.arange(0, n, CELL) for b, n in zip(base, lengths, strict=True)])
        blocks = np.maximum(1, cells - 1)
        owner = np.repeat(np.arange(len(usable)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = cell_base[owner] + place
        second = np.minimum(first + 1, cell_base[owner] + cells[owner] - 1)
        size = np.minimum(lengths[owner] - CELL * place, 2 * CELL) + SHINGLE - 1
        needed = np.array(self.counts)[np.searchsorted(PARTITIONS, size)]
        hits = []
        for j, mult in enumerate(self.mults):
            x = flat * mult
            x ^= x >> np.uint64(32)
            least = np.minimum.reduceat(x, cell_at)
            mins = np.minimum(least[first], least[second])
            keys, owners = self.tables[j]
            lo, hi = np.searchsorted(keys, mins), np.searchsorted(keys, mins, "right")
            for b in np.flatnonzero((hi > lo) & (needed > j)).tolist():
                hits.append(b * len(self.ids) + owners[lo[b] : hi[b]])
        if not hits:
            return found
        # a block with fewer shingles of any item than an altered window keeps cannot pass the exact containment
        near = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
        kept = np.concatenate([[0], np.cumsum(np.where(self.known[near] == flat, self.most[near], 0))])
        begin = base[owner] + CELL * place
        enough = kept[begin + size - SHINGLE + 1] - kept[begin] >= self.enough
        codes = np.unique(np.concatenate(hits))
        at_block, held = -1, set()
        for code in codes[enough[codes // len(self.ids)]].tolist():
            b, i = divmod(code, len(self.ids))
            k, at, n = owner[b], int(CELL * place[b]), int(size[b])
            if b != at_block:
                at_block, held = b, set(shingles[k][at : at + n - SHINGLE + 1].tolist())
            best = self._verify(i, docs[usable[k]][at : at + n], held)
            of = found[usable[k]]
            if best is not None and (i not in of or (best, at) < of[i]):
                of[i] = (best, at)
        return found

    def _verify(self, i: int, block: np.ndarray, block_shingles: set[int]) -> int | None:
        """Exact shingle containment of each window, then its exact edits; None if no window is within the slack."""
        w, span, enough = self.window, self.window - SHINGLE + 1, self.enough
        inside = [s in block_shingles for s in self.lists[i]]
        if sum(inside) < enough:
            return None
        held = np.concatenate([[0], np.cumsum(inside)])
        inside = held[span:] - held[:-span]
        least, text = None, block.tolist()
        for p in np.argsort(-inside, kind="stable").tolist():
            if inside[p] < enough or least == 0:
                break
            d = edit_distance_within(self.words[i][p : p + w].tolist(), text)
            if d <= self.slack and (least is None or d < least):
                least = d
        return least


_BUILT: dict[str, ItemIndex] = {}


def built_index(token: str, items: list[tuple[int, str]], window: int, slack: int) -> ItemIndex:
    """The worker's index of a slice; a Python process serves many tasks and builds it once."""
    if token not in _BUILT:
        if len(_BUILT) >= PASS_SLICES:
            _BUILT.clear()
        _BUILT[token] = ItemIndex(items, window, slack)
    return _BUILT[token]


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = 20, slack: int = 2
) -> DataFrame:
    """``(doc_id, item_id, edits, word_position)`` of every leaked item of every document."""
    spark = docs.sparkSession
    narrow = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct()
    total = narrow.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    slices = max(1, math.ceil(total / SLICE_WORDS))
    corpus = spread(docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text")), 2)
    kinds = {"doc": corpus.schema["doc"].dataType.simpleString(), "item": narrow.schema["item"].dataType.simpleString()}
    result = None
    for p in range(0, slices, PASS_SLICES):
        held = []
        for k in range(p, min(slices, p + PASS_SLICES)):
            part = narrow.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == k)
            held.append((uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in part.collect()])))  # at most about SLICE_WORDS words

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            hasher = WordHashes()
            for batch in batches:
                ids, group, size = [], [], 0
                for n, (doc, body) in enumerate(zip(batch["doc"], batch["text"], strict=True), 1):
                    ids.append(doc)
                    group.append(hasher.of(words_of(body)))
                    size += len(group[-1])
                    if size >= GROUP_WORDS or n == len(batch):
                        out = []
                        for token, rows in held:
                            index = built_index(token, rows.value, window, slack)
                            out += [(d, index.ids[i], edits, at) for d, of in zip(ids, index.search_all(group), strict=True) for i, (edits, at) in of.items()]
                        yield pd.DataFrame(out, columns=["doc", "item", "edits", "word_position"])
                        ids, group, size = [], [], 0

        found = corpus.mapInPandas(search, f"doc {kinds['doc']}, item {kinds['item']}, edits int, word_position int")
        result = found if result is None else result.unionByName(found)
    best = F.min(F.struct("edits", "word_position"))
    return result.groupBy("doc", "item").agg(best.alias("b")).select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("b.edits").alias("edits"), F.col("b.word_position").alias("word_position")
    )
