"""Token ids of whole texts by a public byte-level BPE vocabulary, speculated and verified.

A text is cut into words by the vocabulary's pattern. For every word not seen before, greedy longest match *speculates* a
token sequence. A sequence is the BPE encoding exactly if each token encodes to itself and every adjacent pair is
compatible, that is, the joined bytes of the two encode to just these two tokens; all adjacent pairs of a batch of words are
checked at once against a sorted table of verdicts. Only words with a failing pair undergo exact merging.

Defined results: NULL and empty texts give an empty list; text that looks like a special token is plain text; blank, very
long and odd Unicode texts are encoded in whole; every row of the input gives one row, repeated ids included.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codewell.runtime import spread

#: The published word pattern of this vocabulary family, with white space as Unicode's White_Space property (fixed value).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_SHIFT = np.int64(1) << np.int64(32)
#: A worker's word cache is emptied beyond this; it affects speed only.
CACHE_WORDS = 400_000
#: Verdicts of pairs remembered at most; beyond that they are settled anew.
MOST_PAIRS = 4_000_000


class SpeculativeBpe:
    """Encoder of one vocabulary, given as token bytes to rank; a smaller rank merges first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.words: dict[str, list[int]] = {}
        self.known_pairs, self.verdicts = np.empty(0, np.int64), np.empty(0, bool)
        self.self_ok: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.merged_words = 0

    @classmethod
    def load(cls, path: str) -> SpeculativeBpe:
        """From a file of lines ``base64(token) rank``."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding: merge the adjacent pair of the smallest rank, leftmost first, until none can merge."""
        ranks = self.ranks
        if len(word) > 256:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap and a linked list, n log n in the length of the word."""
        import heapq

        ranks, n = self.ranks, len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = nxt[i]
            if part[i] is None or j >= n or part[i] + part[j] != whole:
                continue  # stale: a side was merged meanwhile
            part[i], part[j] = whole, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for a in (prv[i], i):
                if a >= 0 and nxt[a] < n:
                    pair = part[a] + part[nxt[a]]
                    r = ranks.get(pair)
                    if r is not None:
                        heapq.heappush(heap, (r, a, pair))
        return [ranks[p] for p in part if p is not None]

    def speculate(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ranks, out, i, n = self.ranks, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = ranks.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Verdict of each pair (left id << 32 | right id); unknown ones are settled by exact merging, once."""
        uniq = np.unique(pairs)
        if len(self.known_pairs) > MOST_PAIRS:  # affects speed only
            self.known_pairs, self.verdicts = self.known_pairs[:0], self.verdicts[:0]
        fresh = uniq[~np.isin(uniq, self.known_pairs, assume_unique=True)] if len(self.known_pairs) else uniq
        if len(fresh):
            said = np.empty(len(fresh), bool)
            for k, p in enumerate(fresh.tolist()):
                a, b = p >> 32, p & 0xFFFFFFFF
                said[k] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            at = np.searchsorted(self.known_pairs, fresh)
            self.known_pairs = np.insert(self.known_pairs, at, fresh)
            self.verdicts = np.insert(self.verdicts, at, said)
        return self.verdicts[np.searchsorted(self.known_pairs, pairs)]

    def _own(self, token: int) -> bool:
        ok = self.self_ok.get(token)
        if ok is None:
            ok = self.self_ok[token] = self.merge(self.bytes_of[token]) == [token]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode new words into the cache."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guess = [self.speculate(w) for w in raw]
        lengths = np.array([len(g) for g in guess])
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(lengths.sum()))
        bad_tokens = [t for t in np.unique(flat).tolist() if not self._own(t)]
        owner = np.repeat(np.arange(len(words)), lengths)
        fails = np.zeros(len(words), bool)
        if bad_tokens:
            fails[owner[np.isin(flat, bad_tokens)]] = True
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            pairs = (flat[:-1] * _SHIFT + flat[1:])[inside]
            if len(pairs):
                fails[owner[1:][inside][~self._compatible(pairs)]] = True
        for k, (w, g) in enumerate(zip(words, guess, strict=True)):
            self.words[w] = self.merge(raw[k]) if fails[k] else g
        self.merged_words += int(fails.sum())

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        fresh = {w for ws in cut for w in ws} - self.words.keys()
        if fresh:
            self.learn(sorted(fresh))
        words = self.words
        return [[t for w in ws for t in words[w]] for ws in cut]


_LOADED: dict[str, SpeculativeBpe] = {}


def encoder(path: str) -> SpeculativeBpe:
    """The worker's encoder of a file; loaded once per Python process, which serves many tasks."""
    if path not in _LOADED:
        _LOADED[path] = SpeculativeBpe.load(path)
    return _LOADED[path]


def encode_corpus(docs: DataFrame, ident: str, text: str, path: str) -> DataFrame:
    """``(ident, ids)`` of every row, by the vocabulary file at ``path``, which every executor must be able to read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for a in range(0, batch.num_rows, 256):  # bounded memory for very long texts
                ids = bpe.encode_batch(texts.slice(a, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    narrow = docs.select(ident, text)
    kind = narrow.schema[0].dataType.simpleString()
    return spread(narrow, 2).mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", ident)
