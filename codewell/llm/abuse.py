"""Scores for abusive, hateful or sexually explicit passages by a factorization machine over hashed terms.

A document is a stream of words, undone from disguises (look-alike letters, digits for letters, letters set apart, stretched or
masked words). Overlapping windows of the stream are scored by

    w0 + sum_i w_i + 1/2 (|sum_i v_i|^2 - sum_i |v_i|^2)

over the hashed words and word pairs i of the window: the vectors v learn which terms are harmful only together, such as an
insult with the mention of a group, or harmless together, such as a strong word with talk about music. The document's score is
the logistic of its best window. All windows of a document follow from prefix sums over its words, so scoring is linear in the
text however the windows overlap, and reads whole texts.

Labels are given to documents, not passages: training alternates between choosing the window of each positive document that
explains its label and fitting the machine on those windows against windows of negative documents. It uses a bounded sample
of labelled documents, at most ``MAX_LABELLED`` of each class chosen by hash, fits in one task and broadcasts at most
``BUCKETS`` * (1 + RANK) numbers; a tenth-part holdout of the sample sets the threshold.

Defined results: NULL, empty and blank texts score 0; contradicting labels of a document cancel out, NULL labels count as
none; with no label of one class every score is 0; repeated rows of a document give one row per row; extra columns are
ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewell.llm.plain import WordHashes, without_marks
from codewell.runtime import spread

BUCKETS, RANK = 1 << 17, 8
#: Labelled documents of each class used for training at most.
MAX_LABELLED = 6000
#: Words scored at once.
GROUP_WORDS = 100_000
#: Windows of each negative document, epochs, weight of a label beside the machine's own opinion, expected held-out positives.
PLAIN_WINDOWS, EPOCHS, TRUST, PRIOR = 6, 5, 0.8, 5
BATCH = 64
#: (length, step) of the windows in words.
WINDOWS = ((6, 2), (10, 2), (16, 4))

# Cyrillic and Greek letters that look like Latin ones.
_ALIKE = {
    ord(a): b
    for a, b in (pair for pair in (
        "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd һh ԛq ѡw ԝw ґr пn αa βb εe ιi κk νv οo ρp τt υu χx γy ηn").split())
}
# Digits and signs read as letters inside a word.
_LEET = str.maketrans("4301578$@!|€£", "aeoistbsailel")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_APART = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*·,/]{1,2}){3,}[^\W_](?![^\W_])")
_WORD = re.compile(r"[^\W_](?:[\w$@!|€£*'’.\-]*[\w$*@€£])?|\$[\w$@!]+")
_RUN = re.compile(r"(.)\1+")


def words_of(text: str | None) -> list[str]:
    """Normalised words of a text."""
    if not text:
        return []
    text = text.casefold()
    if not text.isascii():
        text = without_marks(_INVISIBLE.sub("", text)).casefold().translate(_ALIKE)
    text = _APART.sub(lambda m: "".join(c for c in m[0] if c.isalnum()), text)
    return [p for w in _WORD.findall(text) for p in _PLAIN[w]]


class _PlainWords(dict):
    """Written word → normalised words, remembered; emptied when large."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = _plain(word)
        return value


_PLAIN = _PlainWords()


def _plain(word: str) -> list[str]:
    if word.isalpha():
        return [_RUN.sub(r"\1", word)]
    if "*" in word.strip("*"):
        bare = re.sub(r"[^\w*]", "", word)
        return ["*masked*", f"{bare[:1]}*{bare[-1:]}"]
    word = word.replace("'", "").replace("’", "")
    if not word.isdigit() and any(c.isdigit() or c in "$@!|€£" for c in word):
        word = word.translate(_LEET)
    parts = [p for p in re.split(r"[^\w]+", word) if p]
    if len(parts) > 1 and all(len(p) < 3 for p in parts):
        parts = ["".join(parts)]
    elif len(parts) == 2 and "-" in word and min(map(len, parts)) < 3:
        parts = ["".join(parts)]  # a letter replaced by a dash
    return [_RUN.sub(r"\1", p) for p in parts]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of each word with its successor."""
    return _mix(hashes), _mix(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x2545F4914F6CDD1D))


def spans(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over n words; every word lies in one of each length."""
    a, b = [], []
    for length, step in WINDOWS:
        if n <= length:
            a.append(np.array([0]))
            b.append(np.array([n]))
            break
        s = np.append(np.arange(0, n - length, step), n - length)
        a.append(s)
        b.append(s + length)
    return np.concatenate(a), np.concatenate(b)


class FactorizationMachine:
    """Weights and vectors of the buckets; the bucket BUCKETS is padding and stays 0."""

    def __init__(self, bias: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None, threshold: float = 2.0):
        self.bias, self.threshold = bias, threshold
        self.w = np.zeros(BUCKETS + 1, np.float32) if w is None else w
        self.v = np.zeros((BUCKETS + 1, RANK), np.float32) if v is None else v
        self._table: np.ndarray | None = None

    def set_weights(self, w: np.ndarray) -> None:
        self.w, self._table = w, None

    def table(self) -> np.ndarray:
        """Weight, vector and squared length of every bucket side by side."""
        if self._table is None:
            self._table = np.concatenate([self.w[:, None], self.v, (self.v**2).sum(1, keepdims=True)], axis=1)
        return self._table

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, start, end and raw score of every window of many texts: the prefix sums run over all of them at once, no
        window over the bounds. A text of at most a window's length is one window; the empty one has none."""
        n = np.array([len(t) for t in texts], np.int64)
        if not n.sum():
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        base = np.cumsum(n) - n
        flat = np.concatenate([t for t in texts if len(t)])
        one, two = buckets(flat)
        table = self.table()
        prefix = lambda x: np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
        singles, pairs = prefix(table[one]), prefix(table[two])
        found, before = [], 0
        for length, step in WINDOWS:
            for docs, short in ((np.flatnonzero(n > length), False), (np.flatnonzero((n <= length) & (n > before)), True)):
                if not len(docs):
                    continue
                count = np.ones(len(docs), np.int64) if short else 1 - (length - n[docs]) // step
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                room = np.repeat(np.zeros(len(docs), np.int64) if short else n[docs] - length, count)
                start = np.minimum(place * step, room)
                a = np.repeat(base[docs], count) + start
                b = a + np.repeat(np.minimum(n[docs], length), count)
                s = singles[b] - singles[a] + pairs[b - 1] - pairs[np.minimum(a, b - 1)]
                raw = self.bias + s[:, 0] + 0.5 * ((s[:, 1:-1] ** 2).sum(1) - s[:, -1])
                found.append((np.repeat(docs, count), start, start + b - a, raw))
            before = length
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def score(self, hashes: np.ndarray) -> float:
        """Raw score of a text: its best window; minus infinity without words."""
        return float(self.score_all([hashes])[0])

    def score_all(self, texts: list[np.ndarray]) -> np.ndarray:
        """Raw scores of many texts."""
        best = np.full(len(texts), -np.inf)
        doc, _, _, raw = self.windows(texts)
        np.maximum.at(best, doc, raw)
        return best

    def foremost(self, texts: list[np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, start, end and raw score of the best ``count`` windows of every text, by text, best first."""
        parts, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < GROUP_WORDS):
                size += len(texts[to])
                to += 1
            doc, a, b, raw = self.windows(texts[at:to])
            order = np.lexsort((b, a, -raw, doc))
            top = order[np.arange(len(order)) - np.searchsorted(doc[order], doc[order]) < count]
            parts.append((at + doc[top], a[top], b[top], raw[top]))
            at = to
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Raw scores of rows of padded buckets."""
        v = self.v[x]
        s = v.sum(1)
        return self.bias + self.w[x].sum(1) + 0.5 * ((s * s).sum(1) - (v * v).sum((1, 2)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, seed: int, rate: float = 0.08, decay: float = 2e-4) -> None:
        """Logistic loss, AdaGrad over mini-batches; weight and vector of a bucket stand side by side."""
        rng = np.random.default_rng(seed)
        both = np.zeros((BUCKETS + 1, 1 + RANK), np.float32)
        both[:-1, 1:] = rng.normal(0, 0.02, (BUCKETS, RANK))
        squares, gb, self.bias, self._table = np.full_like(both, 0.1), 0.1, -2.0, None
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                xb = x[rows]
                p = both[xb]
                s = p.sum(1)
                raw = self.bias + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(1) - (p[:, :, 1:] ** 2).sum((1, 2)))
                g = ((_logistic(raw) - y[rows]) * weight[rows] / len(rows) * 16).astype(np.float32)
                p[:, :, 1:] -= s[:, None, 1:]
                p[:, :, 0] = -1
                p *= -g[:, None, None]  # now the gradients
                flat = xb.ravel()
                by_bucket = np.argsort(flat, kind="stable")
                sorted_flat = flat[by_bucket]
                starts = np.flatnonzero(np.concatenate([[True], sorted_flat[1:] != sorted_flat[:-1]]))
                if sorted_flat[-1] == BUCKETS:  # padding stays 0
                    by_bucket, starts = by_bucket[: starts[-1]], starts[:-1]
                uniq = flat[by_bucket][starts]
                d = np.add.reduceat(p.reshape(-1, 1 + RANK)[by_bucket], starts, axis=0) + decay * both[uniq]
                squares[uniq] += d * d
                both[uniq] -= rate * d / np.sqrt(squares[uniq])
                db = float(g.sum())
                gb += db * db
                self.bias -= rate * db / gb**0.5
        self.w, self.v = both[:, 0].copy(), both[:, 1:].copy()

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, b=self.bias, w=self.w.astype(np.float16), v=self.v.astype(np.float16), t=self.threshold)
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> FactorizationMachine:
        with np.load(io.BytesIO(raw)) as z:
            return cls(float(z["b"]), z["w"].astype(np.float32), z["v"].astype(np.float32), float(z["t"]))


def _padded(streams: list[np.ndarray], doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of padded buckets of the given windows."""
    longest = WINDOWS[-1][0]
    base = np.cumsum([0, *map(len, streams)])
    flat = np.concatenate(streams)
    one, two = buckets(flat)
    at = (base[doc] + a)[:, None] + np.arange(longest)
    end = (base[doc] + b)[:, None]
    first = np.where(at < end, one[np.minimum(at, len(one) - 1)], BUCKETS)
    second = np.where(at < end - 1, np.append(two, BUCKETS)[np.minimum(at, len(two))], BUCKETS)
    return np.concatenate([first, second[:, :-1]], axis=1)


def train(texts: list[str], labels: np.ndarray, seed: int = 5, rounds: int = 3) -> FactorizationMachine:
    """Fit on documents with 0/1 labels, alternating with the choice of the windows that explain positive labels.

    Some labels are wrong, so from the second round on a target is partly what the machine of the round before says of the window.
    """
    machine, vocabulary = FactorizationMachine(), WordHashes()
    streams = [vocabulary.of(words_of(t)) for t in texts]
    rng = np.random.default_rng(seed)
    usable = np.array([k for k in rng.permutation(len(streams)).tolist() if len(streams[k])], np.int64)
    held, rest = usable[::10], np.delete(usable, np.s_[::10])
    pos, neg = ([streams[k] for k in rest if labels[k] == y] for y in (1, 0))
    if not pos or not neg:
        machine.threshold = np.inf
        return machine
    # first choice: terms that many positive and few negative documents hold
    counts = np.zeros((2, BUCKETS + 1))
    for c, docs in enumerate((neg, pos)):
        for stream in docs:
            counts[c, np.unique(np.concatenate(buckets(stream)))] += 1
    odds = np.log((counts[1] + 0.5) / (len(pos) + 1)) - np.log((counts[0] + 0.5) / (len(neg) + 1))
    machine.set_weights((np.maximum(odds, 0) * counts[1] / (counts[1] + 2)).astype(np.float32))  # little weight for what few hold
    doc, a, b = [], [], []
    for k, stream in enumerate(neg):  # some windows of every negative document
        lo, hi = spans(len(stream))
        pick = rng.choice(len(lo), min(len(lo), PLAIN_WINDOWS), replace=False)
        doc, a, b = [*doc, np.full(len(pick), k)], [*a, lo[pick]], [*b, hi[pick]]
    plain = _padded(neg, *map(np.concatenate, (doc, a, b)))
    hard: list[np.ndarray] = []
    doubt: list[np.ndarray] = []
    for r in range(rounds):
        doc, a, b, raw = machine.foremost(pos, 3 if r else 1)
        near = raw >= np.maximum.reduceat(raw, np.searchsorted(doc, np.arange(len(pos))))[doc] - 1.0
        doc, a, b, raw = doc[near], a[near], b[near], raw[near]
        chosen, share = _padded(pos, doc, a, b), 2 / np.bincount(doc, minlength=len(pos))[doc]
        target = TRUST + (1 - TRUST) * _logistic(raw) if r > 1 else np.ones(len(raw))
        if r:  # the windows of negative documents that look worst
            worst = machine.foremost(neg, 2)
            hard.append(_padded(neg, *worst[:3]))
            doubt.append((1 - TRUST) * _logistic(worst[3]) if r > 1 else np.zeros(len(worst[3])))
        x = np.concatenate([chosen, plain, *hard])
        y = np.concatenate([target, np.zeros(len(plain)), *doubt])
        machine.fit(x, y, np.concatenate([share, np.ones(len(x) - len(chosen))]), EPOCHS, seed + r)
    machine.threshold = _threshold(machine, [streams[k] for k in held], labels[held])
    return machine


def _logistic(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _threshold(machine: FactorizationMachine, streams: list[np.ndarray], labels: np.ndarray) -> float:
    """Raw score of best F1 on held-out documents, negatives counting fourfold as labels are richer in positives than the corpus.

    To the held-out positives PRIOR expected ones are added, with logistic scores around 1, and a negative counts by how near it
    comes to the cut, so that the rule is one for few and many labels. Of equally good cuts the one nearest to -0.5 is taken.
    """
    s = machine.score_all(streams)
    cuts = np.linspace(-2.5, 2.5, 51)
    hit = np.array([((s >= c) & (labels == 1)).sum() for c in cuts]) + PRIOR * _logistic(1.0 - cuts)
    wrong = np.array([_logistic(2 * (s[labels == 0] - c)).sum() for c in cuts])
    f1 = 2 * hit / (hit + 4 * wrong + labels.sum() + PRIOR)
    best = cuts[f1 >= f1.max() - 1e-12]
    return float(best[np.abs(best + 0.5).argmin()])


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """``(text, label)`` of at most MAX_LABELLED documents of each class, chosen by hash."""
    agreed = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc"))
    agreed = agreed.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("hi")).where("label = hi").drop("hi")
    some = lambda c: agreed.where(F.col("label") == c).orderBy(F.xxhash64("doc"), "doc").limit(MAX_LABELLED)
    chosen = F.broadcast(some(0).unionByName(some(1)))  # at most 2 * MAX_LABELLED rows, so the texts are not shuffled
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return texts.join(chosen, "doc").dropDuplicates(["doc"]).select("doc", "text", "label")


def fit_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> bytes:
    """The packed machine, trained in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc": [], "text": [], "label": []}), *batches]).sort_values("doc")  # at most 2 * MAX_LABELLED rows
        yield pd.DataFrame({"model": [train(rows["text"].tolist(), rows["label"].to_numpy(np.float64)).dumps()]})

    return bytes(labelled_sample(docs, labels, doc_id, text, label).coalesce(1).mapInPandas(run, "model binary").collect()[0]["model"])


def score_documents(docs: DataFrame, packed: bytes, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, score, flagged)`` for every row."""
    model = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, vocabulary = FactorizationMachine.loads(model.value), WordHashes()
        for batch in batches:
            raw, group, size = [np.empty(0)], [], 0
            for text in batch["_text"]:
                group.append(vocabulary.of(words_of(text)))
                size += len(group[-1])
                if size >= GROUP_WORDS:
                    raw.append(machine.score_all(group))
                    group, size = [], 0
            raw = np.concatenate([*raw, machine.score_all(group)])
            with np.errstate(over="ignore"):
                yield batch.drop(columns="_text").assign(score=np.round(1 / (1 + np.exp(machine.threshold - raw)), 6), flagged=raw >= machine.threshold) if np.isfinite(
                    machine.threshold
                ) else batch.drop(columns="_text").assign(score=0.0, flagged=False)

    narrow = spread(docs.select(doc_id, *keep, F.col(text).alias("_text")), 2)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "_text")
    return narrow.mapInPandas(run, f"{schema}, score double, flagged boolean")
