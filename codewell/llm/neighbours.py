"""Most similar vectors for every vector: inverted file with product-quantised residuals and exact reranking.

A bounded sample of ``TRAIN`` vectors, chosen by hash, trains coarse directions and, on the residuals, one small codebook per
sub-space. The number of lists follows the number of vectors, ``LIST`` members each on average: up to ``TOP`` directions of
their own, beyond that each direction is refined by up to ``SUB`` shared offsets, so that the model stays small while there
can be TOP * SUB lists. A vector x in the list of direction e is u * e plus a residual, u being their inner product; the
residual is kept as one code per sub-space.

Every vector asks its own list first. It then asks those of the ``probes`` foremost lists that can hold a better one: with
a and u the inner products of query and member with e, their similarity is at most a*u + sqrt(1-a*a) * sqrt(1-u*u), and hardly
ever above the same with ``REACH`` before the second term. Members are kept in two rings, near and far by u, and asked by ring.
A list is answered by asymmetric distance tables (inner products of the query's sub-vectors with all codewords); the foremost
``rerank`` members, and all others that the tables' measured error may hide behind the k-th best, are reranked by the exact
cosine in double precision, rounded to 6 digits, ties by the smaller id.

Lists are cut into blocks of members and of queries by their counted sizes, so a list that owns a third of all rows becomes many
tasks of bounded size. Of equal vectors only the k + 1 smallest ids are indexed, which are enough for every query; the others
have k of those as their neighbours and ask nothing. What is broadcast are the directions, offsets and codebooks, whose size
does not grow with the data.

Defined results: unusable vectors (NULL, wrong length, NaN, infinite, all zero) and NULL ids take no part; an id counts once;
fewer than k others give as many as there are; equal vectors are neighbours of similarity 1; an empty table gives an empty
frame.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewell.llm.vectors import copies, unit_rows, unpack
from codewell.runtime import broadcast_within, cut, keep

#: Training sample, members of a list on average, directions, offsets of each, and members or queries in a block.
TRAIN, LIST, TOP, SUB, BLOCK = 10_000, 200, 1024, 4096, 2000
#: Members within so many standard errors of the tables below the k-th best are reranked, too.
MARGIN = 2.5
#: Inner product with the direction that parts near members from far ones, and the reach of residuals (1 makes the bound exact).
NEAR, REACH = 0.6, 0.9
_ANSWER = "id string, other string, similarity double"
_MIXED = ("id", "other", "similarity", "packed", "list", "ring")


def kmeans(points: np.ndarray, k: int, rounds: int, seed: int, directions: bool = False) -> np.ndarray:
    """Lloyd's algorithm; a centroid left empty takes the place of a random point. ``directions`` are kept at length 1."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centroids = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = (points @ centroids.T).argmax(1) if directions else nearest(points, centroids)
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=k)
        filled = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[filled]
        centroids[filled] = np.add.reduceat(points[order], starts, axis=0) / counts[filled, None]
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = points[rng.choice(len(points), len(empty))]
        if directions:
            centroids /= np.maximum(np.sqrt((centroids * centroids).sum(1, keepdims=True)), 1e-12)
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid."""
    return ((centroids * centroids).sum(1) - 2 * points @ centroids.T).argmin(1)


class Quantizer:
    """Directions, their offsets, residual codebooks (sub-spaces, 256, width), and the spread of the tables' error for a code that
    loses a vector of length 1."""

    def __init__(self, top: np.ndarray, sub: np.ndarray, books: np.ndarray, error: float = 0.0):
        self.top, self.sub, self.books, self.error = top, sub, books, error
        self.scale = 1 / np.sqrt(np.maximum(1 + 2 * top @ sub.T + (sub * sub).sum(1), 1e-12))  # of direction plus offset

    @classmethod
    def train(cls, x: np.ndarray, lists: int, parts: int) -> Quantizer:
        top = kmeans(x, min(lists, TOP), 4, 1, directions=True)
        near = (x @ top.T).argmax(1)
        offsets = min(SUB, -(-lists // len(top)), max(1, len(x) // 4))
        sub = kmeans(x - top[near], offsets, 4, 2) if offsets > 1 else np.zeros((1, x.shape[1]), x.dtype)
        model = cls(top, sub, np.zeros((parts, 1, x.shape[1] // parts), x.dtype))
        own, u = model.own(x)
        residual = x - u[:, None] * model.direction(own)
        width, half = x.shape[1] // parts, residual[: max(256, len(x) // 2)]
        model.books = np.stack([kmeans(half[:, m * width : (m + 1) * width], 256, 4, m) for m in range(parts)])
        order = np.argsort(own, kind="stable")  # neighbours in this order mostly share a list
        a, b = order[:-1], order[1:]
        lost = residual[b] - model.decode(model.codes(x[b], own[b], u[b])[0])
        model.error = float(np.std((x[a] * lost).sum(1) / np.maximum(np.sqrt((lost * lost).sum(1)), 1e-6))) if len(a) else 0.0
        return model

    def direction(self, lists: np.ndarray) -> np.ndarray:
        """Unit directions of lists."""
        t, s = np.divmod(lists, len(self.sub))
        return (self.top[t] + self.sub[s]) * self.scale[t, s][:, None]

    def foremost(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists of greatest inner product, best first, and these products; lists of as many foremost directions are seen, of
        four at least."""
        inner = x @ self.top.T
        if len(self.sub) == 1:
            lists, score = np.broadcast_to(np.arange(len(self.top)), inner.shape), inner
        else:
            t = np.argsort(-inner, axis=1)[:, : max(4, probes)]  # else a garment whose pictures share more directions is cut off
            score = ((np.take_along_axis(inner, t, 1)[:, :, None] + (x @ self.sub.T)[:, None, :]) * self.scale[t]).reshape(len(x), -1)
            lists = (t[:, :, None] * len(self.sub) + np.arange(len(self.sub))).reshape(len(x), -1)
        if probes < score.shape[1]:
            few = np.argpartition(-score, probes, axis=1)[:, :probes]
            lists, score = np.take_along_axis(lists, few, 1), np.take_along_axis(score, few, 1)
        order = np.lexsort((lists, -score), axis=1)
        return np.take_along_axis(lists, order, 1), np.take_along_axis(score, order, 1)

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list and its inner product with the direction."""
        step = max(1, 4_000_000 // (4 * len(self.sub) + len(self.top)))
        found = [self.foremost(x[a : a + step], 1) for a in range(0, len(x), step)]
        return np.concatenate([f[0][:, 0] for f in found]), np.concatenate([f[1][:, 0] for f in found])

    def codes(self, x: np.ndarray, lists: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The residuals' codes and the lengths of what they lose."""
        residual, width = x - u[:, None] * self.direction(lists), self.books.shape[2]
        codes = np.stack([nearest(residual[:, m * width : (m + 1) * width], b) for m, b in enumerate(self.books)], 1).astype(np.uint8)
        lost = residual - self.decode(codes)
        return codes, np.sqrt((lost * lost).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that the codes stand for."""
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)

    def tables(self, q: np.ndarray) -> Iterator[np.ndarray]:
        """Per sub-space (codewords, queries): inner products of all codewords with the queries' sub-vectors."""
        width = self.books.shape[2]
        for m, book in enumerate(self.books):
            yield book @ q[:, m * width : (m + 1) * width].T

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, t=self.top, s=self.sub, b=self.books, e=self.error)
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Quantizer:
        with np.load(io.BytesIO(raw)) as z:
            return cls(z["t"], z["s"], z["b"], float(z["e"]))


_LOADED: dict[int, Quantizer] = {}


def loaded(raw: bytes) -> Quantizer:
    """The worker's model; a Python process serves many groups and unpacks it once."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Quantizer.loads(raw)
    return _LOADED[key]


def _best(model: Quantizer, members: pd.DataFrame, queries: pd.DataFrame, list_no: int, dim: int, k: int, rerank: int, least: float) -> tuple[np.ndarray, ...]:
    """Query row, member row and similarity of the k best members ``(id, packed, code, u, lost)`` of one block for each query."""
    ids, asked, n = members["id"].to_numpy(), queries["id"].to_numpy(), len(members)
    own = pd.Index(ids).get_indexer(asked)  # a query's own place, or -1
    codes = np.ascontiguousarray(np.frombuffer(b"".join(members["code"]), np.uint8).reshape(n, -1).T)
    rows, cols, vals = unpack(members["packed"])  # exact reranking reads the non-zero entries only
    counts = np.bincount(rows, minlength=n)
    width, at = int(counts.max()), np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    col, val = np.zeros((n, width), np.int64), np.zeros((n, width))
    col[rows, at], val[rows, at] = cols, vals
    val /= np.sqrt((val * val).sum(1))[:, None]
    u, direction = members["u"].to_numpy(np.float32), model.direction(np.array([list_no]))[0]
    order = np.argsort(ids, kind="stable")
    by_id = np.empty(n, np.int64)
    by_id[order] = np.arange(n)  # breaks ties
    out, room = [], np.empty((n, min(128, len(asked))), np.float32)
    # with fewer members than codewords the tables would be larger than the answers: only entries of the members' own codes are
    # made, for all sub-spaces in one product, which also adds them up
    decoded = model.decode(codes.T) if n < model.books.shape[1] else None

    dense: list[np.ndarray] = []

    def exact(q: np.ndarray, r: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Similarities of pairs, entry by entry; where the pairs fill a quarter of their rows and columns, as one product of these."""
        (rows, at), (cols, to) = np.unique(r, return_inverse=True), np.unique(m, return_inverse=True)
        if len(rows) * len(cols) <= 4 * len(r):
            if not dense:
                dense.append(unit_rows(members["packed"], dim))
            return np.round((q[rows] @ dense[0][cols].T)[at, to], 6)
        value = np.empty(len(r))
        for s in range(0, len(r), 20_000):
            p = slice(s, s + 20_000)
            value[p] = np.einsum("pw,pw->p", q[r[p][:, None], col[m[p]]], val[m[p]])
        return np.round(value, 6)

    # What a code loses, the tables cannot see: of a member of similarity t on average t * lost^2, give or take the measured error.
    lost = members["lost"].to_numpy(np.float32)
    spread, square = MARGIN * model.error * lost, lost * lost
    for a in range(0, len(asked), 128):
        q, mine = unit_rows(queries["packed"].iloc[a : a + 128], dim), own[a : a + 128]
        single = q.astype(np.float32)
        sums = u[:, None] * (single @ direction)
        if decoded is not None:
            sums += decoded @ single.T
        else:
            entries = room[:, : len(q)] if len(q) == room.shape[1] else np.empty((n, len(q)), np.float32)
            for code, table in zip(codes, model.tables(single), strict=True):
                sums += np.take(table, code, axis=0, out=entries, mode="clip")  # whole rows of the table
        score = np.ascontiguousarray(sums.T) + spread
        inside = np.flatnonzero(mine >= 0)
        score[inside, mine[inside]] = -np.inf
        few = np.argpartition(-score, rerank, axis=1)[:, :rerank] if rerank < n else np.broadcast_to(np.arange(n), (len(q), n))
        hopeful = lambda goal: score + np.maximum(goal, 0) * square >= goal
        r, m = np.nonzero(np.take_along_axis(hopeful(np.float32(least)), few, 1))
        m = few[r, m]
        value = exact(q, r, m)
        # all that the error of the tables may hide behind the k-th best of these
        first = np.full((len(q), k), -np.inf)
        rank = np.lexsort((-value, r))
        place = np.arange(len(r)) - np.searchsorted(r[rank], r[rank])
        top = place < k
        first[r[rank][top], place[top]] = value[rank][top]
        more = hopeful(np.maximum(first[:, -1:], least).astype(np.float32))
        more[np.isneginf(score)] = False
        more[r, m] = False
        r2, m2 = np.nonzero(more)
        r, m, value = np.concatenate([r, r2]), np.concatenate([m, m2]), np.concatenate([value, exact(q, r2, m2)])
        wanted = value >= least
        r, m, value = r[wanted], m[wanted], value[wanted]
        rank = np.lexsort((by_id[m], -value, r))
        r, m, value = r[rank], m[rank], value[rank]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((a + r[top], m[top], value[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bound(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Largest a*u + REACH * sqrt(1-a*a) * sqrt(1-u*u) for low <= u <= high."""
    side = REACH * np.sqrt(np.maximum(0, 1 - a * a))
    u = np.clip(a / np.maximum(np.sqrt(a * a + side * side), 1e-12), low, high)
    return a * u + side * np.sqrt(1 - u * u)


def nearest_neighbours(packed: DataFrame, dim: int, k: int = 5, parts: int = 100, probes: int = 24, rerank: int = 20, least: float = -1.0) -> DataFrame:
    """``(id, other, similarity, rank)``: the k most similar others of every vector of ``(id, packed)``, those of a similarity
    of at least ``least``, which also bounds what is searched."""
    spark = packed.sparkSession
    held = [keep(packed)]
    try:
        n = held[0].count()
        twins = cut(copies(held[0], k + 1))
        spare = twins.where(~F.array_contains("firsts", F.col("id")))
        base = held[0].join(spare.select("id"), "id", "left_anti") if twins.limit(1).count() else held[0]
        parts = next(p for p in range(min(parts, dim), 0, -1) if dim % p == 0)
        model = _trained(base, n, dim, parts)
        if model is None:
            return spark.createDataFrame([], f"{_ANSWER}, rank int")
        indexed = cut(_index(base, model, dim))  # two short byte strings a vector; what follows is planned without what was before
        first = keep(_ask_own(indexed, model, dim, k, probes, rerank, least))
        held.append(first)
        second = _ask_others(indexed, first.where("list >= 0").select("id", "packed", "list", "ring"), model, dim, k, rerank, least)
        same = spare.select("id", F.explode(F.slice("firsts", 1, k)).alias("other"), F.lit(1.0).alias("similarity"))
        found = first.where("list < 0").select("id", "other", "similarity").unionByName(second).unionByName(same)
        # at most k rows per id, list and block
        ranked = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "other"))), 1, k).alias("top"))
        ranked = cut(ranked)
    finally:
        for df in held:
            df.unpersist()
    return ranked.select("id", F.posexplode("top").alias("rank", "t")).select("id", F.col("t.other").alias("other"), (-F.col("t.s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def _trained(packed: DataFrame, n: int, dim: int, parts: int):
    """The broadcast model, trained in one task on the TRAIN vectors of smallest hash; None without vectors."""
    lists = max(1, n // LIST)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat([pd.DataFrame({"id": [], "packed": []}), *batches]).sort_values("id")  # at most TRAIN rows
        if len(sample):
            yield pd.DataFrame({"model": [Quantizer.train(unit_rows(sample["packed"], dim, "float32"), lists, parts).dumps()]})

    part = min(1.0, 2 * TRAIN / max(1, n))  # so that no task sends or sorts more than the sample needs
    hashed = packed.withColumn("_h", F.xxhash64("id")).where(F.pmod("_h", F.lit(1 << 30)) < int(part * (1 << 30)) + 1)
    rows = hashed.orderBy("_h", "id").limit(TRAIN).coalesce(1).mapInPandas(train, "model binary").collect()
    return packed.sparkSession.sparkContext.broadcast(bytes(rows[0]["model"])) if rows else None


def _index(packed: DataFrame, model, dim: int) -> DataFrame:
    """``(id, packed, code, list, u, lost, ring)`` of every vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantizer = loaded(model.value)
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.iloc[a : a + 2000]
                x = unit_rows(part["packed"], dim, "float32")
                lists, u = quantizer.own(x)
                codes, lost = quantizer.codes(x, lists, u)
                yield part[["id", "packed"]].assign(code=[c.tobytes() for c in codes], list=lists, u=u, lost=lost, ring=(u < NEAR).astype(np.int32))

    return packed.mapInPandas(run, "id string, packed binary, code binary, list long, u float, lost float, ring int")


def _blocks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with the number of blocks of their group: one but for groups counted to hold more than BLOCK rows."""
    large = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name)).where(F.col(name) > 1)
    return rows.join(broadcast_within(large, 100_000), keys, "left").withColumn(name, F.coalesce(name, F.lit(1)))


def _turn(count: str):
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def _own(count: str):
    return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")


def _ask_own(indexed: DataFrame, model, dim: int, k: int, probes: int, rerank: int, least: float) -> DataFrame:
    """Answers ``(id, other, similarity)`` of every vector's own list, and rows ``(id, packed, list, ring)`` of what else to ask;
    an answer has list -1.

    A row is member and query at once where block meets itself, else member for other blocks' queries and query of other
    blocks; a list of one block is shuffled once.
    """
    sized = _blocks(indexed.select("list", "id", "packed", "code", "u", "lost"), ["list"], "n").withColumn("own", _own("n"))
    sized = sized.withColumn("other", _turn("n"))
    column = lambda mb, qb, member, asks: [F.col("list"), F.col(mb).alias("mb"), F.col(qb).alias("qb"), "id", "packed", (F.col("code") if member else F.lit(None).cast("binary")).alias("code"), "u", "lost", F.lit(asks).alias("asks")]
    both = sized.where("other = own").select(*column("own", "own", True, True))
    member = sized.where("other <> own and n > 1").select(*column("own", "other", True, False))
    query = sized.where("other <> own and n > 1").select(*column("other", "own", False, True))

    def answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        quantizer, list_no = loaded(model.value), int(key[0])
        members = rows[rows["code"].notna()].reset_index(drop=True)
        queries = rows[rows["asks"]].reset_index(drop=True)
        if not len(members) or not len(queries):
            return pd.DataFrame(columns=list(_MIXED), dtype=object)
        r, m, value = _best(quantizer, members, queries, list_no, dim, k, rerank, least)
        ids, packed = queries["id"].to_numpy(), queries["packed"].to_numpy()
        out = [[ids[r]], [members["id"].to_numpy()[m]], [value], [np.full(len(r), None)], [np.full(len(r), -1)], [np.full(len(r), -1)]]
        if key[1] == key[2]:  # where its own block has answered, a query says what else to ask
            kth = np.full(len(queries), -1.0)
            last = np.flatnonzero(np.arange(len(r)) - np.searchsorted(r, r) == k - 1)
            kth[r[last]] = value[last]
            goal = np.maximum(kth, least)
            step = min(2000, max(1, 4_000_000 // (max(4, probes) * len(quantizer.sub) + len(quantizer.top))))
            for a in range(0, len(queries), step):
                lists, inner = quantizer.foremost(unit_rows(packed[a : a + step], dim, "float32"), probes)
                for ring, (low, high) in enumerate(((NEAR, 1.0), (-1.0, NEAR))):
                    q, place = np.nonzero((_bound(inner.astype(np.float64), low, high) >= goal[a : a + step, None]) & (lists != list_no))
                    for column, part in zip(out, (ids[a + q], np.full(len(q), None), np.full(len(q), np.nan), packed[a + q], lists[q, place], np.full(len(q), ring)), strict=True):
                        column.append(part)
        columns = [np.concatenate(c) for c in out]
        return pd.DataFrame(dict(zip(_MIXED, columns, strict=True)))

    rows = both.unionByName(member).unionByName(query)
    return rows.groupBy("list", "mb", "qb").applyInPandas(answer, f"{_ANSWER}, packed binary, list long, ring int")


def _ask_others(indexed: DataFrame, asked: DataFrame, model, dim: int, k: int, rerank: int, least: float) -> DataFrame:
    """Answers of the members of a list's ring to the queries that ask it; a group holds at most some BLOCK of each."""
    key = ["list", "ring"]
    members = _blocks(indexed.select(*key, "id", "packed", "code", "u", "lost"), key, "mn")
    queries = _blocks(asked, key, "qn")
    counts = lambda df, name: broadcast_within(df.where(F.col(name) > 1).select(*key, name).distinct(), 100_000)
    m = members.join(counts(queries, "qn"), key, "left").withColumn("mb", _own("mn")).withColumn("qn", F.coalesce("qn", F.lit(1))).withColumn("qb", _turn("qn"))
    q = queries.join(counts(members, "mn"), key, "left").withColumn("qb", _own("qn")).withColumn("mn", F.coalesce("mn", F.lit(1))).withColumn("mb", _turn("mn"))

    def answer(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["code"].isna()
        members, queries = rows[~asks].reset_index(drop=True), rows[asks].reset_index(drop=True)
        if not len(members) or not len(queries):
            return pd.DataFrame(columns=list(_MIXED[:3]), dtype=object)
        r, at, value = _best(loaded(model.value), members, queries, int(group[0]), dim, k, rerank, least)
        return pd.DataFrame({"id": queries["id"].to_numpy()[r], "other": members["id"].to_numpy()[at], "similarity": value})

    cols = [*key, "mb", "qb", "id", "packed"]
    rows = m.select(*cols, "code", "u", "lost").unionByName(q.select(*cols), allowMissingColumns=True)
    return rows.groupBy(*key, "mb", "qb").applyInPandas(answer, _ANSWER)
