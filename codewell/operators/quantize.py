"""Vector quantisation: nearest centroids, histograms, training of codebooks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A codebook is broadcast as a matrix; this bounds its numbers (64 MB).
MATRIX_NUMBERS = 8_000_000


def codebook_matrix(centroids: DataFrame) -> tuple[list[int], np.ndarray]:
    """Word ids and centroids in id order; refuses a codebook above MATRIX_NUMBERS numbers."""
    size = centroids.agg(F.sum(F.size("centroid")).alias("n")).first()["n"] or 0
    if size > MATRIX_NUMBERS:
        raise ValueError(f"a codebook of {size} numbers is too large to broadcast")
    rows = centroids.orderBy("word_id").collect()
    return [r["word_id"] for r in rows], np.array([r["centroid"] for r in rows], dtype=np.float64)


def assign(frames: DataFrame, centroids: DataFrame, vector: str = "vector", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, word_id, distance)``: nearest centroid of each vector, equal distances by smaller word id.

    One matrix product per Arrow batch against the broadcast codebook. NULL vectors give nothing; with an empty codebook the
    result is empty.
    """
    ids, matrix = codebook_matrix(centroids)
    fields = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    schema = "".join(f"`{k}` {fields[k]}, " for k in keep) + "word_id int, distance double"
    shared = frames.sparkSession.sparkContext.broadcast((np.array(ids), matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, c = shared.value
        for b in batches:
            if not len(b) or not len(words):
                continue
            x = np.stack(b["_v"].to_numpy()).astype(np.float64)
            d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
            near = np.round(d, 9).argmin(1)
            exact = np.sqrt(((x - c[near]) ** 2).sum(1))
            yield b.drop(columns="_v").assign(word_id=words[near], distance=exact)

    return frames.where(F.col(vector).isNotNull()).select(*keep, F.col(vector).cast("array<double>").alias("_v")).mapInPandas(run, schema)


def histogram(assigned: DataFrame, item: str = "item_id") -> DataFrame:
    """Sparse histogram ``(item, word_id, tf)``."""
    return assigned.groupBy(item, "word_id").agg(F.count(F.lit(1)).alias("tf"))


def dense_histogram(sparse: DataFrame, size: int, item: str = "item_id") -> DataFrame:
    """``(item, histogram)`` of ``size`` bins; words outside 0 .. size-1 are dropped."""
    inside = sparse.where((F.col("word_id") >= 0) & (F.col("word_id") < size))
    maps = inside.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("word_id", F.col("tf").cast("double")))).alias("_m"))
    bins: Column = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    return maps.select(item, bins.alias("histogram"))


def fit_kmeans(frames: DataFrame, k: int, seed: int = 42, rounds: int = 20, vector: str = "vector") -> DataFrame:
    """``(word_id, centroid)`` by distributed k-means over all vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = frames.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, initMode="k-means||").fit(data)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return frames.sparkSession.createDataFrame(rows, "word_id int, centroid array<double>")


def batch_sums(batch: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the rows nearest to each centroid."""
    near = ((centroids**2).sum(1) - 2 * batch @ centroids.T).argmin(1)
    sums = np.zeros_like(centroids)
    np.add.at(sums, near, batch)
    return sums, np.bincount(near, minlength=len(centroids))


def fit_minibatch(frames: DataFrame, k: int, batches: int = 20, seed: int = 42, vector: str = "vector") -> DataFrame:
    """``(word_id, centroid)`` by mini-batch k-means over a table: its rows are dealt into ``batches`` by hash, each of which is
    one distributed pass that sends k sums a task.

    NULL vectors and those with NULL, NaN or infinity are left out; with fewer than k vectors the result is empty.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = frames.where(F.col(vector).isNotNull() & finite).select(F.col(vector).cast("array<double>").alias("v")).withColumn("h", F.xxhash64("v"))
    first = rows.orderBy(F.pmod("h", F.lit(1_000_003)), "h").limit(k).collect()  # a codebook's size
    spark, kinds = frames.sparkSession, "word_id int, centroid array<double>"
    if len(first) < k:
        return spark.createDataFrame([], kinds)
    model = MiniBatchKMeans(k, seed)
    model.centroids = np.array([r["v"] for r in first], np.float64)
    for b in range(batches):
        centroids = spark.sparkContext.broadcast(model.centroids)

        def run(parts: Iterator[pd.DataFrame], centroids=centroids) -> Iterator[pd.DataFrame]:
            sums, counts = np.zeros_like(centroids.value), np.zeros(k, np.int64)
            for p in parts:
                if len(p):
                    s, c = batch_sums(np.stack(p["v"].to_numpy()), centroids.value)
                    sums, counts = sums + s, counts + c
            hit = np.flatnonzero(counts)
            yield pd.DataFrame({"w": hit, "n": counts[hit], "s": list(sums[hit])})

        part = rows.where(F.pmod("h", F.lit(batches)) == b).select("v").mapInPandas(run, "w int, n long, s array<double>")
        total = part.groupBy("w").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(model.centroids.shape[1])]).collect()
        sums, counts = np.zeros_like(model.centroids), np.zeros(k, np.int64)
        for row in total:
            counts[row["w"]], sums[row["w"]] = row["n"], row[2:]
        model.update(sums, counts)
        centroids.unpersist()
    return spark.createDataFrame(model.rows(), kinds)


class MiniBatchKMeans:
    """Incremental codebook training: each batch pulls its nearest centroids by a step of one over their counts."""

    def __init__(self, k: int, seed: int = 42):
        self.k, self.rng = k, np.random.default_rng(seed)
        self.centroids: np.ndarray | None = None
        self.counts = np.zeros(k)

    def partial_fit(self, batch: np.ndarray) -> MiniBatchKMeans:
        """Learn from one batch; the first needs at least k rows. Rows with NaN or infinity are left out."""
        batch = np.asarray(batch, np.float64)
        batch = batch[np.isfinite(batch).all(1)] if len(batch) else batch
        if self.centroids is None:
            if len(batch) < self.k:
                raise ValueError("the first batch needs at least k rows")
            self.centroids = batch[self.rng.choice(len(batch), self.k, replace=False)].copy()
        if not len(batch):
            return self
        return self.update(*batch_sums(batch, self.centroids))

    def update(self, sums: np.ndarray, counts: np.ndarray) -> MiniBatchKMeans:
        """Learn from the sums and counts of a batch by nearest centroid."""
        self.counts += counts
        hit = counts > 0
        self.centroids[hit] += (sums[hit] - counts[hit, None] * self.centroids[hit]) / self.counts[hit, None]
        return self

    def rows(self) -> list[tuple[int, list[float]]]:
        """``(word_id, centroid)``."""
        return [] if self.centroids is None else [(i, c.tolist()) for i, c in enumerate(self.centroids)]
