"""Exact nearest neighbours of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewell.functions import vectors

#: Query vectors broadcast at once; larger query sets are answered in slices, each one pass over the items.
SLICE = 2000


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row becomes NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def knn(items: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """``(query_id, id, distance, score, place)``: the k items ``(id, vector)`` of least cosine distance per query
    ``(query_id, vector)``, equal distances by id.

    A zero vector has distance NaN and stands last. Items and queries that are NULL, of a wrong length or hold NULLs take no
    part. The stated query set is broadcast in slices of counted size; each Arrow batch of items is one matrix product, and
    only its k best rows per query leave the task.
    """
    spark = items.sparkSession
    whole = (F.size("vector") == dim) & F.forall("vector", lambda x: x.isNotNull())
    held = items.where(whole).select("id", vectors.as_double(F.col("vector")).alias("v"))
    asked = queries.where(whole).select("query_id", vectors.as_double(F.col("vector")).alias("q"))
    slices = max(1, -(-asked.count() // SLICE))
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((asked, "query_id"), (held, "id"))]
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    result = None
    for s in range(slices):
        part = asked if slices == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s)
        rows = part.collect()  # some SLICE rows
        ids = np.array([r["query_id"] for r in rows])
        shared = spark.sparkContext.broadcast((ids, _unit(np.array([r["q"] for r in rows], np.float64).reshape(len(rows), dim))))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for b in batches:
                if not len(b) or not len(ids):
                    continue
                b = b.sort_values("id", kind="stable")
                distance = np.round(1.0 - q @ _unit(np.stack(b["v"].to_numpy())).T, 9)
                near = np.argsort(distance, axis=1, kind="stable")[:, :k]  # NaN last, equal distances in id order
                n = near.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(ids, n), "id": b["id"].to_numpy()[near.ravel()], "distance": np.take_along_axis(distance, near, 1).ravel() + 0.0})

        near = held.mapInPandas(run, f"{kinds[0]}, {kinds[1]}, distance double")
        near = near.withColumn("distance", F.coalesce("distance", F.lit(float("nan"))))  # on its way from pandas NaN became NULL
        top = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
        result = top if result is None else result.unionByName(top)
    return result.select("query_id", "id", "distance", vectors.similarity(F.col("distance")).alias("score"), "place")
