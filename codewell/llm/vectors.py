"""Usable vectors, one per item, in a compact sparse form without loss, and groups of equal ones.

A packed vector is one byte for its form, the gaps between its non-zero positions in one byte each (two if a gap is above
255), then the values in one byte each where all are whole numbers up to 255, else as floats, or doubles where floats would
lose digits. A histogram of small counts takes two bytes an entry, so shuffles carry a fifth of what plain sparse rows take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codewell.runtime import broadcast_within

#: Types of gaps and of values; a form is 3 * gap type + value type.
GAPS, VALUES = ("<u1", "<u2"), ("<u1", "<f4", "<f8")
#: Salts of a look-up by a vector that very many items may share.
SALTS = 32


def pack_rows(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int) -> list[bytes]:
    """Packed form of n vectors given by row number (ascending), position and value of their entries; each has at least one."""
    counts = np.bincount(rows, minlength=n)
    starts = np.cumsum(counts) - counts
    gaps = np.diff(cols, prepend=0)
    gaps[starts] = cols[starts]
    with np.errstate(over="ignore", invalid="ignore"):
        whole = (vals >= 0) & (vals <= 255) & (vals == np.floor(vals))
        kind = np.where(np.logical_and.reduceat(whole, starts), 0, np.where(np.logical_and.reduceat(vals.astype("<f4") == vals, starts), 1, 2))
    form = 3 * (np.maximum.reduceat(gaps, starts) > 255) + kind
    out: list[bytes] = [b""] * n
    for f in np.unique(form).tolist():
        g, v = GAPS[f // 3], VALUES[f % 3]
        mine = np.repeat(form == f, counts)
        gap, val, head = gaps[mine].astype(g).tobytes(), vals[mine].astype(v).tobytes(), bytes([f])
        gw, vw, at = int(g[-1]), int(v[-1]), 0
        for r in np.flatnonzero(form == f).tolist():
            c = int(counts[r])
            out[r] = head + gap[at * gw : (at + c) * gw] + val[at * vw : (at + c) * vw]
            at += c
    return out


def pack_usable(df: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """``(id, packed)`` of the rows with an id and a usable vector: ``dim`` values, none NULL, NaN or infinite, not all 0.

    The vectors reach Python in the width in which they are stored and leave it packed.
    """
    if not 0 < dim <= 65536:
        raise ValueError("positions are packed in 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            x = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(len(batch), dim)  # NULL becomes NaN
            usable = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
            x = x[usable]
            rows, cols = np.nonzero(x)
            packed = pack_rows(rows, cols, x[rows, cols].astype(np.float64), len(x)) if len(x) else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(usable)), pa.array(packed, pa.binary())], ["id", "packed"])

    narrow = df.where(F.col(ident).isNotNull() & (F.size(vector) == dim)).select(F.col(ident).cast("string").alias("id"), F.col(vector).alias("v"))
    return narrow.mapInArrow(pack, "id string, packed binary")


def one_per_item(*packed: DataFrame) -> DataFrame:
    """Union with each id once; should an id have different vectors, the smallest packed form holds."""
    whole = packed[0]
    for p in packed[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("id").agg(F.min("packed").alias("packed"))


def unpack(packed: pd.Series | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, position and value of every non-zero entry."""
    packed = list(packed)
    n = len(packed)
    form = np.fromiter((p[0] for p in packed), np.int64, n)
    length = np.fromiter(map(len, packed), np.int64, n) - 1
    parts = []
    for f in np.unique(form).tolist():
        g, v = GAPS[f // 3], VALUES[f % 3]
        gw, vw = int(g[-1]), int(v[-1])
        mine = np.flatnonzero(form == f)
        counts = length[mine] // (gw + vw)
        ends = (1 + gw * counts).tolist()
        mine_bytes = packed if len(mine) == n else [packed[r] for r in mine.tolist()]
        gaps = np.frombuffer(b"".join([p[1:e] for p, e in zip(mine_bytes, ends, strict=True)]), g)
        vals = np.frombuffer(b"".join([p[e:] for p, e in zip(mine_bytes, ends, strict=True)]), v).astype(np.float64)
        starts = np.cumsum(counts) - counts
        total = np.cumsum(gaps, dtype=np.int64)
        cols = total - np.repeat(total[starts] - gaps[starts], counts)
        parts.append((np.repeat(mine, counts), cols, vals))
    if len(parts) == 1:
        return parts[0]
    rows, cols, vals = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], vals[order].astype(np.float64)


def unit_rows(packed: pd.Series | list[bytes], dim: int, dtype: str = "float64") -> np.ndarray:
    """Dense rows of length 1."""
    rows, cols, vals = unpack(packed)
    norm = np.sqrt(np.bincount(rows, vals * vals, minlength=len(packed)))
    out = np.zeros((len(packed), dim), dtype)
    out[rows, cols] = vals / norm[rows]
    return out


def copies(packed: DataFrame, first: int) -> DataFrame:
    """``(id, rep, firsts)`` of every item whose vector other items have, too: the smallest id among them and the ``first``
    smallest. Items with a vector of their own are left out.

    Only hashes are shuffled to find repeated vectors. Ranked windows are limited before their shuffle and the look-up is
    salted, so a vector that a third of all items share gives no large task.
    """
    hashed = packed.withColumn("_h", F.xxhash64("packed"))
    shared = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_h")
    rows = hashed.join(broadcast_within(shared, 100_000), "_h", "left_semi").drop("_h")
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy("packed").orderBy("id"))).where(F.col("_r") <= first)
    heads = few.groupBy("packed").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("firsts")).where(F.size("firsts") > 1)
    salted = heads.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["packed", "_s"]).select("id", "rep", "firsts")
