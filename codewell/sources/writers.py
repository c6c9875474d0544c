"""Sinks: full refresh, append, insert-if-absent, term-sorted index files, JSON lines, matrices."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codewell.runtime import parallelism


def refresh(df: DataFrame, path: str, max_rows_per_file: int = 5_000_000) -> None:
    """Replace the relation; readers see the old files until the commit."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows."""
    df.write.mode("append").parquet(path)


def write_index(packed: DataFrame, path: str) -> None:
    """Packed postings in term order: range-partitioned and sorted, so row-group statistics answer term look-ups."""
    ordered = packed.repartitionByRange(parallelism(packed.sparkSession), "term").sortWithinPartitions("term")
    ordered.write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Export as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_image_lines(images: DataFrame, path: str) -> None:
    """Picture lines ``(nombre_archivo, ruta_original, histograma)``; relative paths are made absolute from the driver's folder."""
    absolute = F.regexp_replace(F.col("ruta_original"), r"^(?![/\\]|[A-Za-z]:|[a-z][a-z0-9+.-]*:/)", os.getcwd().replace("\\", "\\\\").replace("$", "\\$") + "/")
    write_json_lines(images.select("nombre_archivo", absolute.alias("ruta_original"), "histograma"), path)


def insert_if_absent(df: DataFrame, path: str, key: str, order: str) -> dict[str, int]:
    """Append the rows whose key the relation lacks, the first of each key in ``order``; NULL keys are errors.

    Returns inserted, ignored and errors. Not safe against a second writer at the same time.
    """
    spark = df.sparkSession
    first = df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    held = _existing(spark, path)
    new = first if held is None else first.join(held.select(key).distinct(), key, "left_anti").select(*first.columns)
    total = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("k")).first()
    written = Observation()
    append(new.observe(written, F.count(F.lit(1)).alias("n")), path)
    inserted = written.get["n"]
    return {"inserted": inserted, "ignored": total["k"] - inserted, "errors": total["n"] - total["k"]}


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def export_matrix(centroids: DataFrame, path: str) -> None:
    """A codebook as one .npy file on the driver; refuses more numbers than a codebook may have."""
    import numpy as np

    from codewell.operators.quantize import codebook_matrix

    matrix = codebook_matrix(centroids)[1]
    partial = f"{path}.part"
    with open(partial, "wb") as f:  # a failure leaves no half of a file under the name
        np.save(f, matrix)
    os.replace(partial, path)


def write_files(spark: SparkSession, contents: dict[str, bytes], folder: str) -> None:
    """A few small files, such as codebooks, by name into a folder of any file system the cluster knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, content in contents.items():
        path = jvm.org.apache.hadoop.fs.Path(folder, name)
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
