"""Session-level helpers shared by every operator: tables, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Settings of a session by environment variable, with the values used where it is unset.
SETTINGS = {
    "CODEWELL_MASTER": ("spark.master", "local[*]"), "CODEWELL_SHUFFLE_PARTITIONS": ("spark.sql.shuffle.partitions", "200"), "CODEWELL_DRIVER_MEMORY": ("spark.driver.memory", "4g"),
    "CODEWELL_CHECKPOINTS": ("spark.checkpoint.dir", None), "CODEWELL_TOKENIZERS": ("spark.codewell.tokenizers", None),
}
DATA, DEFAULT_DATA = "CODEWELL_DATA", "data"


def configuration(environ: Mapping[str, str] = os.environ, **settings: str) -> dict[str, str]:
    """Settings of a session by environment variables and defaults; settings that are given win."""
    found = {key: environ.get(variable) or default for variable, (key, default) in SETTINGS.items()}
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.checkpoint.compress": "true"}
    return {k: v for k, v in (fixed | found | settings).items() if v is not None}


def session(name: str = "codewell", **settings: str) -> SparkSession:
    """A session with this configuration."""
    return SparkSession.builder.appName(name).config(map=configuration(**settings)).getOrCreate()


def stored(spark: SparkSession, name: str, environ: Mapping[str, str] = os.environ) -> DataFrame:
    """A relation of the store, whose folder an environment variable names."""
    return table(spark, environ.get(DATA) or DEFAULT_DATA, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for; used to size explicit repartitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); on a local master without one a temporary folder, which is
    removed at the end. Elsewhere an unset folder is an error, as executors could not read each other's files.

    Checkpoints that nothing refers to any more are deleted by the cleaner of the session.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="codewell-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder for relations that are read back; removed at the end of the program."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def release(spark: SparkSession) -> None:
    """Let the cleaner delete what belongs to frames that are out of use, instead of at its next turn."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which survives the loss of executors.

    The result is computed once and read from the shared folder afterwards, so it may feed several consumers.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame, factor: int = 1) -> DataFrame:
    """Let a Python stage behind a scan use all cores.

    A scan of enough splits stays as it is, without a shuffle of the texts; only one of few splits is dealt out round-robin.
    ``scan`` must not contain a shuffle, as its splits are counted by planning it.
    """
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    enough = parallelism(scan.sparkSession)
    return scan if splits >= enough else scan.repartition(enough * factor)


def keep(df: DataFrame) -> DataFrame:
    """Persist with spill to disk; a lost block is recomputed from its lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when the side is proven to have at most ``max_rows`` rows.

    Beyond the bound the frame is returned without a hint and Catalyst plans a shuffled join, so the result is the same
    at any size. The probe counts at most ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
