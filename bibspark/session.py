"""Session helpers: building a local session for tests/bench, reading the
driver tables, and finding a shared folder for checkpoints and staged
snapshots.

Checkpoints go to the folder named by ``spark.checkpoint.dir``. On a cluster
that setting must point at shared storage; we never invent a machine-local
folder there. Only a ``local[...]`` master without the setting (tests) gets a
fresh folder under the system temp dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", app: str = "bibspark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (`region` ... `conversations`) as a DataFrame."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Also makes it the SparkContext checkpoint dir so ``DataFrame.checkpoint``
    works. Without the setting, only a local master gets a fresh folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="bibspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder for staged tables."""
    base = shared_dir(spark)
    return f"{base.rstrip('/')}/bibspark/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never ``localCheckpoint``:
    a lost executor would take the only copy with it)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows in compressed columns in the shared folder: a checkpoint keeps
    rows as they are in memory, several times as much disk. Columns go by
    their place, so that names may come twice."""
    names, spark = df.columns, df.sparkSession
    placed = df.toDF(*[f"c{i}" for i in range(len(names))])
    path = scratch_path(spark, "stored")
    placed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path).toDF(*names)


def shuffle_tasks(spark: SparkSession) -> int:
    """Partitions for rows whose tasks are CPU-heavy or hold much: those of a
    shuffle, one per core at least."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
