"""Session helpers.

Nothing here overrides cluster settings: a value is only set when the
session does not already carry one (tests and local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    # Let AQE coalesce partitions inside persisted plans too.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "assayline") -> SparkSession:
    """Local session for tests, bench and smoke runs."""
    live = SparkSession.getActiveSession()
    if live is not None:  # a running session keeps its own settings
        ensure_checkpoint_dir(live)
        return live
    given = SparkConf()
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**_LOCAL_DEFAULTS,
                 "spark.sql.shuffle.partitions": str(shuffle_partitions)}.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    # spark.checkpoint.dir is not set here: a configured folder (cluster or
    # spark-defaults) wins; ensure_checkpoint_dir makes one only if unset.
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The folder is read from the session; a cluster names a shared one. Only
    a local session without it gets a scratch folder (tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is unset on a cluster; name a shared folder")
    path = tempfile.mkdtemp(prefix="assayline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def store(df, label: str = "table"):
    """``df`` written once as Parquet under the shared checkpoint folder and
    read back: its lineage ends there, it survives lost executors, later
    readers prune its columns, and nothing stays pinned in executor memory."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
