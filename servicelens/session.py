"""Session helpers: a local session for tests and benches, and checkpoint handling.

On a cluster the session is created by the platform; operators never set
cluster-level conf.  ``checkpoint_dir`` reads the shared folder named by
``spark.checkpoint.dir`` and only falls back to a caller-supplied folder where
the setting is unset (tests, local benches).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "servicelens", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SERVICELENS_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder: the one already set, else the one ``spark.checkpoint.dir`` names.

    Only a session whose master is this machine (tests, local benches) may go without: it gets
    ``fallback`` or a temporary folder.  On a cluster a machine-local folder would lose data, so a
    missing setting is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster session needs a folder that all executors share")
    path = fallback or tempfile.mkdtemp(prefix="servicelens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a table that one run needs."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this session was given; returns how many were there.

    Call it when the results read from them are no longer needed, for example between pipeline runs."""
    jvm = spark.sparkContext._jvm
    removed = 0
    for owner, path in [x for x in _SCRATCH if x[0] is spark]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        removed += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _SCRATCH.remove((owner, path))
    return removed


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
