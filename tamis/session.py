"""Session helpers.

Library code never builds its own session; it takes the caller's. ``get_spark``
is for tests, the bench and the driver contract, and sets only what is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts: keep scan splits moderate so one task never holds too much.
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def get_spark(cores: int | str | None = None, shuffle_partitions: int | None = None,
              app: str = "tamis", extra: dict | None = None) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_LOCAL_DIR: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file
    system). Only when it is unset (local runs, tests) do we make one under /tmp;
    Spark refuses to change that core setting at run time, so the fallback is kept
    here and handed to the SparkContext.
    """
    global _LOCAL_DIR
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            sc = spark.sparkContext
            d, master = sc.getCheckpointDir(), sc.master
        except Exception:  # remote sessions have no SparkContext
            d, master = None, "remote"
        if d:
            return d
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _LOCAL_DIR is None:
            _LOCAL_DIR = tempfile.mkdtemp(prefix="tamis-ckpt-", dir="/tmp")
        d = _LOCAL_DIR
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # remote sessions have no SparkContext
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the checkpoint folder for a written table."""
    base = checkpoint_dir(spark).rstrip("/")
    import uuid
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, df, name: str, fmt: str = "parquet"):
    """Write ``df`` once under the shared checkpoint folder and read it back.

    For a result used twice (flat hits feeding both verdicts and reports): the
    matching runs once, and an executor lost later re-reads files instead of
    re-running the lineage. Never a machine-local folder unless the session has no
    ``spark.checkpoint.dir`` (tests, local runs).
    """
    path = scratch_path(spark, name)
    df.write.format(fmt).save(path)
    return spark.read.format(fmt).load(path)
