"""Session helpers.

Library code never creates its own cluster session: every operator takes the
caller's ``SparkSession`` (or a DataFrame bound to one).  ``local_session`` is
for tests and the benchmark only.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job wants regardless of size: adaptive execution re-plans
# joins from runtime statistics (broadcast conversion, skew splitting,
# partition coalescing).
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "plotline", driver_memory: str = "8g",
                  extra_conf: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC clock)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**ADAPTIVE_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


@contextmanager
def wide_projections(spark: SparkSession):
    """Jobs run inside compute projections of many columns in compiled code.

    Spark puts all columns of a projection into one method where it can; the JVM
    does not compile methods of more than 8,000 bytes, so every row would be
    interpreted.  With this limit Spark splits such projections instead.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator (a shared file
    system) and missing configuration is an error: a folder on the driver's
    local disk cannot hold checkpoints written by other machines.  Only a
    local-mode session (tests) gets a temporary folder created here.
    Checkpoint files are removed when their tables are garbage-collected only
    if the cluster sets ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (fitted tables and stream "
                               "checkpoints are written there)")
        configured = tempfile.mkdtemp(prefix="plotline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
