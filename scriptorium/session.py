"""Session set-up shared by jobs, tests and the bench.

A cluster brings its own configuration.  :func:`build_session` is for local
runs; the checkpoint folder is always read from the session and only chosen
here, by :func:`ensure_checkpoint_dir`, for a local master without one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "scriptorium", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("SCRIPTORIUM_DRIVER_MEMORY", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured (a shared filesystem); it is read
    from the session and never replaced. Only when it is unset, as in local
    tests, a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
        configured = tempfile.mkdtemp(prefix="scriptorium-ckpt-")
    sc.setCheckpointDir(configured)
    return configured
