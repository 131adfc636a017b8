"""Session helpers: a configured SparkSession and the shared checkpoint/state folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows whose payload is malformed are routed, not fatal: keep ANSI on and use try_* functions.
    "spark.sql.ansi.enabled": "true",
}


def get_session(master: str | None = None, app: str = "ledgerloom",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when nothing is configured (local tests) a
    private folder is created so ``DataFrame.checkpoint()`` has somewhere to write.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def state_dir(spark: SparkSession, name: str, fresh: bool = True) -> str:
    """A folder for job state (keyed tables, pending rows, stream checkpoints) under the
    shared checkpoint folder; ``fresh`` gives a new unique sub-folder per run."""
    base = checkpoint_dir(spark).rstrip("/")
    leaf = f"{name}-{uuid.uuid4().hex[:12]}" if fresh else name
    return f"{base}/ledgerloom/{leaf}"


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme for the few local-filesystem helpers used in tests."""
    if uri.startswith("file:"):
        uri = uri[len("file:"):]
        while uri.startswith("//"):
            uri = uri[1:]
    return uri if os.path.isabs(uri) else os.path.abspath(uri)
