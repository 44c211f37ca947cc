"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "signalmill", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, no web page; sizes stay with the cluster's own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_private: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share. A local session without one gets a private folder, removed when Python ends."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    if context.applicationId not in _private:
        _private[context.applicationId] = folder = tempfile.mkdtemp(prefix="signalmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _private[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never used before."""
    return f"{scratch_root(spark)}/signalmill/{label}-{uuid.uuid4().hex}"
