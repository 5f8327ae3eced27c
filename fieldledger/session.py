"""Session settings the jobs rely on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build(app: str = "fieldledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local runs; on a cluster pass the session the cluster made to `configure`."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**RUNTIME, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """All dates are UTC and AQE is on; leave every other setting to the cluster."""
    for k, v in RUNTIME.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's checkpoint folder. Only a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fieldledger-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


def cut(df: DataFrame) -> DataFrame:
    """The rows checkpointed in the shared folder, so that two uses of a small result do not run its plan twice."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def saver(spark: SparkSession, purpose: str):
    """A function that writes a working table once and reads it back, for tables several steps read."""
    root = shared_dir(spark, purpose)

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    return save
