"""Session construction and the shared scratch area used by jobs that write tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "loomlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans in this package rely on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "100000")  # top-k is cut before the shuffle up to this k
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local master may do without a name: it has one folder of this machine for the whole application.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"loomlab-{spark.sparkContext.applicationId}")
    os.makedirs(own, exist_ok=True)
    return own


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI that names its file system, for code in tasks that opens files itself.

    A path without a scheme lies where Spark takes it to lie, on the session's default file system; a one-row table
    written below it says which that is. Under a local master it is this machine's disk.
    """
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder):
        return folder
    if spark.sparkContext.master.startswith("local"):
        return f"file://{os.path.abspath(folder)}"
    probe = f"_probe-{uuid.uuid4().hex}"
    spark.range(1).write.parquet(f"{folder}/{probe}")
    return spark.read.parquet(f"{folder}/{probe}").inputFiles()[0].split(f"/{probe}/")[0]


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder for one table written by a job."""
    return f"{shared_dir(spark)}/loomlab/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df, purpose: str):
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    path = scratch(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
