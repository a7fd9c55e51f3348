"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC dates. Sizes are left to the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def is_single_machine(master: str) -> bool:
    """Whether driver and executors share one process, and so one temporary folder."""
    return master == "local" or master.startswith("local[")


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode where none is set."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not is_single_machine(spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read and read it back.

    A written table cuts lineage, outlives lost executors, keeps column pruning and gives
    the optimizer real sizes, so that join sides are only broadcast when they are small.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
