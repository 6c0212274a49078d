"""Access to the benchmark tables, and scratch paths for queries that write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the tables, for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder ``spark.checkpoint.dir``; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="coldlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/archives/{label}-{uuid.uuid4().hex}"
