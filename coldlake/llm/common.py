"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that a helper broadcasts; beyond it callers take their shuffled path.
BROADCAST_LIMIT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Most rows, and bytes, in a batch of texts that Python gets at once.
TEXT_BATCH_ROWS = 512
TEXT_BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to TEXT_BATCH_ROWS rows and TEXT_BATCH_BYTES if they are larger.

    The default of 10,000 rows would hold 10,000 long texts in memory several times over. The
    settings are read when a plan runs, so they stay lowered.
    """
    for key, most in (("maxRecordsPerBatch", TEXT_BATCH_ROWS), ("maxBytesPerBatch", TEXT_BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def release_memory() -> None:
    """Hand memory that Python, Arrow and the C library keep back to the system.

    Called at the end of a partition: workers stay alive between stages and would hold it.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Only where that is unset and the master is local (tests on one machine) a local temporary folder
    becomes the checkpoint folder; on a cluster that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="coldlake-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/coldlake/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character stays (``lower`` would change more than ASCII)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def map_groups(
    df: DataFrame,
    keys: list[str],
    function: Callable[[tuple, dict[str, np.ndarray]], Iterator[pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Call ``function(key, columns)`` for each group of bounded size, many groups to a Python call.

    Rows are dealt by key and sorted within partitions, so a task streams through its groups and
    holds one at a time; unlike a grouped map there is no Arrow round trip for each small group.
    ``columns`` maps names to arrays. Keys must not be null.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []
        current: tuple | None = None

        def whole() -> dict[str, np.ndarray]:
            return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in names}

        for batch in batches:
            if batch.empty:
                continue
            columns = {c: batch[c].to_numpy() for c in names}
            change = np.zeros(len(batch) - 1, bool)
            for k in keys:
                change |= columns[k][1:] != columns[k][:-1]
            starts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
            for begin, end in zip(starts[:-1], starts[1:]):
                key = tuple(columns[k][begin] for k in keys)
                if current is not None and key != current:
                    yield from function(current, whole())
                    held = []
                current = key
                held.append({c: v[begin:end] for c, v in columns.items()})
        if current is not None:
            yield from function(current, whole())
        held.clear()
        release_memory()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
