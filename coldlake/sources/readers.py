"""Sources that become DataFrames: files by extension, several paths, ranges, iterators of batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.operators.detect import detect_file, read_csv
from coldlake.sources.archive import read_archive, write_archive
from coldlake.sources.files import Files

SAMPLE_ROWS = 1000


def resolve_paths(spec: str | list[str]) -> list[str]:
    """Paths from a comma-separated list, globs left to Spark."""
    parts = spec.split(",") if isinstance(spec, str) else spec
    return [p.strip() for p in parts if p.strip()]


def read_archives(spark: SparkSession, spec: str | list[str], **options: Any) -> DataFrame:
    """Union by name of several archives; columns that one lacks are NULL there."""
    files = Files(spark)
    parts = []
    for path in resolve_paths(spec):
        if any(c in path for c in "*?[{"):
            parent, _, pattern = path.rstrip("/").rpartition("/")
            import fnmatch

            parts += [f.path for f in files.list(parent) if f.is_dir and fnmatch.fnmatch(f.name, pattern)]
        else:
            parts.append(path)
    if not parts:
        raise FileNotFoundError(f"no archive matches {spec!r}")
    out = read_archive(spark, parts[0], **options)
    for path in parts[1:]:
        out = out.unionByName(read_archive(spark, path, **options), allowMissingColumns=True)
    return out


def read_source(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """A CSV, JSON, JSON lines or Parquet path. Types of CSV and JSON come from ``schema`` or are inferred
    from the whole input.

    Quoted CSV fields may hold quotes (doubled) and line ends, so a CSV file is one task;
    ``multiline=False`` lets Spark split files whose fields hold no line end. A ``.json`` file is one
    document or a list of documents, other JSON has a document a line.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path, schema, multiline)
    if kind in ("jsonl", "ndjson", "json"):
        if schema:
            return spark.read.schema(schema).json(path, multiLine=kind == "json")
        return detect_file(spark, path).df
    if kind in ("parquet", "pq"):
        return spark.read.parquet(path)
    return read_archive(spark, path)


def freeze_file(spark: SparkSession, source: str, target: str, progress: Callable[[str], None] | None = None, **options: Any):
    """Read a file and write it as an archive, distributed."""
    if progress:
        progress(f"reading {source}")
    out = write_archive(read_source(spark, source), target, **options)
    if progress:
        progress(f"wrote {out['rows']} rows")
    return out


def freeze_stream(
    spark: SparkSession,
    batches: Iterable[pd.DataFrame | list[dict]],
    target: str,
    schema: T.StructType | str | None = None,
    progress: Callable[[int], None] | None = None,
    **options: Any,
) -> dict[str, Any]:
    """An archive from an iterator of batches, with one batch in the driver's memory at a time.

    The first batch gives the schema, unless it is given.
    """
    from coldlake.sources.archive import append_archive

    result, total = None, 0
    for batch in batches:
        frame = spark.createDataFrame(batch, schema=schema)
        if result is None:
            schema = frame.schema
            result = write_archive(frame, target, **options)
        else:
            append_archive(frame, target, verify=False)
        total += len(batch)
        if progress:
            progress(total)
    if result is None:
        raise ValueError("the iterator gave no batch")
    from coldlake.sources.archive import audit

    return audit(spark, target)


class RangeSource:
    """Rows [start, end) of a file in its stored order, for callers that split work by rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, start: int, end: int) -> DataFrame:
        df = read_source(self.spark, self.path)
        numbered = df.select("*", F.monotonically_increasing_id().alias("__place"))
        # partition sizes give each partition's first number; no global sort is needed
        part = F.shiftright("__place", 33)
        sizes = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
        first, rows = 0, []
        for r in sizes:
            rows.append((r["__part"], first))
            first += r["n"]
        if not rows:
            return df
        starts = F.broadcast(self.spark.createDataFrame(rows, "__part long, __first long"))
        placed = numbered.withColumn("__part", part).join(starts, "__part")
        number = F.col("__first") + F.col("__place").bitwiseAND((1 << 33) - 1)
        return placed.where((number >= start) & (number < end)).select(*[F.col(f"`{c}`") for c in df.columns])
