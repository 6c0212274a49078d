"""Exports of a result: in memory as records, text or bytes, or written by the executors."""

from __future__ import annotations

import io
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("dataframe", "pandas", "records", "json", "csv", "parquet", "xlsx")


def export(df: DataFrame, output_format: str = "dataframe", sep: str = ",") -> Any:
    """The result in a format; all but ``dataframe`` collect it, so they are for small results."""
    if output_format not in FORMATS:
        raise ValueError(f"unknown format {output_format!r}; use one of {', '.join(FORMATS)}")
    if output_format == "dataframe":
        return df
    if output_format == "records":
        return [r.asDict(recursive=True) for r in df.collect()]
    if output_format == "json":
        texts = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("t")).collect()
        return json.dumps([json.loads(r["t"]) for r in texts], ensure_ascii=False)
    pdf = df.toPandas()
    if output_format == "pandas":
        return pdf
    if output_format == "csv":
        return pdf.to_csv(index=False, sep=sep)
    sink = io.BytesIO()
    if output_format == "parquet":
        pdf.to_parquet(sink, index=False)
    else:
        pdf.to_excel(sink, index=False)
    return sink.getvalue()


def write_file(df: DataFrame, path: str) -> None:
    """Write in parallel, in the format that the path's extension names."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True, escape='"')
    elif kind == "parquet":
        writer.parquet(path)
    elif kind in ("json", "jsonl", "ndjson"):
        writer.json(path)
    else:
        raise ValueError(f"unknown extension {kind!r}; use csv, parquet or jsonl")
