"""Compression and quantisation choices, and the Parquet options that they become."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODEC_NONE, CODEC_ZSTD, CODEC_LZMA2, CODEC_ZPAQ, CODEC_AUTO = "none", "zstd", "lzma2", "zpaq", "auto"
QUANT_NONE, QUANT_HIGH, QUANT_MEDIUM, QUANT_LOW = 0, 1, 2, 3

#: Requested codec to Parquet codec and level. Parquet has no LZMA; its place is zstd's top level.
PARQUET_CODECS: dict[str, tuple[str, int | None]] = {
    "none": ("uncompressed", None),
    "zstd": ("zstd", 3),
    "lzma2": ("zstd", 19),
    "zpaq": ("zstd", 19),
    "vault": ("zstd", 19),
    "snappy": ("snappy", None),
    "gzip": ("gzip", None),
    "lz4": ("lz4_raw", None),
}
#: Profile to codec.
CODEC_PROFILES = {"balanced": "zstd", "max_compression": "lzma2", "max_speed": "lz4", "auto": "auto"}


#: Per-column choice to the Parquet writer's options for that column.
COLUMN_ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true"},
    "plain": {"parquet.enable.dictionary": "false"},
    "bloom": {"parquet.bloom.filter.enabled": "true"},
}


def column_options(encodings: dict[str, str] | None, columns: list[str]) -> dict[str, str]:
    """Writer options of per-column encodings; unknown columns are ignored, unknown encodings are not.

    Parquet compresses all columns of a file alike, so encodings are what can differ by column.
    """
    out = {}
    for column, encoding in (encodings or {}).items():
        if encoding not in COLUMN_ENCODINGS:
            raise ValueError(f"unknown encoding {encoding!r}; use one of {', '.join(COLUMN_ENCODINGS)}")
        if column in columns:
            out |= {f"{k}#{column}": v for k, v in COLUMN_ENCODINGS[encoding].items()}
    return out


def parquet_options(codec: str) -> dict[str, str]:
    if codec not in PARQUET_CODECS:
        raise ValueError(f"unknown codec {codec!r}; use one of {', '.join(PARQUET_CODECS)}")
    name, level = PARQUET_CODECS[codec]
    out = {"compression": name, "parquet.writer.version": "v2" if codec in ("lzma2", "zpaq", "vault") else "v1"}
    if level is not None:
        out["parquet.compression.codec.zstd.level"] = str(level)
    return out


def _place_digits(name: str) -> int:
    """Decimal places that medium quantisation keeps."""
    name = name.lower()
    if "lat" in name or "lon" in name:
        return 4
    return 1 if "score" in name or "pct" in name else 0


def _exempt(name: str) -> bool:
    return any(part in name.lower() for part in ("lat", "lon", "score", "pct"))


def to_float16(col: Column) -> Column:
    """Nearest IEEE half-precision value, as double; large values become infinite."""

    def half(values: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            out = pd.Series(values.to_numpy(float).astype(np.float16).astype(np.float64), index=values.index)
        return out.where(values.notna(), None)

    return F.pandas_udf(half, "double")(col)


def quantise(df: DataFrame, quant: int) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with float and timestamp columns at the level's precision, and what was done to which.

    1: float32. 2: decimal places by column name, timestamps to the minute. 3: float16, timestamps
    to the minute. Levels 1 and 3 spare coordinates, scores and percentages. NULLs stay NULL.
    """
    if quant == QUANT_NONE:
        return df, {}
    if quant not in (QUANT_HIGH, QUANT_MEDIUM, QUANT_LOW):
        raise ValueError(f"unknown quantisation level {quant!r}")
    out, done = [], {}
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            if quant == QUANT_MEDIUM:
                places = _place_digits(f.name)
                col, done[f.name] = F.bround(col, places).cast(f.dataType), f"places:{places}"
            elif not _exempt(f.name):
                if quant == QUANT_HIGH:
                    col, done[f.name] = col.cast("float").cast(f.dataType), "float32"
                else:
                    col, done[f.name] = to_float16(col.cast("double")).cast(f.dataType), "float16"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and quant >= QUANT_MEDIUM:
            col, done[f.name] = F.date_trunc("minute", col).cast(f.dataType), "minute"
        out.append(col.alias(f.name))
    return df.select(*out), done


def seal(df: DataFrame, key: bytes) -> DataFrame:
    """Every column encrypted by itself with AES-GCM, so that reads still prune columns.

    The key must have 16, 24 or 32 bytes.
    """
    lit_key = _key_column(df, key)
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            raw = col
        elif isinstance(f.dataType, T.TimestampType):  # an instant, whatever the sessions' time zones
            raw = F.unix_micros(col).cast("string").cast("binary")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            raw = F.to_json(F.struct(col.alias("v"))).cast("binary")
        else:
            raw = col.cast("string").cast("binary")
        out.append(F.when(raw.isNotNull(), F.aes_encrypt(raw, lit_key, F.lit("GCM"))).alias(f.name))
    return df.select(*out)


def unseal(df: DataFrame, schema: T.StructType, key: bytes) -> DataFrame:
    """The inverse of ``seal``; a wrong key fails when rows are read."""
    lit_key = _key_column(df, key)
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        raw = F.aes_decrypt(F.col(f"`{f.name}`"), lit_key, F.lit("GCM"))
        if isinstance(f.dataType, T.BinaryType):
            col = raw
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            wrapped = T.StructType([T.StructField("v", f.dataType)])
            col = F.from_json(raw.cast("string"), wrapped)["v"]
        elif isinstance(f.dataType, T.TimestampType):
            col = F.timestamp_micros(raw.cast("string").cast("long"))
        else:
            col = raw.cast("string").cast(f.dataType)
        out.append(col.alias(f.name))
    return df.select(*out)


def _key_column(df: DataFrame, key: bytes):
    """The key as a scalar subquery over a local row: plans show the query, never the key."""
    if len(key) not in (16, 24, 32):
        raise ValueError("the key must have 16, 24 or 32 bytes")
    return df.sparkSession.createDataFrame(pa.table({"key": pa.array([bytes(key)], pa.binary())})).scalar()
