"""Detection of input kinds, and flattening of documents to columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A field is kept if at least this share of the sampled documents has it.
MIN_PRESENCE = 0.6
SAMPLE_DOCS = 500
DICT_SIZE = 256


class DataKind(Enum):
    TABULAR = "tabular"
    SEMI_STRUCTURED = "semi_structured"


class FieldKind(Enum):
    SCALAR = "scalar"
    ARRAY = "array"
    NESTED = "nested"


@dataclass
class FieldInfo:
    name: str
    kind: FieldKind
    strategy: str
    presence: float
    nullable: bool
    dtype: str
    tokens: list[str] = field(default_factory=list)


@dataclass
class Detected:
    df: DataFrame
    kind: DataKind
    fields: list[FieldInfo]

    @property
    def manifest(self) -> dict[str, dict[str, Any]]:
        return {
            f.name: {"kind": f.kind.value, "strategy": f.strategy, "presence": f.presence, "nullable": f.nullable, "dtype": f.dtype}
            for f in self.fields
        }


def field_kind(dtype: T.DataType) -> FieldKind:
    if isinstance(dtype, T.ArrayType):
        return FieldKind.ARRAY
    return FieldKind.NESTED if isinstance(dtype, (T.StructType, T.MapType)) else FieldKind.SCALAR


def tabular(df: DataFrame) -> Detected:
    """A table as it is, with the null counts of one aggregation."""
    n, *nulls = df.agg(F.count("*"), *[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]).first()
    fields = [
        FieldInfo(f.name, FieldKind.SCALAR, "native", 1 - missing / n if n else 0.0, bool(missing), f.dataType.simpleString())
        for f, missing in zip(df.schema.fields, nulls)
    ]
    return Detected(df, DataKind.TABULAR, fields)


def field_census(documents: DataFrame, column: str) -> DataFrame:
    """name and n: how many of the JSON object texts in ``column`` hold each top-level key."""
    keys = F.array_distinct(F.json_object_keys(F.col(f"`{column}`")))
    return documents.select(F.explode(keys).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def top_tokens(df: DataFrame, column: str, size: int = DICT_SIZE) -> DataFrame:
    """token and n: the most frequent elements of an array column, ties in token order."""
    tokens = df.select(F.explode(F.col(f"`{column}`")).alias("token")).where("token IS NOT NULL")
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(size)


def _is_date(text: Column) -> Column:
    form = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return form & F.try_to_timestamp(text).isNotNull()


def _has_tokens(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)


def _evidence(parsed: DataFrame, fields: list[T.StructField]) -> dict[str, tuple[int, int, int]]:
    """Of each field in all documents, from one aggregation: how many values there are, how many the
    sampled type cannot hold, and how many are no number (numbers), no date (texts) or not short
    lists of short texts (lists of texts)."""
    counts = []
    for f in fields:
        raw = F.col("raw")[f.name]
        typed = F.col("typed")[f.name]
        if isinstance(f.dataType, T.StringType):
            odd = ~_is_date(raw)
        elif _has_tokens(f.dataType):
            odd = ~((F.size(typed) <= 20) & F.forall(typed, lambda x: F.length(x) <= 50))
        else:
            odd = raw.try_cast("double").isNull()
        counts.append(F.struct(F.count(raw), F.count_if(raw.isNotNull() & typed.isNull()), F.count_if(raw.isNotNull() & F.coalesce(odd, F.lit(True)))))
    found = parsed.agg(*counts).first() if fields else ()
    return {f.name: tuple(x) for f, x in zip(fields, found)}


def _token_lists(parsed: DataFrame, names: list[str], size: int = DICT_SIZE) -> dict[str, list[str]]:
    """The most frequent elements of each field, ties in token order, from one aggregation."""
    if not names:
        return {}

    def named(c: str) -> Column:
        return F.transform(F.col("typed")[c], lambda t: F.struct(F.lit(c).alias("name"), t.alias("token")))

    kind = "array<struct<name:string,token:string>>"
    pairs = F.flatten(F.array(*[F.coalesce(named(c), F.array().cast(kind)) for c in names]))
    counted = parsed.select(F.explode(pairs).alias("p")).select("p.*").where("token IS NOT NULL").groupBy("name", "token").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "token"))
    best = counted.withColumn("place", place).where(F.col("place") <= size).collect()
    return {c: [r["token"] for r in sorted(best, key=lambda r: r["place"]) if r["name"] == c] for c in names}


def flatten(documents: DataFrame, column: str = "value", sample_docs: int = SAMPLE_DOCS, coerce_dates: bool = True) -> Detected:
    """Columns from JSON object texts. Fields and their presence come from the first ``sample_docs``
    documents (the feature is a sample); one aggregation over all documents then confirms their types.

    Fields below MIN_PRESENCE are dropped. Scalars keep their type; where any document holds a value of
    another type they become doubles if all are numbers, else text. Texts of which every value is a
    date become timestamps, arrays and objects become JSON text, absent ones ``null``. Token
    dictionaries count all documents.
    """
    spark = documents.sparkSession
    text = documents.select(F.col(f"`{column}`").alias("__doc"))
    sample = text.limit(sample_docs).collect()
    rows = spark.createDataFrame([(r[0],) for r in sample], "__doc string").coalesce(1)
    n = len(sample)
    counts = {r["name"]: r["n"] for r in field_census(rows, "__doc").collect()}
    inferred = spark.read.json(rows.select("__doc").rdd.map(lambda r: r[0])).schema if n else T.StructType()
    kept = [f for f in inferred.fields if counts.get(f.name, 0) >= MIN_PRESENCE * n]
    typed = F.from_json("__doc", T.StructType([T.StructField(f.name, f.dataType) for f in kept]))
    raw = F.from_json("__doc", T.StructType([T.StructField(f.name, T.StringType()) for f in kept]))
    parsed = text.select(typed.alias("typed"), raw.alias("raw")) if kept else text
    evidence = _evidence(parsed, kept)
    listed = [f.name for f in kept if _has_tokens(f.dataType) and not any(evidence[f.name][1:])]
    tokens_of = _token_lists(parsed, listed)
    fields, out = [], []
    for f in kept:
        held, lost, odd = evidence[f.name]
        kind, presence, strategy, dtype = field_kind(f.dataType), counts[f.name] / n, "native", f.dataType
        plain = F.col("raw")[f.name]
        if kind is not FieldKind.SCALAR:
            strategy, dtype = "json_arr_dict" if f.name in tokens_of else "json_str", T.StringType()
            col = F.coalesce(plain, F.lit("null"))
        elif isinstance(dtype, T.StringType):
            col = plain
            if coerce_dates and held and not odd:
                col, strategy, dtype = F.try_to_timestamp(plain).cast("timestamp_ntz"), "timestamp", T.TimestampNTZType()
        elif lost:
            dtype = T.DoubleType() if isinstance(dtype, T.NumericType) and not odd else T.StringType()
            col = plain.try_cast(dtype)
        else:
            col = F.col("typed")[f.name]
        out.append(col.alias(f.name))
        fields.append(FieldInfo(f.name, kind, strategy, presence, presence < 1, dtype.simpleString(), tokens_of.get(f.name, [])))
    rare = [f for f in inferred.fields if f not in kept]
    fields += [FieldInfo(f.name, field_kind(f.dataType), "json_str_rare", counts.get(f.name, 0) / n, True, "") for f in rare]
    df = parsed.select(*out) if kept else text.select()
    return Detected(df, DataKind.SEMI_STRUCTURED, fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = True) -> DataFrame:
    """CSV with a header, quotes doubled inside quoted fields, and line ends in them if ``multiline``."""
    return spark.read.csv(path, schema=schema, header=True, inferSchema=schema is None, multiLine=multiline, escape='"')


def detect_file(spark: SparkSession, path: str) -> Detected:
    """Read a CSV, JSONL, NDJSON, JSON, Parquet or Excel file, by its extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return tabular(read_csv(spark, path))
    if kind == "parquet":
        return tabular(spark.read.parquet(path))
    if kind in ("jsonl", "ndjson"):
        return flatten(spark.read.text(path).where(F.trim("value") != ""))
    if kind == "json":
        whole = spark.read.text(path, wholetext=True)
        # a list of documents, or one document
        listed = F.from_json("value", "array<string>")
        documents = whole.select(F.explode(F.coalesce(listed, F.array("value"))).alias("value"))
        return flatten(documents)
    if kind in ("xlsx", "xls"):
        import pandas as pd

        return tabular(spark.createDataFrame(pd.read_excel(path)))
    raise ValueError(f"unknown file type {kind!r}")


def detect(spark: SparkSession, data: Any) -> Detected:
    """A DataFrame, a list of dicts, one dict, or a file's path; nested columns are flattened."""
    if isinstance(data, str):
        return detect_file(spark, data)
    if isinstance(data, DataFrame):
        if any(field_kind(f.dataType) is not FieldKind.SCALAR for f in data.schema.fields):
            return flatten(data.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")))
        return tabular(data)
    if isinstance(data, dict):
        data = [data]
    if isinstance(data, list) and all(isinstance(d, dict) for d in data):
        import json

        rows = [(json.dumps(d, ensure_ascii=False, default=str),) for d in data]
        return flatten(spark.createDataFrame(rows, "value string"))
    return tabular(spark.createDataFrame(data))
