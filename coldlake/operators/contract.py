"""Schema contracts applied on read, and structural evolution; both compile to one ``select``."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dtype names of dataframe libraries to Spark type names.
DTYPE_NAMES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int",
    "uint32": "bigint", "float16": "float", "float32": "float", "float64": "double", "bool": "boolean",
    "boolean": "boolean", "str": "string", "string": "string", "object": "string", "category": "string",
    "datetime64[ns]": "timestamp_ntz", "datetime64[us]": "timestamp_ntz", "datetime64": "timestamp_ntz",
    "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "Float32": "float", "Float64": "double",
}
_MISSING = object()


class SchemaError(ValueError):
    """A contract is malformed, or data breaks it."""


def spark_type(dtype: str | T.DataType) -> T.DataType:
    if isinstance(dtype, T.DataType):
        return dtype
    try:
        return T._parse_datatype_string(DTYPE_NAMES.get(dtype, dtype)) if " " not in dtype else T.DataType.fromDDL(dtype)
    except Exception as error:
        raise SchemaError(f"unknown type {dtype!r}") from error


@dataclass(frozen=True)
class Field:
    """A column of a contract. Without a default, an absent optional column is NULL."""

    dtype: str
    required: bool = False
    default: Any = None
    renamed_from: str | None = None

    def __post_init__(self):
        kind = spark_type(self.dtype)
        if self.default is not None:
            fits = {
                T.BooleanType: (bool,), T.StringType: (str,), T.DoubleType: (int, float), T.FloatType: (int, float),
            }.get(type(kind))
            if isinstance(kind, T.IntegralType):
                fits = (int,)
            wrong_bool = isinstance(self.default, bool) and not isinstance(kind, T.BooleanType)
            if fits is not None and (not isinstance(self.default, fits) or wrong_bool):
                raise SchemaError(f"default {self.default!r} does not fit type {self.dtype}")


def _to_boolean(col: Column, kind: T.DataType) -> Column:
    if not isinstance(kind, T.StringType):
        return col.cast("boolean")
    text = F.lower(F.trim(col))
    return (
        F.when(text.isin("true", "1", "t", "yes", "y"), True)
        .when(text.isin("false", "0", "f", "no", "n"), False)
        .when(text.isNull() | (text == ""), F.lit(None).cast("boolean"))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), col)).cast("boolean"))
    )


class Contract:
    """An ordered set of columns that readers of a table get, whatever the stored columns are."""

    def __init__(self, fields: Mapping[str, Field | str]):
        self.fields = {n: Field(f) if isinstance(f, str) else f for n, f in fields.items()}
        sources = [f.renamed_from for f in self.fields.values() if f.renamed_from]
        twice = sorted({s for s in sources if sources.count(s) > 1})
        if twice:
            raise SchemaError(f"columns {twice} are the source of two fields")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Contract) and list(self.fields.items()) == list(other.fields.items())

    def __hash__(self) -> int:
        return hash(tuple(self.fields.items()))

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(f.dtype)) for n, f in self.fields.items()])

    def _source(self, name: str, columns: list[str]) -> str | None:
        old = self.fields[name].renamed_from
        if old is not None and old in columns:
            return old
        return name if name in columns else None

    def apply(self, df: DataFrame) -> DataFrame:
        """Rename, cast, fill and order columns; other columns are dropped. A failing cast raises
        when rows are read."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        out = []
        for name, field in self.fields.items():
            kind, source = spark_type(field.dtype), self._source(name, df.columns)
            if source is None:
                if field.required:
                    raise SchemaError(f"required column {name!r} is missing")
                col = F.lit(field.default).cast(kind)
            elif isinstance(kind, T.BooleanType):
                col = _to_boolean(F.col(f"`{source}`"), kinds[source])
            else:
                col = F.col(f"`{source}`").cast(kind)
            out.append(col.alias(name))
        return df.select(*out)

    def validate(self, df: DataFrame) -> list[str]:
        """Messages of what ``apply`` would fail on; empty if nothing. One pass over the data."""
        out, casts = [], []
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for name, field in self.fields.items():
            kind, source = spark_type(field.dtype), self._source(name, df.columns)
            if source is None:
                if field.required:
                    out.append(f"required column {name!r} is missing")
            elif kinds[source] != kind:
                if isinstance(kind, T.BooleanType) and isinstance(kinds[source], T.StringType):
                    known = F.lower(F.trim(F.col(f"`{source}`"))).isin("true", "false", "1", "0", "t", "f", "yes", "no", "y", "n", "")
                    casts.append((name, kind, F.col(f"`{source}`").isNotNull() & ~known))
                else:
                    cast = F.col(f"`{source}`").try_cast(kind)
                    casts.append((name, kind, F.col(f"`{source}`").isNotNull() & cast.isNull()))
        if casts:
            failed = df.agg(*[F.count_if(bad).alias(f"c{k}") for k, (_, _, bad) in enumerate(casts)]).first()
            out += [
                f"column {name!r}: {n} values cannot be cast to {kind.simpleString()}"
                for (name, kind, _), n in zip(casts, failed)
                if n
            ]
        return out

    @classmethod
    def infer(cls, df: DataFrame, required: bool = False) -> Contract:
        return cls({f.name: Field(f.dataType.simpleString(), required) for f in df.schema.fields})

    def to_dict(self) -> dict[str, Any]:
        return {
            n: {"dtype": f.dtype, "required": f.required, "default": f.default, "renamed_from": f.renamed_from}
            for n, f in self.fields.items()
        }

    @classmethod
    def from_dict(cls, raw: Mapping[str, Mapping[str, Any]]) -> Contract:
        return cls({n: Field(**f) for n, f in raw.items()})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            json.dump(self.to_dict(), file, ensure_ascii=False, indent=1)

    @classmethod
    def load(cls, path: str) -> Contract:
        with open(path, encoding="utf-8") as file:
            return cls.from_dict(json.load(file))


def evolve(df: DataFrame, target: T.StructType, int_fill_zero: bool = False) -> DataFrame:
    """``df`` with exactly the target's columns, types and order: cast, dropped, or filled with NULL.

    ``int_fill_zero`` fills missing integer columns with 0 instead.
    """
    out = []
    for f in target.fields:
        if f.name in df.columns:
            col = F.col(f"`{f.name}`").cast(f.dataType)
        elif int_fill_zero and isinstance(f.dataType, T.IntegralType):
            col = F.lit(0).cast(f.dataType)
        else:
            col = F.lit(None).cast(f.dataType)
        out.append(col.alias(f.name))
    return df.select(*out)


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return kind.simpleString()


def schema_diff(stored: T.StructType, target: T.StructType, strict: bool = False) -> dict[str, Any]:
    """added, removed, type_changed (name to old and new type) and unchanged columns of ``target``.

    Types of one family (integers, floats, timestamps) count as unchanged unless ``strict``.
    """
    old = {f.name: f.dataType for f in stored.fields}
    new = {f.name: f.dataType for f in target.fields}
    both = [n for n in new if n in old]
    changed = {
        n: (old[n].simpleString(), new[n].simpleString())
        for n in both
        if (old[n] != new[n] if strict else _family(old[n]) != _family(new[n]))
    }
    return {
        "added": [n for n in new if n not in old],
        "removed": [n for n in old if n not in new],
        "type_changed": changed,
        "unchanged": [n for n in both if n not in changed],
    }
