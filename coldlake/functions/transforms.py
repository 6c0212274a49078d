"""Column transforms of archive encodings as Spark expressions, with their inverses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zigzag(col: Column) -> Column:
    """Signed integers to non-negative ones, small magnitudes first."""
    return F.when(col >= 0, col * 2).otherwise(-col * 2 - 1)


def unzigzag(col: Column) -> Column:
    return F.when(col % 2 == 0, F.shiftright(col, 1)).otherwise(-F.shiftright(col, 1) - 1)


def lag_delta(col: Column, order: list[Column], within: list[Column] = ()) -> Column:
    """Difference from the row before in ``order``; the first row keeps its value.

    Without ``within`` all rows pass one task; give the file or chunk number for large tables.
    """
    return col - F.coalesce(F.lag(col, 1).over(Window.partitionBy(*within).orderBy(*order)), F.lit(0))


def prefix_sum(col: Column, order: list[Column], within: list[Column] = ()) -> Column:
    """The inverse of ``lag_delta``."""
    frame = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(col).over(frame)


def epoch_seconds(col: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_seconds(F.to_utc_timestamp(col.cast("timestamp"), F.expr("current_timezone()")))


def scaled(col: Column, places: int) -> Column:
    """A double as an integer number of units of 10^-places (half away from zero)."""
    return F.round(col * F.lit(float(10**places))).cast("long")


def category_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """``df`` with each value's place among the sorted distinct values, from 0; NULL stays NULL.

    The dictionary is made from the distinct values and joined, so no task sees all rows.
    """
    dictionary = category_dictionary(df, column)
    joined = df.join(dictionary.withColumnRenamed("value", "__value"), F.col(f"`{column}`") == F.col("__value"), "left")
    return joined.drop("__value").withColumnRenamed("__code", code)


def category_dictionary(df: DataFrame, column: str) -> DataFrame:
    """value and __code of the sorted distinct values of ``column``.

    Distinct values of a category column are few; they pass one task.
    """
    values = df.select(F.col(f"`{column}`").alias("value")).where("value IS NOT NULL").distinct()
    return values.withColumn("__code", (F.row_number().over(Window.orderBy("value")) - 1).cast("long"))


def float32_error(col: Column) -> Column:
    """Aggregate: largest difference of a double from its float32 value."""
    return F.max(F.abs(col - col.cast("float").cast("double")))


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """key: the distinct keys of the JSON objects in ``column``."""
    return df.select(F.explode(F.json_object_keys(F.col(f"`{column}`"))).alias("key")).distinct()


def compact_json(df: DataFrame, column: str, keys: list[str] | None = None, out: str = "compact", typed: bool = False) -> DataFrame:
    """``df`` with the objects' keys replaced by their numbers in ``keys``, as map<int,string>.

    Without ``keys`` they are all keys of the column, sorted. ``typed`` keeps values as variants, so
    that ``expand_json`` gives back numbers, texts, nulls and nested values as they were.
    """
    keys = key_list(df, column) if keys is None else keys
    numbers = F.map_from_arrays(F.lit(list(keys)).cast("array<string>"), F.sequence(F.lit(0), F.lit(len(keys) - 1)) if keys else F.array().cast("array<int>"))
    parsed = F.from_json(F.col(f"`{column}`"), T.MapType(T.StringType(), T.VariantType() if typed else T.StringType()))
    return df.withColumn(out, F.transform_keys(parsed, lambda k, _: F.element_at(numbers, k)))


def key_list(df: DataFrame, column: str) -> list[str]:
    """The distinct keys of the JSON objects in ``column``, sorted; a schema's worth, so few."""
    return sorted(r["key"] for r in json_keys(df, column).collect())


def expand_json(df: DataFrame, column: str, keys: list[str], out: str = "json") -> DataFrame:
    """The inverse of ``compact_json``: JSON objects from maps by number."""
    names = F.lit(list(keys)).cast("array<string>")
    named = F.transform_keys(F.col(f"`{column}`"), lambda k, _: F.element_at(names, k + 1))
    return df.withColumn(out, F.to_json(named, {"ignoreNullFields": "false"}))


def csv_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as CSV with a header, computed in one aggregation without writing it."""
    flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    nested = [f.name for f in df.schema.fields if f.name not in flat]
    columns = [F.col(f"`{c}`") for c in flat] + [F.to_json(F.struct(F.col(f"`{c}`"))).alias(c) for c in nested]
    texts = [F.when(F.col(f"`{f.name}`").isNotNull(), F.octet_length(F.col(f"`{f.name}`").cast("string"))).otherwise(0) for f in df.select(*columns).schema.fields]
    width = sum(texts[1:], texts[0]) + len(texts)
    total = df.select(*columns).agg(F.sum(width)).first()[0] or 0
    return int(total) + len(",".join(df.columns)) + 1
