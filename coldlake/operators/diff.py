"""Row-level difference of two versions of a table: one full outer join, and projections of it."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTPUTS = ("dict", "dataframe", "summary")
KINDS = ("inserted", "deleted", "changed", "unchanged")
#: Absolute tolerance of float comparisons, beside the relative one.
ATOL = 1e-8


def values_equal(a: Column, b: Column, kind: T.DataType, rtol: float, atol: float = ATOL) -> Column:
    """Null-safe equality; floats within atol + rtol * |b|, NaN equal to NaN, infinities exactly."""
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return a.eqNullSafe(b)
    a, b = a.cast("double"), b.cast("double")
    infinite = F.lit(float("inf"))
    near = (F.abs(a) < infinite) & (F.abs(b) < infinite) & (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
    return F.coalesce(a.eqNullSafe(b) | near, F.lit(False))


@dataclass(frozen=True)
class TableDiff:
    """``joined``: _diff, the keys, structs a and b of the value columns of both versions."""

    joined: DataFrame
    keys: list[str]
    values: list[str]
    equal: dict[str, Column]

    def summary(self) -> dict[str, int]:
        """Numbers of inserted, deleted, changed and unchanged rows."""
        found = {r["_diff"]: r["count"] for r in self.joined.groupBy("_diff").count().collect()}
        return {k: found.get(k, 0) for k in KINDS}

    def summary_frame(self) -> DataFrame:
        return self.joined.groupBy("_diff").agg(F.count("*").alias("n"))

    def _side(self, kind: str, side: str) -> DataFrame:
        rows = self.joined.where(F.col("_diff") == kind)
        return rows.select(*[F.col(f"`{k}`") for k in self.keys], *[F.col(side)[v].alias(v) for v in self.values])

    @property
    def inserted(self) -> DataFrame:
        return self._side("inserted", "b")

    @property
    def deleted(self) -> DataFrame:
        return self._side("deleted", "a")

    def changed(self, changed_columns_only: bool = False) -> DataFrame:
        """Keys, and value columns of both versions as ``c_v1`` and ``c_v2``."""
        rows = self.joined.where(F.col("_diff") == "changed")
        columns = self.changed_columns() if changed_columns_only else self.values
        pairs = [F.col(s)[c].alias(f"{c}_{v}") for c in columns for s, v in (("a", "v1"), ("b", "v2"))]
        return rows.select(*[F.col(f"`{k}`") for k in self.keys], *pairs)

    def changed_columns(self) -> list[str]:
        """Value columns that differ in a changed row, from one aggregation."""
        rows = self.joined.where(F.col("_diff") == "changed")
        if not self.values:
            return []
        flags = rows.agg(*[F.max(~self.equal[c]).alias(f"f{k}") for k, c in enumerate(self.values)]).first()
        return [c for c, flag in zip(self.values, flags) if flag]

    def frame(self) -> DataFrame:
        """Inserted, deleted and changed rows with ``_diff`` first; changed rows with their new values."""
        rows = self.joined.where(F.col("_diff") != "unchanged")
        pick = [F.when(F.col("_diff") == "deleted", F.col("a")[v]).otherwise(F.col("b")[v]).alias(v) for v in self.values]
        return rows.select("_diff", *[F.col(f"`{k}`") for k in self.keys], *pick)


def diff_tables(
    v1: DataFrame, v2: DataFrame, on: str | list[str], rtol: float = 1e-9, atol: float = ATOL, check_unique: bool = True
) -> TableDiff:
    """Difference by key columns. Null keys match each other; duplicate keys pair up, with a warning."""
    if set(v1.columns) != set(v2.columns):
        only1, only2 = sorted(set(v1.columns) - set(v2.columns)), sorted(set(v2.columns) - set(v1.columns))
        raise ValueError(f"columns differ: only in the first {only1}, only in the second {only2}")
    keys = [on] if isinstance(on, str) else list(on)
    missing = [k for k in keys if k not in v1.columns]
    if missing:
        raise KeyError(f"key columns {missing} do not exist")
    values = [c for c in v1.columns if c not in keys]
    if check_unique:
        grouped = v1.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("__n")).where("__n > 1")
        if not grouped.isEmpty():
            warnings.warn("key values repeat in the first version; their rows pair up", stacklevel=2)

    def side(df: DataFrame, name: str) -> DataFrame:
        struct = F.struct(*[F.col(f"`{c}`") for c in values]) if values else F.struct(F.lit(True).alias("__here"))
        return df.select(*[F.col(f"`{k}`").alias(f"__{name}{i}") for i, k in enumerate(keys)], struct.alias(name))

    a, b = side(v1, "a"), side(v2, "b")
    match = reduce(lambda x, y: x & y, [F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}")) for i in range(len(keys))])
    kinds = {f.name: f.dataType for f in v1.schema.fields}
    other = {f.name: f.dataType for f in v2.schema.fields}
    equal = {}
    for c in values:
        kind = kinds[c] if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else other[c]
        equal[c] = values_equal(F.col("a")[c], F.col("b")[c], kind, rtol, atol)
    same = reduce(lambda x, y: x & y, equal.values()) if equal else F.lit(True)
    kind = (
        F.when(F.col("a").isNull(), "inserted")
        .when(F.col("b").isNull(), "deleted")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    joined = a.join(b, match, "full_outer").select(
        kind.alias("_diff"),
        *[F.when(F.col("a").isNull(), F.col(f"__b{i}")).otherwise(F.col(f"__a{i}")).alias(k) for i, k in enumerate(keys)],
        "a",
        "b",
    )
    return TableDiff(joined, keys, values, equal)


def diff_positional(v1: DataFrame, v2: DataFrame, position: str, rtol: float = 1e-9) -> TableDiff:
    """Difference by row number, given as column ``position`` in both (see sources.archive.row_numbers)."""
    warnings.warn("no key: rows are compared by their position", stacklevel=2)
    return diff_tables(v1, v2, position, rtol, check_unique=False)


def diff(
    v1: DataFrame,
    v2: DataFrame,
    on: str | list[str],
    output: str = "dict",
    include: list[str] | None = None,
    changed_columns_only: bool = False,
    rtol: float = 1e-9,
):
    """``output`` dict: frames by kind and a summary (None for kinds not in ``include``); dataframe:
    all differing rows with ``_diff``; summary: counts."""
    if output not in OUTPUTS:
        raise ValueError(f"output must be one of {OUTPUTS}")
    found = diff_tables(v1, v2, on, rtol)
    if output == "summary":
        return found.summary()
    if output == "dataframe":
        return found.frame() if include is None else found.frame().where(F.col("_diff").isin(list(include)))
    wanted = set(include or KINDS[:3])
    return {
        "inserted": found.inserted if "inserted" in wanted else None,
        "deleted": found.deleted if "deleted" in wanted else None,
        "changed": found.changed(changed_columns_only) if "changed" in wanted else None,
        "summary": found.summary(),
    }
