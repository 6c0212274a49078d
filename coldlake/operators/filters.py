"""Filters given as a dictionary, compiled to one Column that Catalyst can push down."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FilterSpec = Mapping[str, Any]


def filter_column(spec: FilterSpec | None, columns: Iterable[str], strict: bool = False) -> Column | None:
    """Conjunction of the entries: a value means equality, a list any of its values, a pair a closed
    range; None for a bound leaves that side open, and None as a value means IS NULL.

    Entries for unknown columns are ignored unless ``strict``.
    """
    known = set(columns)
    terms = []
    for name, wanted in (spec or {}).items():
        if name not in known:
            if strict:
                raise KeyError(f"no column {name!r} to filter on")
            continue
        terms.append(_term(F.col(f"`{name}`"), wanted))
    return reduce(lambda a, b: a & b, terms) if terms else None


def _term(col: Column, wanted: Any) -> Column:
    if isinstance(wanted, tuple):
        if len(wanted) != 2:
            raise ValueError("a range filter has two bounds")
        low, high = wanted
        parts = [col >= F.lit(low)] * (low is not None) + [col <= F.lit(high)] * (high is not None)
        return reduce(lambda a, b: a & b, parts) if parts else col.isNotNull()
    if isinstance(wanted, (list, set, frozenset)):
        values = [v for v in wanted if v is not None]
        test = col.isin(values) if values else F.lit(False)
        return test | col.isNull() if len(values) < len(wanted) else test
    return col.isNull() if wanted is None else col == F.lit(wanted)


def apply_filter(df: DataFrame, spec: FilterSpec | None, strict: bool = False) -> DataFrame:
    column = filter_column(spec, df.columns, strict)
    return df if column is None else df.where(column)


def normalise_columns(spec: None | str | Iterable[str], columns: list[str]) -> list[str]:
    """Column names from None, one name, several names or ``"*"``; unknown names are dropped."""
    if spec is None:
        return []
    if spec == "*":
        return list(columns)
    names = [spec] if isinstance(spec, str) else list(spec)
    return [n for n in dict.fromkeys(names) if n in columns]


def as_scalar(value: Any) -> Any:
    """A value as the JSON scalar that manifests hold; dates and times as ISO text."""
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (bool, int, float, str)) or value is None:
        return value
    return str(value)


def _decimal(value: Any) -> Any:
    return None if value is None else decimal.Decimal(str(value))


def may_match(stats: Mapping[str, list], spec: FilterSpec | None, decimals: Iterable[str] = ()) -> bool:
    """Whether a file with these smallest and largest values can hold a matching row.

    Comparisons are typed, those of ``decimals`` as decimal numbers; where types do not compare, the
    file is kept. NaN counts as Spark orders it, above all other values.
    """
    for name, wanted in (spec or {}).items():
        if name not in stats:
            continue
        low, high, nulls, *more = stats[name]
        if more or high != high or low != low:  # the file holds NaN
            low, high = (math.inf if low is None or low != low else low), math.inf
        plain = _decimal if name in decimals else as_scalar
        if wanted is None:
            if not nulls:
                return False
            continue
        if low is None:  # all values are null
            if isinstance(wanted, (list, set, frozenset)) and None in wanted:
                continue
            return False
        try:
            if name in decimals:
                low, high = plain(low), plain(high)
            if isinstance(wanted, tuple):
                first, last = (math.inf if w != w else plain(w) for w in wanted)
                hit = (first is None or _le(first, high)) and (last is None or _le(low, last))
            elif isinstance(wanted, (list, set, frozenset)):
                hit = any(
                    bool(nulls) if v is None else bool(more) if v != v else _le(low, plain(v)) and _le(plain(v), high) for v in wanted
                )
            elif wanted != wanted:
                hit = high == math.inf
            else:
                hit = _le(low, plain(wanted)) and _le(plain(wanted), high)
        except (TypeError, decimal.InvalidOperation):
            hit = True
        if not hit:
            return False
    return True


def _le(a: Any, b: Any) -> bool:
    """a <= b; ISO texts of a date and of a time compare by their common length."""
    if isinstance(a, str) and isinstance(b, str) and len(a) != len(b) and a[:4].isdigit() and a[4:5] == "-":
        n = min(len(a), len(b))
        return a[:n] <= b[:n]
    return a <= b
