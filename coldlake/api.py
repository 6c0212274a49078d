"""Functions over the active Spark session, for callers who do not keep a session object."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from coldlake.operators import detect as detection
from coldlake.operators import diff as diffs
from coldlake.operators import profile as profiles
from coldlake.operators.contract import Contract
from coldlake.plans.sqlfront import SqlFront, read_relation
from coldlake.sources import archive, readers
from coldlake.sources.export import export
from coldlake.sources.keys import KeyProvider, resolve_key

_fronts: dict[int, SqlFront] = {}
_resolver: Callable[[str], str] | None = None


def active_session() -> SparkSession:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark


def _front() -> SqlFront:
    spark = active_session()
    if id(spark) not in _fronts:

        def reader(session: SparkSession, path: str) -> DataFrame:
            return read_relation(session, _resolver(path) if _resolver else path)

        _fronts.clear()
        _fronts[id(spark)] = SqlFront(spark, reader)
    return _fronts[id(spark)]


def _frame(data: Any) -> DataFrame:
    return data if isinstance(data, DataFrame) else active_session().createDataFrame(data)


def freeze(df: DataFrame | pd.DataFrame, path: str, key: bytes | KeyProvider | None = None, **options: Any) -> dict[str, Any]:
    """Write a table as an archive; options as for ``sources.archive.write_archive``."""
    return archive.write_archive(_frame(df), path, key=resolve_key(key), **options)


def unfreeze(
    path: str,
    verify: bool = False,
    filter: dict[str, Any] | None = None,
    row_range: tuple[int, int] | None = None,
    key: bytes | KeyProvider | None = None,
    schema: Contract | None = None,
    schema_override: Any = None,
    engine: str = "spark",
    output_format: str = "dataframe",
    sep: str = ",",
) -> Any:
    """An archive's rows; ``engine`` pandas collects them."""
    if engine not in ("spark", "pandas"):
        raise ValueError("engine must be spark or pandas")
    found = archive.read_archive(active_session(), path, verify, filter, row_range, resolve_key(key), schema, schema_override)
    if engine == "pandas" and output_format == "dataframe":
        output_format = "pandas"
    return export(found, output_format, sep)


def append(path: str, df: DataFrame | pd.DataFrame, verify: bool = True) -> dict[str, Any]:
    return archive.append_archive(_frame(df), path, verify)


def audit(path: str) -> dict[str, Any]:
    return archive.audit(active_session(), path)


def verify(path: str) -> list[dict[str, Any]]:
    return archive.verify_files(active_session(), path)


def peek(path: str, batch_size: int | None = None, **options: Any) -> Iterator[list]:
    return archive.peek(active_session(), path, batch_size, **options)


def freeze_file(source: str, target: str, **options: Any) -> dict[str, Any]:
    return readers.freeze_file(active_session(), source, target, **options)


def freeze_stream(batches: Iterable[Any], target: str, **options: Any) -> dict[str, Any]:
    return readers.freeze_stream(active_session(), batches, target, **options)


def copy_archive(source: str, target: str, check: bool = True, attempts: int = 3) -> None:
    """Copy an archive between stores, manifest last; ``check`` compares the copies' digests."""
    archive.transfer(active_session(), source, target, check, attempts)


def diff(path_v1: str, path_v2: str, on: str | list[str] | None = None, **options: Any) -> Any:
    """Difference of two archives by ``on``, or by the primary key that the first or second declares."""
    spark = active_session()
    keys = on or archive.read_manifest(spark, path_v1).primary_key or archive.read_manifest(spark, path_v2).primary_key
    if not keys:
        a, b = (archive.row_numbers(spark, p, "__position") for p in (path_v1, path_v2))
        found = diffs.diff_positional(a, b, "__position", options.get("rtol", 1e-9))
        return found.summary() if options.get("output") == "summary" else found.frame()
    a, b = (archive.read_archive(spark, p) for p in (path_v1, path_v2))
    return diffs.diff(a, b, keys, **options)


def query(sql: str) -> DataFrame:
    """SQL over quoted archive paths and registered aliases."""
    return _front().query(sql)


def register(alias: str, path: str | None = None) -> str:
    return _front().register(alias, path)


def unregister(alias: str) -> bool:
    return _front().unregister(alias)


def registered() -> dict[str, str]:
    return _front().registered()


def set_path_resolver(resolver: Callable[[str], str] | None) -> None:
    """A function from the paths in SQL to the paths that are read, or None."""
    global _resolver
    _resolver = resolver


def detect(data: Any) -> detection.Detected:
    return detection.detect(active_session(), data)


def profile(df: DataFrame, **options: Any) -> profiles.Profile:
    return profiles.profile_table(df, **options)


def auto_select(df: DataFrame, **options: Any) -> dict[str, Any]:
    return profiles.auto_select(df, **options)
