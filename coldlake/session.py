"""The façade over one archive root: write, read, query, diff and catalogue by name."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from coldlake.operators import diff as diffs
from coldlake.operators.catalog import Catalog
from coldlake.plans.sqlfront import SqlFront
from coldlake.sources import archive
from coldlake.sources.export import export


class ArchiveSession:
    """Archives named below ``root``, a catalogue in ``root/_catalog``, and SQL over both."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.catalog = Catalog(spark, f"{self.root}/_catalog")
        self.sql_front = SqlFront(spark)
        self._pool: ThreadPoolExecutor | None = None

    def path(self, name: str) -> str:
        return name if "/" in name else f"{self.root}/{name}"

    def freeze(self, df: DataFrame, name: str, register: bool = True, tags: list[str] | None = None, **options: Any):
        out = archive.write_archive(df, self.path(name), **options)
        if register:
            self.catalog.register(self.path(name), tags=tags, refresh=True)
        return out

    def freeze_async(self, df: DataFrame, name: str, **options: Any) -> Future:
        """``freeze`` in a thread; Spark schedules the jobs beside others."""
        self._pool = self._pool or ThreadPoolExecutor(4)
        return self._pool.submit(self.freeze, df, name, **options)

    @staticmethod
    def wait(job: Future, timeout: float | None = None) -> dict[str, Any]:
        return job.result(timeout)

    def unfreeze(self, name: str, output_format: str = "dataframe", sep: str = ",", **options: Any) -> Any:
        return export(archive.read_archive(self.spark, self.path(name), **options), output_format, sep)

    def append(self, df: DataFrame, name: str, **options: Any) -> dict[str, Any]:
        out = archive.append_archive(df, self.path(name), **options)
        if self.catalog.known(self.path(name)):
            self.catalog.register(self.path(name), refresh=True)
        return out

    def audit(self, name: str) -> dict[str, Any]:
        return archive.audit(self.spark, self.path(name))

    def peek(self, name: str, **options: Any):
        return archive.peek(self.spark, self.path(name), **options)

    def verify(self, name: str) -> list[dict[str, Any]]:
        return archive.verify_files(self.spark, self.path(name))

    def query(self, sql: str) -> DataFrame:
        return self.sql_front.query(sql)

    def register_alias(self, alias: str, name: str) -> str:
        return self.sql_front.register(alias, self.path(name))

    def list(self) -> list[str]:
        found = self.catalog.files.list(self.root)
        return [f.name for f in found if f.is_dir and self.catalog.files.exists(f"{f.path}/manifest.json")]

    def diff(self, v1: str, v2: str, on: str | list[str] | None = None, **options: Any) -> Any:
        """Difference of two archives by ``on``, else by the first primary key that is declared, else by
        row position."""
        keys = on
        for name in (v1, v2):
            keys = keys or archive.read_manifest(self.spark, self.path(name)).primary_key
        if not keys:
            a, b = (archive.row_numbers(self.spark, self.path(n), "__position") for n in (v1, v2))
            found = diffs.diff_positional(a, b, "__position", options.get("rtol", 1e-9))
            if options.get("output") == "summary":
                return found.summary()
            if options.get("output") == "dataframe":
                return found.frame()
            return {
                "inserted": found.inserted, "deleted": found.deleted,
                "changed": found.changed(options.get("changed_columns_only", False)), "summary": found.summary(),
            }
        a, b = (archive.read_archive(self.spark, self.path(n)) for n in (v1, v2))
        return diffs.diff(a, b, keys, **options)

    def close(self) -> None:
        if self._pool is not None:
            self._pool.shutdown()
            self._pool = None
