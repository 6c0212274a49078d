"""A searchable catalogue of archives: one JSON entry each, read by Spark as two tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldlake.operators.filters import FilterSpec
from coldlake.sources.archive import part_key, read_archive, read_manifest, verify_files
from coldlake.sources.files import Files

#: Storage price in USD for a GB and month, by tier.
STORAGE_PRICES = {"s3_standard": 0.023, "s3_ia": 0.0125, "glacier": 0.004, "glacier_deep": 0.00099}
QUANT_NAMES = ("lossless", "high", "medium", "low")

DATASET_SCHEMA = (
    "id string, name string, path string, version string, registered_at string, freeze_date string, codec string, "
    "quant_level int, orig_rows bigint, n_chunks int, chunk_rows int, file_size_bytes bigint, file_size_mb double, "
    "partition_col string, partition_keys string, columns string, comment string, tags string, schema_hash string, "
    "last_verified string, verified_ok boolean"
)
CHUNK_SCHEMA = (
    "chunk_id int, row_start bigint, row_end bigint, part_key string, part_col string, file string, byte_len bigint, "
    "sha256 string"
)


def search_datasets(
    datasets: DataFrame,
    name: str | None = None,
    codec: str | None = None,
    partition_col: str | None = None,
    partition_key: str | None = None,
    columns_contain: str | None = None,
    min_rows: int | None = None,
    max_mb: float | None = None,
    tags_contain: str | None = None,
    lossless_only: bool = False,
) -> DataFrame:
    """Datasets that meet all given conditions, newest first."""
    found = datasets
    for column, part in (("name", name), ("partition_keys", partition_key), ("columns", columns_contain), ("tags", tags_contain)):
        if part:
            found = found.where(F.col(column).contains(part))
    for column, value in (("codec", codec), ("partition_col", partition_col)):
        if value:
            found = found.where(F.col(column) == value)
    if min_rows:
        found = found.where(F.col("orig_rows") >= min_rows)
    if max_mb:
        found = found.where(F.col("file_size_mb") <= max_mb)
    if lossless_only:
        found = found.where(F.col("quant_level") == 0)
    return found.select(
        "id", "name", "codec", F.col("quant_level").alias("quant"), F.col("orig_rows").alias("rows"), "n_chunks",
        F.col("file_size_mb").alias("mb"), "partition_col", "freeze_date", "comment",
    ).orderBy(F.desc_nulls_last("freeze_date"), "name", "id")


def search_chunks(datasets: DataFrame, chunks: DataFrame, name: str, key: str | None = None) -> DataFrame:
    wanted = datasets.where(F.col("name").contains(name)).select(F.col("id").alias("dataset_id"))
    found = chunks.join(wanted, "dataset_id")
    if key:
        found = found.where(F.col("part_key").contains(key))
    kb = F.round(F.col("byte_len") / 1024.0, 1).alias("kb")
    return found.select("chunk_id", "row_start", "row_end", "part_key", "file", "byte_len", "sha256", kb).orderBy("chunk_id")


def dataset_versions(datasets: DataFrame, name: str) -> DataFrame:
    """Datasets of exactly that name, newest first."""
    columns = ["id", "name", "version", "path", "orig_rows", "file_size_mb", "freeze_date", "registered_at"]
    return datasets.where(F.col("name") == name).select(*columns).orderBy(F.desc_nulls_last("freeze_date"), "id")


def dataset_stats(datasets: DataFrame) -> DataFrame:
    """One row of totals."""
    per_thousand = F.col("file_size_mb") / F.nullif(F.col("orig_rows") / F.lit(1000.0), F.lit(0.0))
    return datasets.agg(
        F.count("*").alias("total_datasets"),
        F.sum("orig_rows").alias("total_rows"),
        F.sum("file_size_mb").alias("total_mb"),
        F.sum("n_chunks").cast("long").alias("total_chunks"),
        F.avg(per_thousand).alias("avg_mb_per_1k_rows"),
        F.count_distinct("codec").alias("distinct_codecs"),
        F.count_distinct("partition_col").alias("distinct_partitions"),
        F.count_if(F.col("quant_level") == 0).alias("lossless_count"),
        F.count_if(F.col("quant_level") > 0).alias("vault_count"),
    )


def cost_report(datasets: DataFrame, tier: str = "glacier_deep") -> DataFrame:
    """Estimated storage cost of each dataset, largest first."""
    if tier not in STORAGE_PRICES:
        raise ValueError(f"unknown tier {tier!r}; use one of {', '.join(STORAGE_PRICES)}")
    quant = F.element_at(F.array(*[F.lit(q) for q in QUANT_NAMES]), F.least(F.col("quant_level"), F.lit(3)) + 1)
    monthly = F.col("file_size_mb") / F.lit(1024.0) * F.lit(STORAGE_PRICES[tier])
    return datasets.select(
        "name", "codec", quant.alias("quant"), F.col("orig_rows").alias("rows"), F.col("file_size_mb").alias("size_mb"),
        "n_chunks", "freeze_date", monthly.alias("cost_monthly_usd"), (monthly * 12).alias("cost_annual_usd"),
        (monthly * 36).alias("cost_3yr_usd"), F.lit(tier).alias("tier"),
    ).orderBy(F.desc("size_mb"), "name")


class Catalog:
    """The catalogue kept under ``root``; every store that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _entry_path(self, dataset_id: str) -> str:
        return f"{self.root}/datasets/{dataset_id}.json"

    @staticmethod
    def _identify(path: str) -> tuple[str, str]:
        path = re.sub(r"^file:/+", "/", path.rstrip("/"))
        return path, hashlib.sha256(path.encode()).hexdigest()[:16]

    def known(self, path: str) -> bool:
        return self.files.exists(self._entry_path(self._identify(path)[1]))

    def register(
        self, path: str, name: str | None = None, version: str | None = None, tags: list[str] | None = None,
        refresh: bool = False,
    ) -> str:
        """Add an archive by its manifest; a path that is known keeps its id and is not added again.

        ``refresh`` brings a known entry up to the manifest; what is not given stays as it was.
        """
        path, dataset_id = self._identify(path)
        old: dict = {}
        if self.files.exists(self._entry_path(dataset_id)):
            if not refresh:
                return dataset_id
            old = json.loads(self.files.read_text(self._entry_path(dataset_id)))
            name, version = name or old["name"], old["version"] if version is None else version
            tags = [t for t in old["tags"].split(",") if t] if tags is None else tags
        m = read_manifest(self.spark, path)
        keys = [part_key(f, m) for f in m.files]
        entry = {
            "id": dataset_id,
            "name": name or path.rstrip("/").rsplit("/", 1)[-1].split(".")[0],
            "path": path,
            "version": version,
            "registered_at": old.get("registered_at") or dt.datetime.now(dt.timezone.utc).isoformat(),
            "freeze_date": m.created,
            "codec": m.codec_requested,
            "quant_level": m.quant,
            "orig_rows": m.rows,
            "n_chunks": len(m.files),
            "chunk_rows": m.chunk_rows,
            "file_size_bytes": m.stored_bytes,
            "file_size_mb": m.stored_bytes / 1e6,
            "partition_col": m.partition_by[0] if m.partition_by else None,
            "partition_keys": ",".join(sorted({k for k in keys if k is not None})),
            "columns": ",".join(m.columns),
            "comment": m.comment,
            "tags": ",".join(tags or []),
            "schema_hash": hashlib.sha256(json.dumps(sorted(m.columns)).encode()).hexdigest()[:16],
            "last_verified": None,
            "verified_ok": None,
            "chunks": [
                {
                    "chunk_id": k, "row_start": f.row_start, "row_end": f.row_end, "part_key": keys[k],
                    "part_col": m.partition_by[0] if m.partition_by else None, "file": f.name, "byte_len": f.bytes,
                    "sha256": f.sha256,
                }
                for k, f in enumerate(m.files)
            ],
        }
        self.files.write_text(self._entry_path(dataset_id), json.dumps(entry, ensure_ascii=False))
        return dataset_id

    def register_dir(self, root: str, recursive: bool = False) -> dict[str, str]:
        """Register all archives below a folder; path to id, or to ``error: ...``."""
        out: dict[str, str] = {}
        for found in self.files.list(root):
            if not found.is_dir:
                continue
            if self.files.exists(f"{found.path}/manifest.json"):
                try:
                    out[found.path] = self.register(found.path)
                except (ValueError, OSError) as error:
                    out[found.path] = f"error: {error}"
            elif recursive:
                out |= self.register_dir(found.path, True)
        return out

    def unregister(self, name: str) -> int:
        """Remove all datasets of exactly that name; the archives stay. The number removed."""
        found = [r["id"] for r in self.datasets.where(F.col("name") == name).select("id").collect()]
        for dataset_id in found:
            self.files.delete(self._entry_path(dataset_id))
        return len(found)

    def _entries(self) -> DataFrame:
        schema = f"{DATASET_SCHEMA}, chunks array<struct<{CHUNK_SCHEMA.replace(' ', ':').replace(',:', ', ')}>>"
        folder = f"{self.root}/datasets"
        if not [f for f in self.files.list(folder) if f.name.endswith(".json")]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(folder)

    @property
    def datasets(self) -> DataFrame:
        return self._entries().drop("chunks")

    @property
    def chunks(self) -> DataFrame:
        return self._entries().select(F.col("id").alias("dataset_id"), F.inline("chunks"))

    def search(self, **conditions: Any) -> DataFrame:
        return search_datasets(self.datasets, **conditions)

    def search_chunks(self, name: str, key: str | None = None) -> DataFrame:
        return search_chunks(self.datasets, self.chunks, name, key)

    def versions(self, name: str) -> DataFrame:
        return dataset_versions(self.datasets, name)

    def stats(self) -> dict[str, Any]:
        return dataset_stats(self.datasets).first().asDict()

    def cost_report(self, tier: str = "glacier_deep") -> DataFrame:
        return cost_report(self.datasets, tier)

    def sql(self, text: str) -> DataFrame:
        """A statement over the views ``datasets`` and ``chunks``."""
        session = self.spark.newSession()
        session.createDataFrame(self.datasets.collect(), DATASET_SCHEMA).createOrReplaceTempView("datasets")
        session.createDataFrame(self.chunks.collect(), f"dataset_id string, {CHUNK_SCHEMA}").createOrReplaceTempView("chunks")
        return session.sql(text)

    def read(self, name: str, version: str | None = None, filter: FilterSpec | None = None, **options: Any) -> DataFrame:
        """The newest dataset whose name contains ``name``, or of that version."""
        found = self.datasets.where(F.col("name").contains(name))
        if version is not None:
            found = found.where(F.col("version") == version)
        row = found.orderBy(F.desc_nulls_last("freeze_date"), F.desc("registered_at")).select("path").first()
        if row is None:
            raise KeyError(f"no dataset like {name!r}" + (f" of version {version}" if version else ""))
        return read_archive(self.spark, row["path"], filter=filter, **options)

    def integrity_check(self, name: str | None = None) -> DataFrame:
        """dataset, chunk file and status; notes the time and outcome in the entries."""
        rows = []
        for d in (self.datasets if name is None else self.datasets.where(F.col("name").contains(name))).collect():
            try:
                found = verify_files(self.spark, d["path"])
            except FileNotFoundError:
                found = [{"file": None, "status": "FILE_MISSING"}]
            rows += [(d["name"], f["file"], f["status"]) for f in found]
            entry = json.loads(self.files.read_text(self._entry_path(d["id"])))
            entry["last_verified"] = dt.datetime.now(dt.timezone.utc).isoformat()
            entry["verified_ok"] = all(f["status"] == "OK" for f in found)
            self.files.write_text(self._entry_path(d["id"]), json.dumps(entry, ensure_ascii=False))
        return self.spark.createDataFrame(rows, "dataset string, file string, status string")
