"""The format ``coldlake`` for ``spark.read``: archives through the Python data source interface.

``read_archive`` is the fast way, since Spark's own Parquet reader does the work there. This format is
for callers that can only name a format. One archive file is one partition. With option ``pruning`` (and
``spark.sql.python.filterPushdown.enabled``) filters prune files; Spark evaluates them again in any case,
so pruning can never change a result.

Writing: each task writes one file and reports its rows, size and digest; the commit swaps the manifest,
so a failed write is never seen, and an abort deletes the files that tasks reported. Modes ``overwrite``
and ``append``; option ``codec`` names a Parquet codec. Files that are written so have no value ranges.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from coldlake.operators.filters import may_match
from coldlake.sources.manifest import MANIFEST_NAME, ArchiveFile, Manifest


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _store(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _open(path: str):
    store, place = _store(path)
    return store.open_input_file(place)


@dataclass
class _Written(WriterCommitMessage):
    task: int
    name: str
    rows: int
    bytes: int
    sha256: str


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, codec: str):
        self.path, self.schema, self.overwrite, self.codec = path.rstrip("/"), schema, overwrite, codec
        self.folder = f"data/w{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        context, writer, rows = TaskContext.get(), None, 0
        name = f"{self.folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet"
        store, place = _store(f"{self.path}/{name}")
        for batch in iterator:
            if writer is None and len(batch):
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                writer = pq.ParquetWriter(place, batch.schema, filesystem=store, compression=self.codec)
            if len(batch):
                writer.write_batch(batch)
                rows += len(batch)
        if writer is None:
            return _Written(context.partitionId(), "", 0, 0, "")
        writer.close()
        digest = hashlib.sha256()
        with store.open_input_stream(place) as file:
            while block := file.read(1 << 20):
                digest.update(block)
        return _Written(context.partitionId(), name, rows, store.get_file_info(place).size, digest.hexdigest())

    def commit(self, messages):
        store, place = _store(f"{self.path}/{MANIFEST_NAME}")
        manifest = None
        if store.get_file_info(place).is_file:
            with store.open_input_file(place) as file:
                manifest = Manifest.from_json(file.read().decode())
        schema = json.loads(self.schema.json())
        if manifest is None:
            manifest = Manifest(schema, [], self.codec, self.codec)
        elif self.overwrite:
            manifest = Manifest(schema, [], self.codec, self.codec, generation=manifest.generation + 1)
        else:
            if [f["name"] for f in manifest.schema["fields"]] != self.schema.names:
                raise ValueError(f"columns differ from the archive's: {manifest.columns}")
            if manifest.encryption is not None:
                raise ValueError("cannot append to an encrypted archive")
            manifest.generation += 1
        start = manifest.rows
        for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.task):
            manifest.files.append(ArchiveFile(m.name, m.rows, start, m.bytes, m.sha256))
            start += m.rows
        manifest.created = manifest.created or dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(place + ".new") as file:
            file.write(manifest.to_json().encode())
        store.move(place + ".new", place)

    def abort(self, messages):
        for m in messages:
            if m is not None and m.rows:
                store, place = _store(f"{self.path}/{m.name}")
                if store.get_file_info(place).is_file:
                    store.delete_file(place)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.wanted, self.spec = path.rstrip("/"), schema, {}
        with _open(f"{self.path}/{MANIFEST_NAME}") as file:
            self.manifest = Manifest.from_json(file.read().decode())
        if self.manifest.encryption is not None:
            raise PermissionError("the archive is encrypted; use read_archive with its key")

    def partitions(self):
        return [_File(f"{self.path}/{f.name}") for f in self.manifest.files if may_match(f.stats, self.spec, self.manifest.decimals)]

    def read(self, partition: _File) -> Iterator:
        import pyarrow.parquet as pq

        with _open(partition.path) as file:  # row groups are read one by one
            yield from pq.ParquetFile(file).iter_batches(columns=self.wanted.names)


class PruningReader(ArchiveReader):
    """A reader with filter pushdown, which Spark refuses unless the session has it switched on."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo):
                self.spec[name] = f.value
            elif isinstance(f, In):
                self.spec[name] = list(f.value)
            elif isinstance(f, GreaterThanOrEqual) and name not in self.spec:
                self.spec[name] = (f.value, None)
            elif isinstance(f, LessThanOrEqual) and name not in self.spec:
                self.spec[name] = (None, f.value)
            yield f  # pruning only: Spark keeps every filter


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "coldlake"

    def schema(self) -> StructType:
        with _open(f"{self.options['path'].rstrip('/')}/{MANIFEST_NAME}") as file:
            return StructType.fromJson(json.loads(file.read().decode())["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PruningReader if self.options.get("pruning", "").lower() == "true" else ArchiveReader
        return kind(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"], schema, overwrite, self.options.get("codec", "zstd"))


def register_format(spark) -> None:
    """Make ``spark.read.format("coldlake")`` and ``df.write.format("coldlake")`` known."""
    spark.dataSource.register(ArchiveSource)
