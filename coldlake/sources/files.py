"""Small-file access through Hadoop's FileSystem, so that every store Spark reads works."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileInfo:
    path: str
    name: str
    length: int
    is_dir: bool
    modified: int


@dataclass(frozen=True)
class StoreUri:
    scheme: str
    bucket: str
    key: str


#: Accepted scheme of a uri, and the connector's scheme in Hadoop.
HADOOP_SCHEMES = {"s3": "s3a", "s3a": "s3a", "gs": "gs", "azure": "abfss", "az": "abfss", "abfss": "abfss", "hdfs": "hdfs"}


def parse_uri(uri: str) -> StoreUri:
    """Scheme, bucket and key of a storage uri; plain paths have scheme ``local``."""
    uri = uri.strip()
    scheme, mark, rest = uri.partition("://")
    if not mark:
        return StoreUri("local", "", uri)
    if scheme in ("http", "https"):
        raise ValueError(f"{scheme} uris cannot be archives; use s3://, gs:// or azure://")
    if scheme == "file":
        return StoreUri("local", "", rest)
    bucket, _, key = rest.partition("/")
    return StoreUri(scheme, bucket, key)


def hadoop_path(uri: str) -> str:
    """The uri with its connector's scheme; plain paths stay as they are."""
    scheme, mark, rest = uri.strip().partition("://")
    return f"{HADOOP_SCHEMES.get(scheme, scheme)}://{rest}" if mark else uri.strip()


class Files:
    """File operations on the store of each path."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(hadoop_path(path))
        return place.getFileSystem(self._conf), place

    def exists(self, path: str) -> bool:
        store, place = self._at(path)
        return store.exists(place)

    def read_text(self, path: str) -> str:
        store, place = self._at(path)
        stream = store.open(place)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write to a temporary name, then rename over the old file: a reader sees the old or the new content.

        Stores without an atomic rename get a delete and a rename.
        """
        store, place = self._at(path)
        temporary = self._jvm.org.apache.hadoop.fs.Path(f"{hadoop_path(path)}.{uuid.uuid4().hex}.tmp")
        stream = store.create(temporary, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self._conf)
            context.rename(temporary, place, options)
        except Py4JJavaError:
            if store.exists(place):
                store.delete(place, False)
            if not store.rename(temporary, place):
                raise OSError(f"cannot rename to {path}") from None

    def create_new(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet; False if another writer was first."""
        store, place = self._at(path)
        try:
            stream = store.create(place, False)
        except Exception as error:
            if "already exists" in str(error) or "FileAlreadyExists" in str(error):
                return False
            raise
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def list(self, path: str) -> list[FileInfo]:
        store, place = self._at(path)
        if not store.exists(place):
            return []
        found = store.listStatus(place)
        return sorted(
            (
                FileInfo(
                    x.getPath().toString(), x.getPath().getName(), x.getLen(), x.isDirectory(), x.getModificationTime()
                )
                for x in found
            ),
            key=lambda f: f.name,
        )

    def delete(self, path: str) -> bool:
        store, place = self._at(path)
        return store.exists(place) and store.delete(place, True)

    def copy(self, source: str, target: str) -> None:
        from_store, from_place = self._at(source)
        to_store, to_place = self._at(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(from_store, from_place, to_store, to_place, False, True, self._conf)
