"""Copies of remote archives in a nearer store, for archives that are read again and again.

The cache is a folder that all executors share. A copy is current as long as the remote manifest is
the one that it was made from; within ``ttl`` seconds of the last look that is taken for granted.
The copies that were used least recently go when all together pass ``max_bytes``.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from coldlake.sources.archive import manifest_path, read_manifest, transfer
from coldlake.sources.files import Files, parse_uri

TTL_SECONDS = 3600
MAX_BYTES = 5 << 30


class ArchiveCache:
    """``resolve`` can be given to ``set_path_resolver``, so that SQL reads the copies."""

    def __init__(
        self, spark: SparkSession, folder: str, ttl: float = TTL_SECONDS, max_bytes: int = MAX_BYTES, clock: Callable[[], float] = time.time
    ):
        self.spark, self.folder, self.ttl, self.max_bytes, self.clock = spark, folder.rstrip("/"), ttl, max_bytes, clock
        self.files = Files(spark)

    def _notes(self) -> dict[str, dict]:
        path = f"{self.folder}/cache.json"
        return json.loads(self.files.read_text(path)) if self.files.exists(path) else {}

    def resolve(self, uri: str) -> str:
        """The path of a current copy; local paths stay as they are, as do archives larger than the cache."""
        if parse_uri(uri).scheme == "local":
            return uri
        return self.fetch(uri)

    def fetch(self, uri: str) -> str:
        notes, now = self._notes(), self.clock()
        note = notes.get(uri)
        if note is None or now - note["seen"] > self.ttl:
            version = hashlib.sha256(self.files.read_text(manifest_path(uri)).encode()).hexdigest()
            if note is None or note["version"] != version:
                manifest = read_manifest(self.spark, uri)
                if manifest.stored_bytes > self.max_bytes:
                    return uri
                path = f"{self.folder}/{hashlib.sha256(uri.encode()).hexdigest()[:16]}-{version[:16]}"
                transfer(self.spark, uri, path)
                if note is not None:
                    self.files.delete(note["path"])
                note = {"path": path, "version": version, "bytes": manifest.stored_bytes}
            note["seen"] = now
        note["used"] = now
        notes[uri] = note
        for other in sorted(notes, key=lambda u: notes[u]["used"]):
            if sum(n["bytes"] for n in notes.values()) <= self.max_bytes:
                break
            if other != uri:
                self.files.delete(notes.pop(other)["path"])
        self.files.write_text(f"{self.folder}/cache.json", json.dumps(notes))
        return note["path"]
