"""The manifest beside an archive's Parquet files: what readers trust, and all that audits read."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any

MANIFEST_NAME = "manifest.json"
FORMAT_VERSION = 1
MAX_COMMENT_BYTES = 255


@dataclass
class ArchiveFile:
    """One Parquet file: the contiguous rows [row_start, row_end) of the archive."""

    name: str
    rows: int
    row_start: int
    bytes: int
    sha256: str | None = None
    #: Column to [smallest, largest value as JSON scalars, number of nulls].
    stats: dict[str, list] = field(default_factory=dict)

    @property
    def row_end(self) -> int:
        return self.row_start + self.rows


@dataclass
class Manifest:
    schema: dict[str, Any]
    files: list[ArchiveFile]
    codec: str = "zstd"
    codec_requested: str = "zstd"
    quant: int = 0
    chunk_rows: int = 0
    partition_by: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    comment: str = ""
    created: str = ""
    retention_days: int | None = None
    orig_bytes: int | None = None
    contract: dict[str, Any] | None = None
    column_codecs: dict[str, str] = field(default_factory=dict)
    transforms: dict[str, str] = field(default_factory=dict)
    encryption: dict[str, Any] | None = None
    generation: int = 1
    version: int = FORMAT_VERSION

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.files)

    @property
    def stored_bytes(self) -> int:
        return sum(f.bytes for f in self.files)

    @property
    def columns(self) -> list[str]:
        return [f["name"] for f in self.schema["fields"]]

    @property
    def decimals(self) -> frozenset[str]:
        """Columns whose stored ranges are decimal numbers as text."""
        return frozenset(f["name"] for f in self.schema["fields"] if str(f["type"]).startswith("decimal"))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        if not isinstance(raw, dict) or "schema" not in raw or "files" not in raw:
            raise ValueError("not an archive manifest")
        if raw.get("version", 0) > FORMAT_VERSION:
            raise ValueError(f"archive format {raw['version']} is newer than {FORMAT_VERSION}")
        known = {f.name for f in fields(cls)}
        values = {k: v for k, v in raw.items() if k in known}
        values["files"] = [ArchiveFile(**f) for f in raw["files"]]
        return cls(**values)
