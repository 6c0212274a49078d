"""Recipes: small YAML files that say what to archive where, validated, run and watched."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession

from coldlake.sources.files import Files
from coldlake.sources.readers import freeze_file

#: Fixed values of recipe files.
CODECS = ("zstd", "lz4", "snappy", "fp16", "bf16", "int8", "vault", "lzma2")
PRIORITIES = ("low", "normal", "high")
MIN_CHUNK_ROWS = 1000
#: Recipe codecs that stand for zstd with a quantisation level.
QUANT_CODECS = {"fp16": 3, "bf16": 3, "int8": 2}


class RecipeError(ValueError):
    pass


@dataclass
class Recipe:
    name: str
    source: str
    output: str
    codec: str
    quant: int = 0
    chunk_rows: int = 100_000
    partition_by: str | None = None
    schedule: str | None = None
    enabled: bool = True
    timezone: str | None = None
    workers: int | None = None
    priority: str = "normal"
    retry: int = 2
    timeout_minutes: int = 0
    description: str | None = None
    owner: str | None = None
    tags: list[str] = field(default_factory=list)
    version: str = "1"

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def validate_recipe(raw: dict[str, Any]) -> list[str]:
    """Messages of what is wrong; empty for a valid recipe."""
    out = [f"{name}: required" for name in ("name", "source", "output", "codec") if not raw.get(name)]
    checks = (
        ("codec", lambda v: v in CODECS, f"one of {', '.join(CODECS)}"),
        ("quant", lambda v: isinstance(v, (int, float)) and v >= 0, "a number from 0"),
        ("chunk_rows", lambda v: isinstance(v, int) and v >= MIN_CHUNK_ROWS, f"an integer from {MIN_CHUNK_ROWS}"),
        ("priority", lambda v: v in PRIORITIES, f"one of {', '.join(PRIORITIES)}"),
    )
    return out + [f"{k}: must be {what}" for k, ok, what in checks if raw.get(k) not in (None, "") and not ok(raw[k])]


def parse_recipe(raw: dict[str, Any]) -> Recipe:
    if not isinstance(raw, dict):
        raise RecipeError("a recipe is a mapping")
    errors = validate_recipe(raw)
    if errors:
        raise RecipeError("; ".join(errors))
    known = {f.name for f in fields(Recipe)}
    values = {k: v for k, v in raw.items() if k in known and v is not None}
    if isinstance(values.get("tags"), str):
        values["tags"] = [t.strip() for t in values["tags"].split(",")]
    return Recipe(**values)


def load_recipe(spark: SparkSession, path: str) -> Recipe:
    import yaml

    return parse_recipe(yaml.safe_load(Files(spark).read_text(path)))


def run_recipe(spark: SparkSession, recipe: Recipe) -> dict[str, Any]:
    """Archive the source; retried as the recipe says. A disabled recipe does nothing."""
    if not recipe.enabled:
        return {"skipped": True}
    codec, quant = ("zstd", QUANT_CODECS[recipe.codec]) if recipe.codec in QUANT_CODECS else (recipe.codec, int(recipe.quant))
    for attempt in range(recipe.retry + 1):
        try:
            return freeze_file(
                spark, recipe.source, recipe.output, codec=codec, quant=quant, chunk_rows=recipe.chunk_rows,
                partition_by=recipe.partition_by, comment=(recipe.description or "")[:60],
            )
        except OSError:
            if attempt == recipe.retry:
                raise
    raise AssertionError("unreachable")


class RecipeWatcher:
    """Calls back for recipe files that appear, change or vanish in a folder, at each ``poll``."""

    def __init__(
        self, spark: SparkSession, folder: str, on_change: Callable[[str, Recipe], None],
        on_remove: Callable[[str], None] | None = None, extension: str = ".ice",
    ):
        self.spark, self.folder, self.extension = spark, folder, extension
        self.on_change, self.on_remove = on_change, on_remove
        self._seen: dict[str, tuple[int, int]] = {}

    def poll(self) -> dict[str, str]:
        """One look at the folder; path to error message of recipes that do not parse."""
        now = {f.path: (f.modified, f.length) for f in Files(self.spark).list(self.folder) if f.name.endswith(self.extension)}
        errors = {}
        for path in sorted(now):
            if self._seen.get(path) != now[path]:
                try:
                    self.on_change(path, load_recipe(self.spark, path))
                except RecipeError as error:
                    errors[path] = str(error)
        for path in sorted(set(self._seen) - set(now)):
            if self.on_remove:
                self.on_remove(path)
        self._seen = now
        return errors
