"""Archives: Parquet files with a manifest that readers trust.

Rows keep their order: a file is a contiguous run of rows, and a row's number is its file's
``row_start`` plus its index in the file. So row ranges prune files and need no stored ordinal.
Writers add files under a new generation folder and swap the manifest last; readers list only the
manifest's files, so a crashed append is never seen.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldlake.functions.transforms import csv_bytes
from coldlake.operators.contract import Contract, evolve
from coldlake.operators.filters import FilterSpec, apply_filter, as_scalar, may_match, normalise_columns
from coldlake.operators.profile import auto_select
from coldlake.sources.codecs import CODEC_PROFILES, column_options, parquet_options, quantise, seal, unseal
from coldlake.sources.files import Files, hadoop_path
from coldlake.sources.manifest import MANIFEST_NAME, MAX_COMMENT_BYTES, ArchiveFile, Manifest

DEFAULT_CHUNK_ROWS = 1_000_000
_STATS_TYPES = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


class IntegrityError(ValueError):
    """A file differs from what the manifest says."""


class AppendConflict(RuntimeError):
    """Another writer appended the same generation first."""


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}/{MANIFEST_NAME}"


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    files = Files(spark)
    if not files.exists(manifest_path(path)):
        raise FileNotFoundError(f"no archive at {path}")
    return Manifest.from_json(files.read_text(manifest_path(path)))


def _file_path(path: str, file: ArchiveFile) -> str:
    return f"{hadoop_path(path).rstrip('/')}/{file.name}"


def _write_files(
    df: DataFrame, path: str, generation: int, row_start: int, codec: str, chunk_rows: int, stats: list[str], sha: bool,
    options: dict[str, str] | None = None,
) -> list[ArchiveFile]:
    """Write ``df`` as a new generation of files and describe them, by distributed jobs."""
    spark = df.sparkSession
    folder = f"data/g{generation:06d}-{uuid.uuid4().hex[:8]}"
    target = f"{hadoop_path(path).rstrip('/')}/{folder}"
    writer = df.write.options(**parquet_options(codec), **(options or {})).option("maxRecordsPerFile", chunk_rows)
    writer.parquet(target)
    written = spark.read.schema(df.schema).parquet(target)
    name = F.col("_metadata.file_name")
    aggregates = [F.count("*").alias("rows"), F.first(F.col("_metadata.file_size")).alias("bytes")]
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    for k, c in enumerate(stats):
        col = F.col(f"`{c}`")
        if c in floating:  # NaN, which Spark orders last, is counted apart
            aggregates.append(F.count_if(F.isnan(col)).alias(f"nan{k}"))
            nulls = F.count_if(col.isNull()).alias(f"null{k}")
            col = F.when(~F.isnan(col), col)
            aggregates += [F.min(col).alias(f"low{k}"), F.max(col).alias(f"high{k}"), nulls]
            continue
        aggregates += [F.min(col).alias(f"low{k}"), F.max(col).alias(f"high{k}"), F.count_if(col.isNull()).alias(f"null{k}")]
    found = {r["file"]: r for r in written.groupBy(name.alias("file")).agg(*aggregates).collect()}
    digests = {}
    if sha and found:
        content = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(target)
        for r in content.select("path", F.sha2("content", 256).alias("sha")).collect():
            digests[r["path"].rsplit("/", 1)[-1]] = r["sha"]
    out = []
    for file in sorted(found, key=_place):
        r = found[file]
        ranges = {c: [as_scalar(r[f"low{k}"]), as_scalar(r[f"high{k}"]), r[f"null{k}"]] for k, c in enumerate(stats)}
        for k, c in enumerate(stats):
            if c in floating and r[f"nan{k}"]:
                ranges[c].append(r[f"nan{k}"])
        out.append(ArchiveFile(f"{folder}/{file}", r["rows"], row_start, r["bytes"], digests.get(file), ranges))
        row_start += r["rows"]
    return out


def _place(file: str) -> tuple[int, int, str]:
    """Order of a written file's rows: the task's number, then the file's number within the task."""
    task, number = re.search(r"part-(\d+)", file), re.search(r"-c(\d+)\.", file)
    return int(task[1]) if task else 0, int(number[1]) if number else 0, file


def write_archive(
    df: DataFrame,
    path: str,
    codec: str = "zstd",
    quant: int = 0,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    partition_by: None | str | Iterable[str] = None,
    comment: str = "",
    retention_days: int | None = None,
    key: bytes | None = None,
    primary_key: None | str | Iterable[str] = None,
    contract: Contract | None = None,
    codec_profile: str | None = None,
    column_encodings: dict[str, str] | None = None,
    sha256: bool = True,
    measure_csv: bool = False,
    overwrite: bool = True,
) -> dict[str, Any]:
    """Write ``df`` as an archive and return its figures.

    Rows are clustered by ``partition_by`` (range partitions, sorted within), so that each file
    covers a narrow range of keys. ``measure_csv`` also computes the size as CSV, for ratios.
    """
    if len(comment.encode()) > MAX_COMMENT_BYTES:
        raise ValueError(f"the comment is longer than {MAX_COMMENT_BYTES} bytes")
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    spark = df.sparkSession
    requested = CODEC_PROFILES[codec_profile] if codec_profile else codec
    if requested == "auto":
        choice = auto_select(df)
        requested, quant = choice["codec"], choice["quant"] or quant
    parquet_options(requested)
    if contract is not None:
        df = contract.apply(df)
    partition_by = normalise_columns(partition_by, df.columns)
    keys = [primary_key] if isinstance(primary_key, str) else list(primary_key or [])
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"primary key columns {missing} do not exist")
    orig_bytes = csv_bytes(df) if measure_csv else None
    df, transforms = quantise(df, quant)
    schema = df.schema
    if partition_by:
        columns = [F.col(f"`{c}`") for c in partition_by]
        df = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    files = Files(spark)
    if files.exists(manifest_path(path)):
        if not overwrite:
            raise FileExistsError(f"{path} exists")
        old = Manifest.from_json(files.read_text(manifest_path(path)))
        generation = old.generation + 1
    else:
        generation = 1
    stats = _stats_columns(schema, partition_by, keys) if key is None else []
    stored = df if key is None else seal(df, key)
    extra = column_options(column_encodings, schema.names)
    written = _write_files(stored, path, generation, 0, requested, chunk_rows, stats, sha256, extra)
    manifest = Manifest(
        schema=json.loads(schema.json()),
        files=written,
        codec=parquet_options(requested)["compression"],
        codec_requested=requested,
        quant=quant,
        chunk_rows=chunk_rows,
        partition_by=partition_by,
        primary_key=keys,
        comment=comment,
        created=dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
        retention_days=retention_days,
        orig_bytes=orig_bytes,
        contract=contract.to_dict() if contract else None,
        column_codecs=column_encodings or {},
        transforms=transforms,
        encryption={"algorithm": "AES-GCM", "scope": "column"} if key is not None else None,
        generation=generation,
    )
    files.write_text(manifest_path(path), manifest.to_json())
    return figures(manifest)


def _stats_columns(schema: T.StructType, partition_by: list[str], keys: list[str]) -> list[str]:
    kinds = {f.name: f.dataType for f in schema.fields}
    wanted = list(dict.fromkeys([*partition_by, *keys])) or [f.name for f in schema.fields][:8]
    return [c for c in wanted if isinstance(kinds[c], _STATS_TYPES)]


def figures(manifest: Manifest) -> dict[str, Any]:
    """The figures that writing reports."""
    stored = manifest.stored_bytes
    original = manifest.orig_bytes
    return {
        "rows": manifest.rows,
        "cols": len(manifest.columns),
        "n_chunks": len(manifest.files),
        "original_mb": None if original is None else original / 1e6,
        "stored_mb": stored / 1e6,
        "ratio": None if not original or not stored else original / stored,
        "reduction_pct": None if not original else 100.0 * (1 - stored / original),
        "codec": manifest.codec_requested,
        "quant": manifest.quant,
        "partition_cols": manifest.partition_by,
        "primary_key": manifest.primary_key,
        "encrypted": manifest.encryption is not None,
    }


def pruned_files(manifest: Manifest, filter: FilterSpec | None = None, row_range: tuple[int, int] | None = None):
    """Files that can hold rows of the filter and the inclusive row range."""
    out, decimals = [], manifest.decimals
    for f in manifest.files:
        if row_range is not None and (f.row_end <= row_range[0] or f.row_start > row_range[1]):
            continue
        if may_match(f.stats, filter, decimals):
            out.append(f)
    return out


def read_archive(
    spark: SparkSession,
    path: str,
    verify: bool = False,
    filter: FilterSpec | None = None,
    row_range: tuple[int, int] | None = None,
    key: bytes | None = None,
    schema: Contract | None = None,
    schema_override: T.StructType | None = None,
    columns: Iterable[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """The archive's rows, lazily. ``row_range`` is exact and inclusive and combines with ``filter``.

    ``verify`` compares the SHA-256 of every file that is read with the manifest first.
    """
    manifest = read_manifest(spark, path)
    if manifest.encryption is not None and key is None:
        raise PermissionError("the archive is encrypted; a key is needed")
    chosen = pruned_files(manifest, filter, row_range)
    if verify:
        bad = [r for r in verify_files(spark, path, manifest, chosen) if r["status"] != "OK"]
        if bad:
            raise IntegrityError(f"{len(bad)} of {len(chosen)} files differ from the manifest: {bad[0]}")
    df = apply_filter(_open_rows(spark, path, manifest, chosen, row_range, key), filter, strict)
    if schema is not None:
        df = schema.apply(df)
    elif schema_override is not None:
        df = evolve(df, schema_override)
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])


def _open_rows(
    spark: SparkSession, path: str, manifest: Manifest, chosen: list[ArchiveFile], row_range: tuple[int, int] | None, key: bytes | None
) -> DataFrame:
    """The chosen files' rows, decrypted."""
    full = T.StructType.fromJson(manifest.schema)
    if not chosen:
        return spark.createDataFrame([], full)
    if manifest.encryption is None:
        return _read_rows(spark, path, chosen, full, row_range)
    sealed = T.StructType([T.StructField(f.name, T.BinaryType()) for f in full.fields])
    return unseal(_read_rows(spark, path, chosen, sealed, row_range), full, key)


def _read_rows(
    spark: SparkSession, path: str, chosen: list[ArchiveFile], schema: T.StructType, row_range: tuple[int, int] | None
) -> DataFrame:
    """The files' rows; only files that a row range cuts (two at most) are filtered by row number."""
    reader = spark.read.schema(schema)
    first, last = row_range or (0, 1 << 62)
    whole = [f for f in chosen if first <= f.row_start and f.row_end - 1 <= last]
    parts = [reader.parquet(*[_file_path(path, f) for f in whole])] if whole else []
    for f in chosen:
        if not (first <= f.row_start and f.row_end - 1 <= last):
            number = F.col("_metadata.row_index") + f.row_start
            cut = reader.parquet(_file_path(path, f)).where(number.between(first, last))
            parts.append(cut.select(*[F.col(f"`{c}`") for c in schema.names]))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def append_archive(
    df: DataFrame, path: str, verify: bool = True, sha256: bool = True, comment: str | None = None
) -> dict[str, Any]:
    """Add rows to an archive; all or nothing. Column names must be the archive's; types are cast to its.

    ``comment`` replaces the archive's comment with the same manifest swap.
    """
    spark = df.sparkSession
    began = dt.datetime.now()
    manifest = read_manifest(spark, path)
    if manifest.encryption is not None:
        raise ValueError("cannot append to an encrypted archive")
    names = manifest.columns
    if set(df.columns) != set(names):
        gone, new = sorted(set(names) - set(df.columns)), sorted(set(df.columns) - set(names))
        raise ValueError(f"columns differ: missing {gone}, extra {new}")
    full = T.StructType.fromJson(manifest.schema)
    df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in full.fields])
    if verify:
        bad = [r for r in verify_files(spark, path, manifest) if r["status"] != "OK"]
        if bad:
            raise IntegrityError(f"the archive is damaged: {bad[0]}")
    df, _ = quantise(df, manifest.quant)
    if manifest.partition_by:
        df = df.repartitionByRange(*manifest.partition_by).sortWithinPartitions(*manifest.partition_by)
    generation = manifest.generation + 1
    stats = _stats_columns(full, manifest.partition_by, manifest.primary_key)
    chunk_rows = manifest.chunk_rows or DEFAULT_CHUNK_ROWS
    new = _write_files(df, path, generation, manifest.rows, manifest.codec_requested, chunk_rows, stats, sha256, column_options(manifest.column_codecs, names))
    files = Files(spark)
    lock = f"{path.rstrip('/')}/.generation-{generation}"
    if not files.create_new(lock, ""):
        raise AppendConflict(f"generation {generation} of {path} was written by another append")
    manifest.files += new
    manifest.generation = generation
    manifest.orig_bytes = None
    manifest.comment = manifest.comment if comment is None else comment
    files.write_text(manifest_path(path), manifest.to_json())
    return {
        "appended_rows": sum(f.rows for f in new),
        "total_rows": manifest.rows,
        "total_chunks": len(manifest.files),
        "append_s": (dt.datetime.now() - began).total_seconds(),
    }


def transfer(spark: SparkSession, source: str, target: str, check: bool = True, attempts: int = 3) -> None:
    """Copy an archive between stores, its manifest last.

    Files of the right size that an interrupted copy left at the target are not copied again. With
    ``check`` the digests of all files decide; those that differ are copied anew, ``attempts`` times.
    """
    files, manifest = Files(spark), read_manifest(spark, source)
    source, target = source.rstrip("/"), target.rstrip("/")
    folders = {f.name.rsplit("/", 1)[0] for f in manifest.files}
    there = {f"{d}/{i.name}": i.length for d in folders for i in files.list(f"{target}/{d}")}
    todo = [f for f in manifest.files if there.get(f.name) != f.bytes]
    for left in range(attempts - 1, -1, -1):
        bad = set()
        for f in todo:
            try:
                files.copy(f"{source}/{f.name}", f"{target}/{f.name}")
            except Py4JJavaError:
                if not left:
                    raise
                bad.add(f.name)
        if check:
            bad |= {r["file"] for r in verify_files(spark, target, manifest) if r["status"] not in ("OK", "NOT_HASHED")}
        todo = [f for f in manifest.files if f.name in bad]
        if not todo:
            break
    if todo:
        raise IntegrityError(f"{len(todo)} copied files differ, {todo[0].name} among them")
    files.write_text(manifest_path(target), manifest.to_json())


def verify_files(
    spark: SparkSession, path: str, manifest: Manifest | None = None, only: list[ArchiveFile] | None = None
) -> list[dict[str, Any]]:
    """file and status (OK, CORRUPTED, FILE_MISSING, NOT_HASHED) of the archive's files.

    Executors read and hash the files; the driver compares one digest a file.
    """
    manifest = manifest or read_manifest(spark, path)
    wanted = manifest.files if only is None else only
    present: dict[str, str] = {}
    files = Files(spark)
    folders = {f.name.rsplit("/", 1)[0] for f in wanted}
    there = {f"{d}/{i.name}" for d in folders for i in files.list(f"{path.rstrip('/')}/{d}")}
    paths = [_file_path(path, f) for f in wanted if f.name in there and f.sha256]
    if paths:
        content = spark.read.format("binaryFile").load(paths)
        for r in content.select("path", F.sha2("content", 256).alias("sha")).collect():
            present["/".join(r["path"].rsplit("/", 3)[-3:])] = r["sha"]
    out = []
    for f in wanted:
        if f.name not in there:
            status = "FILE_MISSING"
        elif not f.sha256:
            status = "NOT_HASHED"
        else:
            status = "OK" if present.get(f.name) == f.sha256 else "CORRUPTED"
        out.append({"file": f.name, "status": status})
    return out


def audit(spark: SparkSession, path: str) -> dict[str, Any]:
    """What the manifest says, without reading a data file."""
    m = read_manifest(spark, path)
    return {
        **figures(m),
        "path": path,
        "version": m.version,
        "generation": m.generation,
        "chunk_rows": m.chunk_rows,
        "comment": m.comment,
        "created": m.created,
        "retention_days": m.retention_days,
        "columns": m.columns,
        "schema": m.schema,
        "transforms": m.transforms,
        "parquet_codec": m.codec,
        "orig_rows": m.rows,
        "file_size_bytes": m.stored_bytes,
        "hashed": all(f.sha256 for f in m.files),
        "chunks": [
            {"chunk_id": k, "row_start": f.row_start, "row_end": f.row_end, "bytes": f.bytes, "part_key": part_key(f, m)}
            for k, f in enumerate(m.files)
        ],
    }


def part_key(file: ArchiveFile, manifest: Manifest) -> str | None:
    """One value, or ``low-high``, of the file's first partition column."""
    if not manifest.partition_by or manifest.partition_by[0] not in file.stats:
        return None
    low, high, _ = file.stats[manifest.partition_by[0]]
    return None if low is None else f"{low}" if low == high else f"{low}-{high}"


def peek(
    spark: SparkSession, path: str, batch_size: int | None = None, **options: Any
) -> Iterator[list[Any]]:
    """Batches of rows in stored order with bounded memory: 10,000 rows each, or ``batch_size``.

    Files are read one after the other, since one scan of many files does not keep their order.
    """
    held: list[Any] = []
    manifest = read_manifest(spark, path)
    chosen = pruned_files(manifest, options.get("filter"), options.get("row_range"))
    if not chosen:  # for the options' checks
        read_archive(spark, path, **options)
    first, last = options.pop("row_range", None) or (0, 1 << 62)
    for f in chosen:
        inside = (max(first, f.row_start), min(last, f.row_end - 1))
        for row in read_archive(spark, path, row_range=inside, **options).toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == (batch_size or 10_000):
                yield held
                held = []
    if held:
        yield held


def compact(spark: SparkSession, path: str, chunk_rows: int | None = None) -> dict[str, Any]:
    """Rewrite the archive's files to ``chunk_rows`` rows each, in the same row order.

    One shuffle: a row's number says which file it goes to. All else of the manifest stays.
    """
    m = read_manifest(spark, path)
    if m.encryption is not None:
        raise ValueError("cannot compact an encrypted archive")
    chunk = chunk_rows or m.chunk_rows or DEFAULT_CHUNK_ROWS
    full = T.StructType.fromJson(m.schema)
    place = "row_number"
    while place.lower() in {c.lower() for c in m.columns}:
        place += "_"
    rows = row_numbers(spark, path, place)
    pieces = max(1, -(-m.rows // chunk))
    dealt = rows.repartitionById(pieces, (F.col(place) / chunk).cast("int")).sortWithinPartitions(place).drop(place)
    stats = _stats_columns(full, m.partition_by, m.primary_key)
    hashed = all(f.sha256 for f in m.files)
    options = column_options(m.column_codecs, m.columns)
    m.generation += 1
    m.files = _write_files(dealt, path, m.generation, 0, m.codec_requested, chunk, stats, hashed, options)
    m.chunk_rows = chunk
    Files(spark).write_text(manifest_path(path), m.to_json())
    return figures(m)


def row_numbers(spark: SparkSession, path: str, name: str = "row_number") -> DataFrame:
    """The archive's rows with their numbers from 0, in stored order."""
    m = read_manifest(spark, path)
    full = T.StructType.fromJson(m.schema)
    if m.encryption is not None:
        raise ValueError("row numbers need an archive that is not encrypted")
    if not m.files:
        return spark.createDataFrame([], full.add(name, T.LongType()))
    df = spark.read.schema(full).parquet(*[_file_path(path, f) for f in m.files])
    # one row a file: bounded by the manifest that the driver holds anyway
    starts = spark.createDataFrame([(f.name.rsplit("/", 1)[-1], f.row_start) for f in m.files], "__file string, __start long")
    placed = df.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    placed = placed.join(F.broadcast(starts), "__file")
    return placed.select(*[F.col(f"`{c}`") for c in full.names], (F.col("__start") + F.col("__index")).alias(name))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete generation folders that the manifest does not name, and locks that crashed appends left.

    Not while a write is running.
    """
    files, m = Files(spark), read_manifest(spark, path)
    used = {f.name.split("/")[1] for f in m.files}
    gone = [f for f in files.list(f"{path.rstrip('/')}/data") if f.is_dir and f.name not in used]
    locks = [f for f in files.list(path) if f.name.startswith(".generation-")]
    for f in [*gone, *locks]:
        files.delete(f.path)
    return [f.name for f in gone]
