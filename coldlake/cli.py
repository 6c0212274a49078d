"""Command line: python -m coldlake COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from coldlake.operators.catalog import Catalog
from coldlake.operators.recipes import load_recipe, run_recipe
from coldlake.plans.sqlfront import SqlFront
from coldlake.sources import archive
from coldlake.sources.codecs import PARQUET_CODECS
from coldlake.sources.export import write_file
from coldlake.sources.readers import freeze_file


def _session() -> SparkSession:
    return SparkSession.builder.appName("coldlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _value(text: str):
    """A filter value: a number, true, false or null, a low..high range, a comma list, or text."""
    if ".." in text:
        low, high = text.split("..", 1)
        return (_value(low) if low else None, _value(high) if high else None)
    if "," in text:
        return [_value(part) for part in text.split(",")]
    try:
        return json.loads(text)
    except ValueError:
        return text


def parse_filters(items: Sequence[str]) -> dict:
    out = {}
    for item in items:
        name, mark, value = item.partition("=")
        if not mark:
            raise SystemExit(f"a filter is column=value, not {item!r}")
        out[name] = _value(value)
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="coldlake", description="Archives of rarely touched tables, on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("freeze", help="write a file or table as an archive")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--codec", default="zstd", choices=[*PARQUET_CODECS, "auto"])
    c.add_argument("--quant", type=int, default=0)
    c.add_argument("--chunk-rows", type=int, default=archive.DEFAULT_CHUNK_ROWS)
    c.add_argument("--partition-by", action="append")
    c.add_argument("--primary-key", action="append")
    c.add_argument("--comment", default="")
    c = commands.add_parser("freeze-recipe", help="run a recipe file")
    c.add_argument("recipe")
    c = commands.add_parser("unfreeze", help="write an archive's rows to .csv, .parquet or .jsonl")
    c.add_argument("archive")
    c.add_argument("target")
    c.add_argument("--filter", action="append", default=[], metavar="COLUMN=VALUE")
    c.add_argument("--rows", help="first..last, inclusive")
    c.add_argument("--verify", action="store_true")
    for name, text in (("audit", "what the manifest says"), ("verify", "compare all files with their digests")):
        commands.add_parser(name, help=text).add_argument("archive")
    c = commands.add_parser("query", help="run SQL with quoted archive paths")
    c.add_argument("sql")
    c.add_argument("--limit", type=int, default=50)
    c = commands.add_parser("catalog", help="register, search, cost, verify")
    c.add_argument("root")
    c.add_argument("action", choices=["register", "search", "cost", "verify"])
    c.add_argument("argument", nargs="?")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = _session()
    show = lambda x: print(json.dumps(x, indent=1, default=str, ensure_ascii=False))
    if a.command == "freeze":
        show(
            freeze_file(
                spark, a.source, a.target, codec=a.codec, quant=a.quant, chunk_rows=a.chunk_rows,
                partition_by=a.partition_by, primary_key=a.primary_key, comment=a.comment,
            )
        )
    elif a.command == "freeze-recipe":
        show(run_recipe(spark, load_recipe(spark, a.recipe)))
    elif a.command == "unfreeze":
        rows = tuple(int(x) for x in a.rows.split("..")) if a.rows else None
        found = archive.read_archive(spark, a.archive, verify=a.verify, filter=parse_filters(a.filter), row_range=rows, strict=True)
        write_file(found, a.target)
    elif a.command == "audit":
        show(archive.audit(spark, a.archive))
    elif a.command == "verify":
        found = archive.verify_files(spark, a.archive)
        show(found)
        return int(any(f["status"] not in ("OK", "NOT_HASHED") for f in found))
    elif a.command == "query":
        SqlFront(spark).query(a.sql).show(a.limit, truncate=False)
    elif a.command == "catalog":
        catalog = Catalog(spark, a.root)
        if a.action == "register":
            show(catalog.register_dir(a.argument, recursive=True) or catalog.register(a.argument))
        elif a.action == "search":
            catalog.search(name=a.argument).show(truncate=False)
        elif a.action == "cost":
            catalog.cost_report(a.argument or "glacier_deep").show(truncate=False)
        else:
            found = catalog.integrity_check(a.argument)
            found.show(truncate=False)
            return int(not found.where("status NOT IN ('OK', 'NOT_HASHED')").isEmpty())
    return 0


if __name__ == "__main__":
    sys.exit(main())
