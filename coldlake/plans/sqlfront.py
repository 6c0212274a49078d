"""SQL with archives named directly: quoted paths and registered aliases after FROM, JOIN or a comma.

The text is rewritten by the position of each match, so a path may appear twice, and only where a
relation can stand: strings elsewhere, comments and names of CTEs are left alone. Filters are not
scraped from the text; Catalyst pushes them down.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coldlake.operators.detect import read_csv
from coldlake.sources.archive import read_archive
from coldlake.sources.files import Files

Reader = Callable[[SparkSession, str], DataFrame]

_TOKEN = re.compile(
    r"--[^\n]*|/\*.*?\*/"  # comments
    r"|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`"  # strings and quoted names
    r"|[A-Za-z_][A-Za-z_0-9]*|\(|\)|,|\s+|.",
    re.DOTALL,
)
#: Words that end a FROM clause on their level.
_CLAUSE_ENDS = frozenset("where group having order limit offset window union intersect except select qualify lateral on using set".split())
_PATH_HINT = re.compile(r"[/\\.]")


class SqlError(ValueError):
    """The rewritten statement failed; the message holds it."""


def find_relations(sql: str) -> list[tuple[int, int, str]]:
    """(start, end, path) of each quoted path that stands where a relation can."""
    out, stack = [], [[False, False]]  # of each level: inside a FROM list, a relation may come next
    for m in _TOKEN.finditer(sql):
        token = m.group()
        if token.isspace() or token.startswith(("--", "/*")):
            continue
        level = stack[-1]
        word = token.lower()
        if token == "(":
            stack.append([level[1], level[1]])  # FROM ( ... lists relations as well
        elif token == ")":
            if len(stack) > 1:
                stack.pop()
            stack[-1][1] = False
        elif word in ("from", "join"):
            stack[-1] = [True, True]
        elif word in _CLAUSE_ENDS:
            stack[-1] = [word in ("on", "using") and level[0], False]
        elif token == ",":
            level[1] = level[0]
        else:
            if level[1] and token[0] in "'\"" and _PATH_HINT.search(token):
                quote = token[0]
                out.append((m.start(), m.end(), token[1:-1].replace(quote * 2, quote)))
            level[1] = False
    return out


class SqlFront:
    """Aliases and statements of one session."""

    def __init__(self, spark: SparkSession, reader: Reader | None = None):
        self.spark = spark
        self._reader = reader or read_relation
        self._aliases: dict[str, str] = {}
        self._lock = threading.Lock()

    def register(self, alias: str, path: str | None = None) -> str:
        """Name an archive; with one argument the alias is the path's last part without extension."""
        if path is None:
            alias, path = re.sub(r"\W", "_", alias.rstrip("/").rsplit("/", 1)[-1].split(".")[0]), alias
        if not re.fullmatch(r"[A-Za-z_]\w*", alias):
            raise ValueError(f"{alias!r} cannot be an alias")
        if not Files(self.spark).exists(path):
            raise FileNotFoundError(path)
        with self._lock:
            self._aliases[alias] = path
        self._reader(self.spark, path).createOrReplaceTempView(alias)
        return alias

    def unregister(self, alias: str) -> bool:
        with self._lock:
            known = self._aliases.pop(alias, None) is not None
        if known:
            self.spark.catalog.dropTempView(alias)
        return known

    def registered(self) -> dict[str, str]:
        with self._lock:
            return dict(self._aliases)

    def rewrite(self, sql: str) -> tuple[str, dict[str, str]]:
        """The statement with views for quoted paths, and view to path."""
        views: dict[str, str] = {}
        out, at = [], 0
        for start, end, path in find_relations(sql):
            name = next((v for v, p in views.items() if p == path), None)
            if name is None:
                stem = re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]) or "table"
                name = f"__archive_{len(views)}_{stem}"
                views[name] = path
            out += [sql[at:start], f"`{name}`"]
            # a relation named by its stem stays addressable, unless an alias follows
            if not re.match(r"\s+(?:as\s+)?(?!(?:%s|join|inner|left|right|full|cross|natural|anti|semi|tablesample)\b)[A-Za-z_`\"]" % "|".join(_CLAUSE_ENDS), sql[end:], re.I):
                stem = re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1].split(".")[0])
                if re.fullmatch(r"[A-Za-z_]\w*", stem):
                    out.append(f" AS `{stem}`")
            at = end
        out.append(sql[at:])
        return "".join(out), views

    def query(self, sql: str) -> DataFrame:
        """The statement's result, lazily."""
        text, views = self.rewrite(sql)
        for name, path in views.items():
            self._reader(self.spark, path).createOrReplaceTempView(name)
        try:
            return self.spark.sql(text)
        except Exception as error:
            raise SqlError(f"{error}\nstatement: {text}") from error
        finally:
            for name in views:  # the analysed plan no longer needs the names
                self.spark.catalog.dropTempView(name)


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """An archive, or a CSV, JSON lines or Parquet path."""
    files = Files(spark)
    if files.exists(f"{path.rstrip('/')}/manifest.json"):
        return read_archive(spark, path)
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.json(path, multiLine=kind == "json")
    return spark.read.parquet(path)
