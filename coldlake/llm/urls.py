"""URL rules: a trie over reversed host labels, then path segments; the longest match decides.

A rule is a host with an optional path prefix (``example.net/en/``) and an action. It fits the host
itself and all its subdomains, if the url's path starts with the rule's path. Of several fitting
rules the one with more host labels wins, then the one with the longer path. Urls that no rule fits
get the default action.

The rule list is a parameter that a person maintains, so the trie is small and broadcast to the
executors; ``max_rules`` guards that bound.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path is what follows it up to ``?``, ``#`` or the end. A null url, or one without
``://``, has an empty host and path and gets the default action. Of equal rules the last one holds;
repeated rows are judged alike, long urls are read whole, an empty table gives an empty result.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import ascii_lower, free_name

MAX_RULES = 1_000_000


@dataclass
class _Node:
    children: dict[str, _Node] = field(default_factory=dict)
    #: Rules that end here: what the next path segment must start with, rule, action.
    ends: list[tuple[str, str, str]] = field(default_factory=list)
    path: _Node | None = None


class UrlTrie:
    """Immutable after construction from (action, rule) pairs; of equal rules the last one holds."""

    def __init__(self, rules: Iterable[tuple[str, str]], max_rules: int = MAX_RULES):
        self.root = _Node()
        self.default_root = None
        rules = list(dict((rule, action) for action, rule in rules).items())
        if len(rules) > max_rules:
            raise ValueError(f"{len(rules)} rules; the trie is sent to every executor, so at most {max_rules}")
        for rule, action in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action!r}")
            host, slash, rest = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.children.setdefault(label, _Node())
            node.path = node.path or _Node()
            node = node.path
            *whole, partial = (slash + rest).split("/") if slash else [""]
            for segment in whole:
                node = node.children.setdefault(segment, _Node())
            node.ends.append((partial, rule, action))
            node.ends.sort(key=lambda x: -len(x[0]))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its action."""
        node, found = self.root, [self.root]
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            found.append(node)
        segments = path.split("/")
        for node in reversed(found):
            if node.path is not None and (hit := self._longest(node.path, segments)):
                return hit
        return None

    @staticmethod
    def _longest(node: _Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for partial, rule, action in node.ends:
                if segment.startswith(partial):
                    best = (rule, action)
                    break
            node = node.children.get(segment)
            if node is None:
                break
        return best


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]], url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with columns host, path, rule (null if none fits) and verdict."""
    shared = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        trie = shared.value
        hits = [trie.match(h, p) or (None, default) for h, p in zip(hosts, paths)]
        return pd.DataFrame(hits, columns=["rule", "verdict"], dtype=object)

    decide = F.pandas_udf(decide, "rule string, verdict string")
    url = F.col(url_col)
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    split = pages.select(*keep, ascii_lower(host).alias("host"), path.alias("path"))
    judged = split.withColumn("rule", decide("host", "path"))
    return judged.select(*keep, "host", "path", F.col("rule.rule").alias("rule"), F.col("rule.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], url_col: str = "url", default: str = "allow"):
    """The rows of ``pages`` whose verdict is allow, with their own columns."""
    row = free_name(pages, "page")
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias(row), F.col(url_col).alias("url"))
    judged = judge_urls(whole, rules, "url", default).where("verdict = 'allow'")
    return judged.select(*[F.col(f"{row}.`{c}`") for c in pages.columns])
