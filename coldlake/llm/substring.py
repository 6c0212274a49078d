"""Removal of repeated passages by hashing normalised lines and keeping each line's first occurrence.

Units come in two steps. First, every line of at least ``line_words`` words is a unit. Second, since
shared passages also start and end in the middle of lines, so are windows of ``window_words`` words
across line ends, taken where the hash of the window is the least among half as many neighbouring
ones (winnowing). That choice depends on these words only: a repeated passage of at least
``window_words * 3 / 2 - 1`` words always has a window, at the same places wherever it stands, and
the windows taken cover it but for fewer than ``window_words / 2`` words at each end. Lines equal only lines, windows
only windows. Repeats shorter than the least sizes stay, so documents that share no more than a
licence line or a phrase are left alone; ``line_words=1`` removes repeated lines of any length.

1. Units are hashed to 128 bits after lower-casing A-Z and reducing white space; a document's digests
   are one row of a table in the shared folder.
2. Digests are grouped globally (with partial sums before the shuffle); of a repeated digest the
   document with the smallest id keeps it, and within that document its first place.
3. Repeated digests are joined back to the units that a Bloom filter of them lets through.
4. In each document with such units their words go, but for those that a unit's first place in
   the same document shares with it. Original offsets of what goes are kept, with the id of the
   document that holds the first occurrence of the run's first unit. All other documents pass by.

Null and empty texts have no units, an empty table gives an empty result, and long texts are read
whole. Rows that share an id rank alike, so none of them loses text to another; rows that share id
and text are treated alike. Null ids rank last. Other columns pass through; result columns replace
columns of their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.llm import exact
from coldlake.llm.common import bound_batches, free_name, materialise, release_memory
from coldlake.llm.shingles import ASCII_LOWER, WordHasher, mix

#: Least words of a line that is a unit, and words of a window; passages of 47 words or more are caught.
LINE_WORDS = WINDOW_WORDS = 32
_WORD = re.compile("[^\x20\x09-\x0d]+")
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_LINE = np.uint64(1 << 40)
_BASES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)
_POWERS: dict[int, np.ndarray] = {}
_LAST_RANK = (1 << 63) - 1
RESULT_COLUMNS = ("removed", "removed_words", "kept_text")


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, cached in blocks."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(1024, 2 * n), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have)
    return have[:n]


def _sums(codes: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(base, len(codes)))])


def _span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of the words from ``starts`` to before ``ends``, independent of the place."""
    return (sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), len(sums))[starts]


def _sliding(pick, values: np.ndarray, span: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``span`` neighbours, by doubling."""
    width = 1
    while width * 2 <= span:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[: len(values) - (span - width)], values[span - width :]) if width < span else values


def _windows(sums: np.ndarray, words: int) -> np.ndarray:
    """First words of the windows that are taken."""
    n = len(sums) - words
    if n <= 0:
        return np.empty(0, np.int64)
    rank = mix((sums[words:] - sums[:-words]) * _powers(pow(_BASES[0], -1, 1 << 64), n))
    span = min(max(1, words // 2), n)
    least = _sliding(np.minimum, rank, span)
    # taken if it is the least of any run that it is part of
    edge = np.zeros(span - 1, np.uint64)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), span) == rank)


class UnitFinder:
    """Units of texts; remembers the hashes of a bounded number of words."""

    def __init__(self, line_words: int = LINE_WORDS, window_words: int = WINDOW_WORDS, remember: int = 200_000):
        self.line_words, self.window_words, self.remember = line_words, window_words, remember
        self.hasher = WordHasher()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First words and ends in words of the windows and then the lines, and two 64-bit digests of each."""
        if len(self.hasher) > self.remember:
            self.hasher.clear()
        raw = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)
        words, first, last = [], [], []
        for line in raw.split(b"\n"):
            found = line.split()
            if len(found) >= self.line_words:
                first.append(len(words))
                last.append(len(words) + len(found))
            words += found
        if len(words) < min(self.window_words, self.line_words):
            nothing = np.empty(0, np.int64)
            return nothing, nothing, nothing.view(np.uint64), nothing.view(np.uint64)
        codes = np.fromiter(map(self.hasher.__getitem__, words), np.uint64, len(words))
        sums = _sums(codes, _BASES[0])
        windows = _windows(sums, self.window_words)
        starts = np.concatenate([windows, np.array(first, np.int64)])
        ends = np.concatenate([windows + self.window_words, np.array(last, np.int64)])
        kind = (ends - starts).astype(np.uint64)
        kind[len(windows) :] += _LINE
        one = _span_hashes(sums, starts, ends, _BASES[0])
        two = _span_hashes(_sums(codes ^ _OTHER, _BASES[1]), starts, ends, _BASES[1])
        return starts, ends, mix(one + kind), mix(two ^ kind)


def _hashed_units(text: str | None, find: UnitFinder):
    """Digests of the units, and whether a unit occurs more than once in the text."""
    _, _, a, b = find(text)
    order = np.argsort(a, kind="stable")
    same = a[order[1:]] == a[order[:-1]]
    more = np.zeros(len(a), bool)
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    return a.view(np.int64), b.view(np.int64), more


def _digests(docs: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """id, h and the units of (id, h, text): digests, and whether the text holds it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = UnitFinder(*sizes)
        for batch in batches:
            found = [_hashed_units(t.as_py(), find) for t in batch.column("text")]
            a = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
            b = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
            offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
            more = np.concatenate([f[2] for f in found] or [np.empty(0, bool)])
            pairs = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(more)], ["a", "b", "more"])
            units = pa.ListArray.from_arrays(pa.array(offsets), pairs)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), units], ["id", "h", "units"])
        release_memory()

    return docs.mapInArrow(run, "id long, h long, units array<struct<a:long,b:long,more:boolean>>")


def removed_spans(text: str, repeated: dict[int, tuple[bool, int]], find: UnitFinder):
    """Spans (start, end, first id) to remove from ``text`` and their number of words.

    ``repeated`` maps numbers of units to whether this document holds the first occurrence, and the
    id of the document that does.
    """
    starts, ends, a, b = find(text)
    gone, owner = None, {}
    seen: dict[tuple[int, int], int] = {}
    for number in sorted(repeated):
        own, first = repeated[number]
        start, end = int(starts[number]), int(ends[number])
        if own:
            place = seen.setdefault((int(a[number]), int(b[number])), start)
            if place == start:
                continue
            start = max(start, place + end - start)  # its first place stays whole
        if gone is None:
            places = [m.span() for m in _WORD.finditer(text)]
            gone = np.zeros(len(places) + 1, np.int8)
        gone[start:end] = 1
        owner.setdefault(start, first)
    if gone is None:
        return [], 0
    edges = np.flatnonzero(np.diff(gone, prepend=0))
    pairs = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    return [(places[x][0], places[y - 1][1], owner[x]) for x, y in pairs], int(gone.sum())


def cut_spans(text: str, spans: list[tuple]) -> str:
    """``text`` without the spans and the white space on their left, or their right at a line's start."""
    out, at = [], 0
    for start, end, _ in spans:
        piece = text[at:start]
        out.append(piece)
        at = end
        if not "".join(out[-1:]) or piece.endswith("\n"):
            while at < len(text) and text[at] in " \t":
                at += 1
        else:
            out[-1] = piece.rstrip(" \t")
    out.append(text[at:])
    return "".join(out)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    line_words: int = LINE_WORDS,
    window_words: int = WINDOW_WORDS,
) -> DataFrame:
    """``docs`` with removed (array of start, end, first_id), removed_words and kept_text.

    start and end are offsets in code points of the original text, which stays in its own column.
    """
    bound_batches(docs.sparkSession)
    sizes = (line_words, window_words)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_RANK))
    keyed = docs.select(rank.alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    table = materialise(_digests(keyed, sizes), "units")
    rows = table.select("id", "h", F.posexplode("units").alias("unit", "digest")).select("id", "h", "unit", "digest.*")
    groups = rows.groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups.select("a", "b", "first"), "repeated")
    bloom = exact.key_filter(groups.select(F.xxhash64("a", "b").alias("h")), groups.count())
    probed = exact.flag_repeated(rows.withColumn("probe", F.xxhash64("a", "b")), "probe", bloom, "hit")
    hits = probed.where("hit").select("id", "h", "unit", "a", "b", "more").join(groups, ["a", "b"])
    # where it occurs once, the first document's own unit takes nothing away
    hits = hits.where("id != first OR more")
    found = hits.groupBy("id", "h").agg(
        F.collect_set(F.struct("unit", (F.col("id") == F.col("first")).alias("own"), "first")).alias("hits")
    )
    found = found.where(F.exists("hits", lambda x: ~x["own"]) | (F.size("hits") > 1))
    found = materialise(found, "hits")

    kept = [c for c in docs.columns if c.lower() not in RESULT_COLUMNS]
    row, whole, key_id, key_h, flag, probe = (free_name(docs, x) for x in ("row", "whole", "key_id", "key_h", "touched", "probe"))
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias(row), F.col(text_col).alias(whole), rank.alias(key_id), F.xxhash64(text).alias(key_h)
    )
    bloom = exact.key_filter(found.select(F.xxhash64("id", "h").alias("h")), found.count())
    flagged = exact.flag_repeated(named.withColumn(probe, F.xxhash64(key_id, key_h)), probe, bloom, flag)
    touched = flagged.where(F.col(flag)).join(
        found.select(F.col("id").alias(key_id), F.col("h").alias(key_h), "hits"), [key_id, key_h], "left"
    )
    columns = [F.col(f"{row}.`{c}`") for c in kept]
    clear = flagged.where(~F.col(flag)).select(
        *columns,
        F.array().cast(REMOVED).alias("removed"),
        F.lit(0).cast("long").alias("removed_words"),
        F.coalesce(F.col(whole), F.lit("")).alias("kept_text"),
    )
    judged = touched.select(row, _cut(sizes)(F.col(whole), F.col("hits")).alias("cut"))
    return judged.select(*columns, "cut.*").unionByName(clear)


REMOVED = "array<struct<start:int,end:int,first_id:long>>"


def _cut(sizes: tuple[int, int]):
    """A function of (text, hits) that gives the result columns."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = UnitFinder(*sizes)
        for texts, all_hits in batches:
            removed, words, kept = [], [], []
            for text, hits in zip(texts, all_hits):
                text, spans, gone = text or "", [], 0
                if hits is not None and len(hits):
                    spans, gone = removed_spans(text, {h["unit"]: (h["own"], h["first"]) for h in hits}, find)
                removed.append([{"start": s, "end": e, "first_id": None if o == _LAST_RANK else o} for s, e, o in spans])
                words.append(gone)
                kept.append(cut_spans(text, spans) if spans else text)
            yield pd.DataFrame({"removed": removed, "removed_words": words, "kept_text": kept})
        release_memory()

    return F.pandas_udf(run, f"removed {REMOVED}, removed_words long, kept_text string")
