"""Exact dedup: groups, ties, hot groups, and filters too large to broadcast."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from coldlake.llm import exact

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [
    (1, "Hello World"), (2, "hello world"), (3, "HELLO WORLD!"), (4, None), (5, ""), (6, " "), (7, "Ärger"), (8, "ärger"),
    (None, "hello world"), (None, "alone"), (9, "same"), (9, "same"), (10, "x" * 200_000), (11, "X" * 200_000),
    *[(100 + k, "hot text") for k in range(300)],
]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return groups


@pytest.mark.parametrize("filter_bytes", [64 << 20, 4096, 1])
def test_groups(spark, filter_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    got = exact.duplicate_groups(docs, max_filter_bytes=filter_bytes).collect()
    groups = expected(ROWS)
    assert len(got) == len(ROWS)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r["text_sha256"]].append(r)
    assert len(by_sha) == len(groups)
    for text, ids in groups.items():
        rows = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in rows)
        best = max((i for i in ids if i is not None), default=None)
        assert {r["keep_id"] for r in rows} == {best} and {r["group_size"] for r in rows} == {len(ids)}
        kept = [r for r in rows if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == best


@pytest.mark.parametrize("filter_bytes", [64 << 20, 1])
def test_documents_keep_their_columns(spark, filter_bytes):
    rows = [(i, t, True, k, "bloom", 1, [2]) for k, (i, t) in enumerate(ROWS)]
    schema = "doc_id long, text string, repeated boolean, h int, sha string, repeated_block int, repeated__words array<int>"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = exact.drop_duplicates(docs, max_filter_bytes=filter_bytes)
    assert got.columns == docs.columns
    want = sorted(str(max((i for i in ids if i is not None), default=None)) for ids in expected(ROWS).values())
    assert sorted(str(r["doc_id"]) for r in got.collect()) == want


@pytest.mark.parametrize("filter_bytes", [64 << 20, 1])
def test_filter_flags_all_repeated_and_few_others(spark, filter_bytes):
    hashes = spark.range(40_000).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 4000).otherwise(F.col("id"))).alias("h"), "id")
    bloom = exact.repeated_filter(hashes.select("h"), 40_000, filter_bytes)
    assert bloom.broadcast == (filter_bytes > 1)
    flagged = exact.flag_repeated(hashes, "h", bloom, "hit").groupBy(F.col("id") % 10 == 0, "hit").count().collect()
    counts = {(r[0], r["hit"]): r["count"] for r in flagged}
    assert counts[True, True] == 4000 and (True, False) not in counts
    assert counts[False, True] < 0.08 * 36_000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.duplicate_groups(docs).collect() == []
    assert exact.drop_duplicates(docs).collect() == []


def test_native_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for df in (exact.duplicate_groups(docs), exact.drop_duplicates(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
