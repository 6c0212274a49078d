"""Mixing: targets, the splitting tree, and the draw."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldlake.llm import mixing

WORDS = re.compile("[^\x20\x09-\x0d]+")


def test_targets():
    assert mixing.targets([100, 100], [1, 1], 1.5, 2) == [150, 150]
    got = mixing.targets([100, 900], [5, 1], 1.0, 2)
    assert got == [200, 800]
    assert mixing.targets([0, 10], [5, 1], 1.5, 2) == [0, 15]
    assert mixing.targets([], [], 1.5, 2) == []
    got = mixing.targets([10, 20, 30, 1000], [5, 2, 1, 5], 1.5, 2)
    assert got[:3] == [20, 40, 60] and abs(sum(got) - 1590) < 1e-6


def test_tree_is_exact_and_fair():
    quotas = np.array([1000, 37, 0, 3])
    counts = mixing.splitting_tree(quotas, 13, 1)
    assert (counts.sum(0) == quotas).all() and (counts >= 0).all()
    assert counts.sum(1).max() - counts.sum(1).min() <= 4  # 1040 over 13: halves round down at each of four levels
    first = np.array([mixing.splitting_tree(np.array([50, 50]), 4, s)[0, 0] for s in range(300)])
    assert abs(first.mean() - 12.5) < 0.5 and 1.0 < first.var() < 8.0  # hypergeometric: variance 4.7


def odd_docs(spark):
    rows = [(k, "w " * (k % 40 + 1), f"s{k % 4}", k) for k in range(400)]
    rows += [(1000, None, "s1", 0), (1001, "", None, 0), (1002, "é\u00a0x y\x0bz", None, 1), (1003, "big " * 30_000, "s2", 0), (5, "w " * 6, "s1", 5), (None, "q r", "", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, number int").repartition(3), rows


def test_mix(spark):
    docs, rows = odd_docs(spark)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)))
    taken = {}
    for r in got:
        assert r["size"] == len(WORDS.findall(r["text"] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert len(r["copies"]) * r["size"] == r["taken"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in names:
        largest = max(len(WORDS.findall(t or "")) for _, t, x, _ in rows if x == s)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1
    key = lambda r: (str(r["doc_id"]), r["taken"], str(r["copies"]))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_sources(docs.repartition(7)).collect()))


def test_documents(spark):
    docs, _ = odd_docs(spark)
    got = mixing.mixed_documents(docs, shards=5)
    assert got.columns == docs.columns
    assert got.count() == sum(len(r["copies"]) for r in mixing.mix_sources(docs, shards=5).collect())


def test_empty_and_clash(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty).collect() == []
    names = ["size", "taken", "whole", "blocks", "u", "from", "name", "kept0", "copy", "column0"]
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], "doc_id long, text string, source string")
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = mixing.mix_sources(wide)
    assert sorted(got.columns) == sorted({*wide.columns, *mixing.RESULT_COLUMNS})
    assert {(r["doc_id"], r["size"], r["whole"], r["column0"]) for r in got.collect()} == {(1, 2, 2, 9), (2, 1, 2, 9)}
    assert mixing.mixed_documents(wide).columns == wide.columns


def greedy(docs, gap):
    """Ids of the (u, size, id) taken once more, in hash order, skipping what does not fit."""
    out = set()
    for _, size, i in sorted(docs):
        if 0 < size <= gap and gap >= 1:
            out.add(i)
            gap -= size
    return out, gap


def test_against_brute_force(spark):
    """Documents of distinct sizes of two sources: the greedy rule, then no single exchange that helps."""
    draw = np.random.default_rng(3)
    for seed in (1, 2):
        rows = [(k, "w " * int(draw.integers(1, 400)), f"s{k % 2}") for k in range(160)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        u = {r[0]: r[1] for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 64 - mixing.HASH_BITS)).collect()}
        got = {r["doc_id"]: r for r in mixing.mix_sources(docs, weights=(3, 2), share=0.7, seed=seed).collect()}
        for s in ("s0", "s1"):
            own = [(u[i], len(t.split()), i) for i, t, x in rows if x == s]
            total = sum(n for _, n, _ in own)
            target = got[own[0][2]]["target"]
            whole = int(target // total)
            wanted, gap = greedy(own, target - whole * total)
            taken = {i for _, n, i in own if got[i]["taken"] == (whole + 1) * n}
            assert all(got[i]["taken"] in (whole * n, (whole + 1) * n) for _, n, i in own)
            left = target - sum(got[i]["taken"] for _, _, i in own)
            if gap < 1:
                assert taken == wanted
            assert abs(left) <= abs(gap) and len(taken ^ wanted) <= 8
            into, out = [0, *(n for _, n, i in own if i not in taken)], [0, *(n for _, n, i in own if i in taken)]
            assert abs(left) < 1 or min(abs(left - a + b) for a in into for b in out) >= abs(left) - 1e-6


def test_the_tree_decides(spark, monkeypatch):
    docs, rows = odd_docs(spark)
    key = lambda frame: sorted((str(r["doc_id"]), str(r["text"])[:9], r["taken"]) for r in frame.collect())
    assert key(mixing.mix_sources(docs, share=0.5, seed=1)) != key(mixing.mix_sources(docs, share=0.5, seed=2))
    drawn = mixing.mix_sources(docs).collect()
    shards = np.bincount([c["shard"] for r in drawn for c in r["copies"]], minlength=16)
    assert shards.min() > 0
    whole = mixing.splitting_tree
    # a tree that gives the first shards nothing, and one that gives none anything
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, s: np.concatenate([np.zeros((n // 2, len(q)), np.int64), whole(q, n - n // 2, s)]))
    assert all(c["shard"] >= 8 for r in mixing.mix_sources(docs).collect() for c in r["copies"])
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, s: np.zeros((n, len(q)), np.int64))
    assert {r["taken"] for r in mixing.mix_sources(docs).collect()} == {0}


def test_a_very_long_document_leaves_no_gap(spark):
    """At the threshold of a source of more than 2000 documents, where many short ones still fit."""
    for seed in range(4):
        rows = [(k, "w " * (90 + k % 21), "s") for k in range(2400)] + [(9000 + k, "w " * 60_000, "s") for k in range(3)]
        rows += [(k + 10_000, "v " * 50, "t") for k in range(2100)] + [(k + 10_000, "v " * 50, "t") for k in range(2)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = mixing.mix_sources(docs, weights=(1, 1), share=0.3, seed=seed).select("source", "size", "target", "taken", "copies").collect()
        for s, most in (("s", 1), ("t", 25)):
            own = [r for r in got if r["source"] == s]
            assert all(len(r["copies"]) * r["size"] == r["taken"] for r in own)
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= most
        shards = np.bincount([c["shard"] for r in got for c in r["copies"]], minlength=16)
        assert len(shards) == 16 and shards.min() > 0
