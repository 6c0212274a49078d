"""Near-duplicate groups against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from coldlake.llm import minhash
from coldlake.llm.components import connected_components

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, percent=80):
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((len(sets[k]), min(ids, default=None)))
    return out


def corpus(seed, n=120):
    draw = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    bases = [[draw.choice(words) for _ in range(draw.randint(30, 120))] for _ in range(6)]
    rows = []
    for k in range(n):
        text = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 2, 3, 5, 9])):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((k, " ".join(text)))
    odd = [None, "", " \n ", "one", "One", "one two", "one two three", "a b c d", "A B\nC\tD", "x " * 5000, "\u00a0 \u00a0"]
    return rows + [(1000 + k, t) for k, t in enumerate(odd)] + [(3, rows[3][1]), (None, rows[5][1]), (None, "alone indeed here now")]


@pytest.mark.parametrize("seed, size, block_rows", [(1, 4, 256), (2, 5, 8)])
def test_brute_force(spark, monkeypatch, seed, size, block_rows):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(minhash, "LARGE_GROUP", 2 * block_rows)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicate_groups(docs, size=size).collect()
    want = sorted(map(str, ((i, n, c if c is not None else i, (c if c is not None else i) == i) for (i, _), (n, c) in zip(rows, brute(rows, size)))))
    assert sorted(map(str, (tuple(r) for r in got))) == want


def test_chain_costs_its_length(spark, monkeypatch):
    """A component of weakly similar texts in a chain is compared bucket by bucket, with all links found."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minhash, "LARGE_GROUP", 16)
    compare, costs, results = minhash._compare, {}, {}
    draw = random.Random(5)

    def counted(members, pairs, percent):
        if pairs is not None:
            seen.append(pairs.count())
        return compare(members, pairs, percent)

    monkeypatch.setattr(minhash, "_compare", counted)
    for n in (150, 600):
        line = ["c%d" % draw.randrange(10**6) for _ in range(12 * n + 100)]
        rows = [(k, " ".join(line[12 * k : 12 * k + 80])) for k in range(n)]
        # some steps of the chain are links
        rows += [(5000 + k, " ".join(line[12 * k + 4 : 12 * k + 80])) for k in range(0, n, 10)]
        seen = []
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicate_groups(docs, size=4).collect()}
        costs[n] = sum(seen)
        if n == 150:
            assert got == {i: c for (i, _), (_, c) in zip(rows, brute(rows, 4))}
        assert all(got[5000 + k] == k for k in range(0, n, 10))
    assert costs[150] > 0 and costs[600] < 6 * costs[150]


def test_filter_keeps_one_of_each_group(spark):
    rows = [(k, t, "x", k) for k, t in corpus(3) if k is not None and k != 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, hit int")
    got = minhash.drop_near_duplicates(docs, size=5)
    assert got.columns == docs.columns
    plain = brute([(r[0], r[1]) for r in rows], 5)
    want = sorted(r[0] for r, (n, c) in zip(rows, plain) if n == 0 or c == r[0])
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicate_groups(docs).collect() == []
    assert minhash.drop_near_duplicates(docs).collect() == []


def test_signatures_estimate_similarity():
    hasher, draw = minhash.MinMaxHasher(), np.random.default_rng(1)
    for share in (0.5, 0.8):
        same, errors = int(2000 * share), []
        for _ in range(20):
            a = draw.integers(0, 2**63, 2000).astype(np.uint64)
            b = np.concatenate([a[:same], draw.integers(0, 2**63, 2000 - same).astype(np.uint64)])
            errors.append((hasher.signature(a) == hasher.signature(b)).mean() - same / (4000 - same))
        assert abs(np.mean(errors)) < 0.03


@pytest.mark.parametrize("limit", [0, 10_000])
def test_components(spark, monkeypatch, limit):
    from coldlake.llm import components

    monkeypatch.setattr(components, "BROADCAST_EDGES", limit)
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(30)] + [(500, 500), (7, 3), (3, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {k: 0 for k in range(41)} | {200 + k: 100 for k in range(30)} | {100: 100}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_few_edges_take_no_rounds(spark):
    """A long path, which rounds would halve again and again, costs a few jobs if it is a small table."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "u long, v long").repartition(4)
    sc = spark.sparkContext
    sc.setJobGroup("few-edges", "components")
    try:
        got = dict(connected_components(edges).collect())
        assert len(sc.statusTracker().getJobIdsForGroup("few-edges")) <= 10
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(301), 0)


@pytest.mark.parametrize("local, broadcast", [(0, 0), (0, 10_000), (100, 10_000), (10_000, 0)])
def test_components_of_any_size_agree(spark, monkeypatch, local, broadcast):
    """In rounds, in one task, or in one task once rounds leave few enough edges."""
    from coldlake.llm import components

    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    monkeypatch.setattr(components, "BROADCAST_EDGES", broadcast)
    draw = random.Random(9)
    name = [draw.randrange(-(2**62), 2**62) for _ in range(80)]
    edges = [(name[a], name[draw.randrange(a % 4, 80, 4)]) for a in range(80) for _ in range(3)]
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert len(got) == len(want) and dict(got) == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
