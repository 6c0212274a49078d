"""The trained models: odd rows, held-out accuracy on the small tables, and their parts."""

import re
from collections import Counter

import numpy as np
import pytest

from coldlake.llm import labelled, line_crf, quality_knn, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 300_000), (5, "a b " * 40_000), (5, "a b " * 40_000), (None, "the and of"), (6, "\u00a0é漢字🙂")]
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "own", 7) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, kept int")


def unseen(df, labels):
    return df.join(labels, "doc_id").where(labelled.held_out("doc_id"))


def test_toxicity(tables):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    rows = unseen(toxicity.score_toxicity(docs, model), labels).select("toxic", "rejected", "severity").collect()
    assert sum(r["rejected"] == (r["toxic"] == 1) for r in rows) > 0.93 * len(rows)
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["rejected"] for r in clean) <= 0.02 * len(clean)


def test_toxicity_odd_rows(spark, tables, odd):
    docs, labels = tables
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(odd, model)
    assert got.count() == len(ODD) and not any(r["rejected"] for r in got.collect())
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    empty = spark.createDataFrame([], docs.schema)
    assert toxicity.score_toxicity(empty, model).collect() == []
    blank = toxicity.fit_toxicity(empty, labels)
    assert not any(r["rejected"] for r in toxicity.score_toxicity(odd, blank).collect())
    nulls = spark.createDataFrame([(None, 1, None), (1, None, None), (2, 0, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit_toxicity(docs, nulls).vocabulary == {}


def test_quality(tables):
    docs, labels = tables
    model = quality_knn.fit_quality(docs, labels)
    rows = unseen(quality_knn.score_quality(docs, model), labels).select("quality", "predicted", "score").collect()
    assert sum(r["quality"] == r["predicted"] for r in rows) > 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_odd_rows(spark, tables, odd):
    docs, labels = tables
    model = quality_knn.fit_quality(docs, labels)
    got = {r["doc_id"]: r for r in quality_knn.score_quality(odd, model).collect()}
    assert len(got) == len({i for i, _ in ODD})
    assert got[1]["score"] == got[2]["score"] == pytest.approx(model.prior)
    empty = spark.createDataFrame([], docs.schema)
    assert quality_knn.score_quality(empty, model).collect() == []
    prior_only = quality_knn.fit_quality(empty, labels)
    assert {r["score"] for r in quality_knn.score_quality(odd, prior_only).collect()} == {prior_only.prior}


def test_neighbours_are_exact():
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((700, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = draw.integers(0, 2, 700).astype(float)
    model = quality_knn.NeighbourModel({}, np.zeros(0), np.zeros((0, 8)), vectors, labels, 0.5)
    query = vectors[:600] + 0.1
    got = model.score(query)
    for k in range(0, 600, 50):
        near = query[k] @ vectors.T
        top = np.argsort(-near)[: model.neighbours]
        weight = np.maximum(near[top], 0)
        assert got[k] == pytest.approx((weight * labels[top]).sum() / weight.sum(), abs=1e-4)


def plain_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for k in range(len(w) - 2):
        if c[(w[k], w[k + 1], w[k + 2])] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), dup, len(covered)


def test_rules(spark, tables, odd):
    docs, labels = tables
    model = line_crf.fit_lines(docs, labels)
    for df in (docs, odd):
        got = line_crf.apply_rules(df, model).select(*[c for c in df.columns if c != "kept"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert len(got) == df.count()
        for r in got:
            want = plain_counts(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["base_failed"] and r["kept"])
    rows = unseen(line_crf.apply_rules(docs, model), labels).where("NOT base_failed").select("quality", "kept").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) >= 0.8 * sum(r["quality"] == 0 for r in rows)
    assert line_crf.apply_rules(spark.createDataFrame([], docs.schema), model).collect() == []


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(5)
    for _ in range(30):
        n, width = int(draw.integers(1, 8)), len(line_crf.FEATURES)
        features = draw.integers(0, 2, (n, width)).astype(np.float32)
        model = line_crf.LineModel(draw.standard_normal((width, 2)), draw.standard_normal((2, 2)))
        scores = features @ model.emission

        def value(path):
            return sum(scores[k, s] for k, s in enumerate(path)) + sum(model.transition[a, b] for a, b in zip(path, path[1:]))

        best = max(value([(m >> k) & 1 for k in range(n)]) for m in range(2**n))
        assert value(model.decode(features).tolist()) == pytest.approx(best)
