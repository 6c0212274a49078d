"""The pipeline's stages, each against a plain version on its own input."""

import base64
import hashlib
import re
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from coldlake.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, SF).toPandas()
        out.append(got)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert list(got.columns) == columns
            docs = spark.createDataFrame(got, schema=docs.schema)
    return out


def test_toxicity(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    import numpy as np

    def rejected(text):
        found = {model.vocabulary[t]: n for t, n in toxicity.toxicity_terms(text).items() if t in model.vocabulary}
        score = sum(model.weights[k] * np.log1p(n) for k, n in found.items())
        return model.probabilities(np.array([score]))[0, 0] >= model.reject_at

    want = {i for i, t in zip(steps[0]["doc_id"], steps[0]["text"]) if not rejected(t)}
    assert set(steps[1]["doc_id"]) == want and len(steps[1]) == len(want)


def test_exact(steps):
    best = {}
    for i, t in zip(steps[1]["doc_id"], steps[1]["text"]):
        key = t.translate(LOWER)
        best[key] = max(best.get(key, i), i)
    assert sorted(steps[2]["doc_id"]) == sorted(best.values())


def test_near(steps):
    sets = {}
    for i, t in zip(steps[2]["doc_id"], steps[2]["text"]):
        w = WORDS.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(steps[3]["doc_id"]) == sorted(i for i in sets if find(i) == i)


def test_mix(steps):
    size = {i: len(WORDS.findall(t)) for i, t in zip(steps[3]["doc_id"], steps[3]["text"])}
    source = dict(zip(steps[3]["doc_id"], steps[3]["source"]))
    names = sorted(set(source.values()))
    per = [sum(size[i] for i in size if source[i] == s) for s in names]
    want = mixing.targets(per, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)
    times = Counter(steps[4]["doc_id"])
    assert max(times.values()) <= 2
    for s, target in zip(names, want):
        taken = sum(size[i] * n for i, n in times.items() if source[i] == s)
        assert abs(taken - target) <= max(size[i] for i in size if source[i] == s) / 2 + 1


def test_tokens(steps):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(zip(steps[4]["doc_id"], steps[4]["text"]))
    assert Counter(steps[5]["doc_id"]) == Counter(steps[4]["doc_id"])
    for r in steps[5].itertuples():
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").toPandas()
    assert Counter(zip(got["doc_id"], got["n_tokens"])) == Counter(zip(steps[5]["doc_id"], steps[5]["n_tokens"]))
