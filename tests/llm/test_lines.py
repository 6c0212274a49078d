"""Line labelling: borders between boilerplate and content, decoding, and drawn windows."""

import itertools
import random

import numpy as np

from coldlake.llm import line_crf as crf

WORDS = "alder birch cedar maple willow stone river meadow cloud winter summer garden letter window village market".split()


def page(draw, good):
    """Lines and whether each is content: boilerplate head and tail round content, or nearly all boilerplate."""

    def content():
        return " ".join(draw.choice(WORDS) for _ in range(draw.randint(9, 22))).capitalize() + ".", 1

    def boilerplate():
        some = [draw.choice(WORDS) for _ in range(4)]
        return draw.choice((" | ".join(some).upper(), f"{some[0].upper()} !!", "$ " + " $ ".join(some), f"{some[0]} |")), 0

    if not good:
        return [boilerplate() for _ in range(draw.randint(4, 14))] + [content() for _ in range(draw.randint(0, 2))]
    head, body, tail = draw.randint(2, 4), draw.randint(6, 20), draw.randint(2, 4)
    return [boilerplate() for _ in range(head)] + [content() for _ in range(body)] + [boilerplate() for _ in range(tail)]


def features(lines):
    return crf.line_features([x for x, _ in lines])


def test_borders_are_found_from_labels_of_documents():
    draw = random.Random(1)
    model = crf.train_crf([features(page(draw, k % 2)) for k in range(400)], [k % 2 for k in range(400)])
    right = lines = whole = 0
    for _ in range(200):
        own = page(draw, True)
        states, wanted = model.decode(features(own)), np.array([x for _, x in own])
        assert 0 < states.sum() < len(states)
        right, lines, whole = right + (states == wanted).sum(), lines + len(own), whole + (states == wanted).all()
    assert right >= 0.96 * lines and whole >= 120


def test_viterbi_against_all_labellings():
    random_ = np.random.default_rng(2)
    for _ in range(30):
        model = crf.LineModel(random_.normal(size=(len(crf.FEATURES), 2)), random_.normal(size=(2, 2)))
        x = random_.integers(0, 2, (6, len(crf.FEATURES))).astype(np.float32)
        score = x @ model.emission

        def total(states):
            return sum(score[k, s] for k, s in enumerate(states)) + sum(model.transition[a, b] for a, b in itertools.pairwise(states))

        best = max(itertools.product((0, 1), repeat=6), key=total)
        assert tuple(model.decode(x)) == best


def test_expected_states_against_all_labellings():
    random_ = np.random.default_rng(3)
    x = random_.integers(0, 2, (5, len(crf.FEATURES))).astype(np.float32)
    emission, transition = random_.normal(size=(len(crf.FEATURES), 2)), random_.normal(size=(2, 2))
    windows = crf._Windows([x, x[:3], x[:1]], [1, 0, 1])
    state, edge = windows.expected(emission, transition, prior=True)
    for n, length in enumerate((5, 3, 1)):
        score = x[:length].astype(float) @ emission + windows.prior[n]
        chance = {}
        for s in itertools.product((0, 1), repeat=length):
            chance[s] = np.exp(sum(score[k, v] for k, v in enumerate(s)) + sum(transition[a, b] for a, b in itertools.pairwise(s)))
        whole = sum(chance.values())
        for t in range(length):
            assert np.isclose(state[n, t, 1], sum(c for s, c in chance.items() if s[t]) / whole, atol=1e-5)
        for t in range(length - 1):
            assert np.isclose(edge[n, t, 0, 1], sum(c for s, c in chance.items() if s[t : t + 2] == (0, 1)) / whole, atol=1e-5)
        assert not state[n, length:].any() and not edge[n, max(0, length - 1) :].any()


def test_windows_come_from_the_whole_document():
    lines = np.arange(10_000, dtype=np.float32)[:, None]
    drawn = crf.drawn_windows(lines, 7)
    assert len(drawn) == crf.WINDOWS and max(w[-1, 0] for w in drawn) > 4096
    assert [w.tolist() for w in drawn] == [w.tolist() for w in crf.drawn_windows(lines, 7)]
    assert np.concatenate(crf.drawn_windows(lines[:100], 7)).tolist() == lines[:100].tolist()
    assert crf.drawn_windows(lines[:0], 7) == []


def test_clashing_columns_and_empty_table(spark):
    model = crf.LineModel(np.zeros((len(crf.FEATURES), 2)), np.zeros((2, 2)))
    docs = spark.createDataFrame([(1, "a b", "x", 2), (2, None, "y", 3)], "doc_id long, text string, rule string, kept int")
    got = crf.apply_rules(docs, model)
    assert {(r["doc_id"], r["rule"], r["n_words"], r["kept"]) for r in got.collect()} == {(1, "x", 2, False), (2, "y", 0, False)}
    assert crf.apply_rules(docs.limit(0), model).collect() == []
