"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words' shapes (runs of upper case, lower case and digits written A, a and
0, other characters kept, runs shortened to one), the words themselves, and how often a word repeats
the one before. A truncated singular value decomposition of the TF-IDF matrix of a bounded, balanced
sample of labelled rows gives the space. The sample's vectors, labels attached, are broadcast (at
most ``max_rows`` x ``dimensions`` numbers); every document is folded into the space and compared
with all of them by exact cosine products, in blocks. Its ``neighbours`` nearest vote with their
similarity; the score is the weighted share of label 1.

Only rows outside the held-out fold are learnt from. Texts are read whole. A null or empty text, or
one without a known term, has no direction and gets the prior, the share of label 1 among all usable
labels. With labels of one class only, or none, the prior decides every row. Similarities are rounded
to six digits; of equal ones the vector of the smaller doc_id counts first, so copies score alike. An
empty table gives an empty result; other columns pass through, result columns replace columns of
their name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import bound_batches, release_memory
from coldlake.llm.labelled import held_out, labelled_sample, term_counts, term_rows

MAX_ROWS = 4096
#: Terms of the model, by how many sampled documents hold them.
MAX_TERMS = 8192
DIMENSIONS = 48
NEIGHBOURS = 15
#: Documents in one block of cosine products.
BLOCK = 512
_RUNS = re.compile(r"([A-Z]+)|([a-z]+)|(\d+)|(.)\4*", re.DOTALL)


def word_shape(word: str) -> str:
    def one(m: re.Match) -> str:
        upper, lower, digit, other = m.groups()
        if other is not None:
            return "A" if other.isupper() else "a" if other.isalpha() else other
        return "A" if upper else "a" if lower else "0"

    return re.sub(r"(.)\1+", r"\1", _RUNS.sub(one, word))


class TermExtractor:
    """Terms of texts; remembers the shapes of a bounded number of words."""

    def __init__(self, remember: int = 200_000):
        self.shapes: dict[str, str] = {}
        self.remember = remember

    def __call__(self, text: str | None) -> dict[str, int]:
        words = (text or "").split()
        shapes, out = self.shapes, {}
        if len(shapes) > self.remember:
            shapes.clear()
        for word, n in Counter(words).items():
            shape = shapes.get(word)
            if shape is None:
                shape = shapes[word] = "s:" + word_shape(word)
            out[shape] = out.get(shape, 0) + n
            out["w:" + word] = n
        again = sum(map(str.__eq__, words[1:], words[:-1]))
        if again:
            out["="] = again
        return out


@dataclass
class NeighbourModel:
    vocabulary: dict[str, int]
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def weigh(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1.0 + np.log(counts)) * self.idf[numbers]

    def fold(self, numbers: list, counts: list) -> np.ndarray:
        """Unit vectors of documents in the space; zero where no term is known."""
        out = np.zeros((len(numbers), self.axes.shape[1]), np.float32)
        for k, (r, c) in enumerate(zip(numbers, counts)):
            if len(r):
                r = np.asarray(r, np.int64)
                out[k] = self.weigh(r, np.asarray(c, float)) @ self.axes[r]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norm > 1e-12, out / np.maximum(norm, 1e-12), 0).astype(np.float32)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), self.prior)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        for begin in range(0, len(vectors), BLOCK):
            n = min(BLOCK, len(vectors) - begin)
            # blocks of one shape, and similarities of six digits: a row's result does not depend on the others
            block = np.zeros((BLOCK, vectors.shape[1]), np.float32)
            block[:n] = vectors[begin : begin + n]
            near = np.rint((block @ self.vectors.T)[:n] * 1e6).astype(np.int64)
            rank = (near << 20) - np.arange(len(self.vectors))  # of equal similarities the earlier row
            top = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) / 1e6
            total = weight.sum(1)
            share = (weight * self.labels[top]).sum(1) / np.maximum(total, 1e-12)
            out[begin : begin + n] = np.where(total > 1e-9, share, self.prior)
        return np.clip(out, 0.0, 1.0)


def fit_quality(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS
) -> NeighbourModel:
    """Model of ``labels.quality``, fitted on at most ``max_rows`` labelled rows of ``docs``.

    The model has the ``max_terms`` terms that most of these rows hold, the driver ``max_rows`` x
    ``max_terms`` numbers while it is fitted.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    prior = usable.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    prior = 0.5 if prior is None else float(prior)
    sample = labelled_sample(docs, labels, "quality", max_rows, per_class=True, seed=2)
    counts = term_counts(sample, lambda text: TermExtractor()(text)).withColumn("n", F.expr("n0 + n1")).where("n >= 2")
    found = counts.orderBy(F.desc("n"), "term").limit(max_terms).select("term", "n").collect()
    vocabulary = {r["term"]: k for k, r in enumerate(found)}
    rows = term_rows(sample, lambda text: TermExtractor()(text), vocabulary)
    empty = NeighbourModel(vocabulary, np.zeros(len(vocabulary)), np.zeros((len(vocabulary), 1)), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    if not len(rows) or not vocabulary or rows["label"].nunique() < 2:
        return empty
    n = len(rows)
    idf = np.log((1.0 + n) / (1.0 + np.array([r["n"] for r in found]))) + 1.0
    matrix = np.zeros((n, len(vocabulary)), np.float32)
    model = NeighbourModel(vocabulary, idf, empty.axes, empty.vectors, empty.labels, prior)
    for k, (r, c) in enumerate(zip(rows["numbers"], rows["counts"])):
        if len(r):
            r = np.asarray(r, np.int64)
            matrix[k, r] = model.weigh(r, np.asarray(c, float))
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    # randomised range finder with power steps, then the small decomposition
    rank = min(DIMENSIONS + 8, n, len(vocabulary))
    basis = matrix @ np.random.default_rng(7).standard_normal((len(vocabulary), rank)).astype(np.float32)
    for _ in range(4):
        basis = matrix @ (matrix.T @ np.linalg.qr(basis)[0])
    q = np.linalg.qr(basis)[0]
    axes = np.linalg.svd(q.T @ matrix, full_matrices=False)[2][: min(DIMENSIONS, rank)]
    model.axes = np.ascontiguousarray(axes.T)
    vectors = model.fold(rows["numbers"], rows["counts"])
    some = np.abs(vectors).sum(1) > 0
    model.vectors, model.labels = vectors[some], rows["label"].to_numpy()[some].astype(float)
    return model


def score_quality(docs: DataFrame, model: NeighbourModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score is at least 0.5)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, extract = shared.value, TermExtractor()
        vocabulary = model.vocabulary
        for texts in batches:
            numbers, counts = [], []
            for text in texts:
                found = {vocabulary[t]: n for t, n in extract(text).items() if t in vocabulary}
                numbers.append(np.fromiter(found, np.int64, len(found)))
                counts.append(np.fromiter(found.values(), float, len(found)))
            yield pd.Series(model.score(model.fold(numbers, counts)))
        release_memory()

    judge = F.pandas_udf(run, "double")
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*keep, judge(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
