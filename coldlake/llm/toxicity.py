"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 to 3 are predicted by one weight vector shared across ordered thresholds:
P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1 < t_2. The expected severity is the sum of these
three probabilities. A document is rejected if P(grade > 0) reaches the model's ``reject_at``: the
probability from 0.1 to 0.5 that gains most on the training rows, caught toxic rows less twice the
clean rows that it costs.

Features are a document's lower-cased words (maximal runs of letters) and their first four and five
letters, which catch inflected and compounded forms, with value log(1 + count). Only those that
differ between clean and toxic labelled rows beyond chance (a G-test) enter the model.

The labels say only whether a document is toxic, so the grades of toxic training rows are derived:
1, 2 or 3 by the third of the toxic rows that the number of their marker words falls in.

Fitting takes at most ``max_rows`` labelled rows outside the held-out fold; scoring reads whole texts
of all documents. Null and empty texts have no feature and get the severity of the intercepts; where
the labels hold no toxic row, nothing is toxic. An empty table gives an empty result; repeated rows
are scored alike. Between equally likely grades the lower one is taken, and of thresholds that gain
the same the highest. Other columns pass through; result columns replace columns of their name.
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
from coldlake.llm.labelled import labelled_sample, term_counts, term_rows

GRADES = 3
MAX_ROWS = 12_000
#: G statistic below which a term's difference may be chance, with millions of terms tried.
MIN_G = 25.0
_WORDS = re.compile(r"[^\W\d_]+").findall


def toxicity_terms(text: str | None) -> dict[str, int]:
    """Counts of words (``w:``) and of their first four and five letters (``4:``, ``5:``)."""
    out: Counter[str] = Counter()
    for word, n in Counter(_WORDS((text or "").lower())).items():
        out["w:" + word] += n
        if len(word) > 4:
            out["4:" + word[:4]] += n
        if len(word) > 5:
            out["5:" + word[:5]] += n
    return out


@dataclass
class OrdinalModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    reject_at: float = 0.5

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, terms: int, steps: int = 400):
    """Weights and thresholds of the cumulative-link model with an L2 penalty, by Adam steps.

    ``rows`` and ``values`` hold each document's feature numbers and values.
    """
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    number = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    value = np.concatenate([*values, np.empty(0)])
    w, raw = np.zeros(terms), np.array([2.0, 1.0, 1.0])  # first threshold, then logs of the gaps
    moments = [np.zeros(terms + GRADES), np.zeros(terms + GRADES)]
    for step in range(1, steps + 1):
        gaps = np.exp(raw[1:])
        thresholds = np.concatenate([[raw[0]], raw[0] + np.cumsum(gaps)])
        score = np.bincount(owner, value * w[number], minlength=len(rows))
        p = _sigmoid(score[:, None] - thresholds)
        # d(-log P(grade))/d(score - t_k), from P(grade) = P(> grade - 1) - P(> grade)
        upper = np.concatenate([np.ones((len(p), 1)), p], axis=1)[np.arange(len(p)), grades]
        lower = np.concatenate([p, np.zeros((len(p), 1))], axis=1)[np.arange(len(p)), grades]
        chance = np.maximum(upper - lower, 1e-9)
        slope = p * (1 - p)
        at = np.zeros_like(p)
        k = np.arange(GRADES)[None, :]
        at += np.where(k == grades[:, None] - 1, -slope / chance[:, None], 0)
        at += np.where(k == grades[:, None], slope / chance[:, None], 0)
        at /= len(rows)  # no class weights: probabilities stay calibrated
        g_score = at.sum(1)
        g_w = np.bincount(number, value * g_score[owner], minlength=terms) + 1e-4 * w
        g_t = -at.sum(0)
        g_raw = np.array([g_t.sum(), *(g_t[j:].sum() * gaps[j - 1] for j in range(1, GRADES))])
        grad = np.concatenate([g_w, g_raw])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, raw = w - move[:terms], raw - move[terms:]
    return w, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])


def _significant(sample: DataFrame) -> dict[str, int]:
    """Terms whose document counts differ between the classes beyond chance, strongest first."""
    totals = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(False, 0), totals.get(True, 0)
    if not clean or not toxic:
        return {}
    n = float(clean + toxic)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    both = n0 + n1
    g = 2 * (
        part(n0, both * clean / n)
        + part(n1, both * toxic / n)
        + part(F.lit(float(clean)) - n0, (F.lit(n) - both) * clean / n)
        + part(F.lit(float(toxic)) - n1, (F.lit(n) - both) * toxic / n)
    )
    counts = term_counts(sample, toxicity_terms).where(both < n)
    least = min(MIN_G, 0.6 * 2 * toxic)  # few labels: a term in most toxic rows still counts
    chosen = counts.withColumn("g", g).where(F.col("g") >= least).where(n1 / toxic > n0 / clean)
    # bounded by the sample: of its terms only those that pass the test
    found = sorted((-r["g"], r["term"]) for r in chosen.select("term", "g").collect())
    return {term: k for k, (_, term) in enumerate(found)}


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Model of ``labels.toxic``, fitted on at most ``max_rows`` labelled rows of ``docs``."""
    sample = labelled_sample(docs, labels, "toxic", max_rows, per_class=False, seed=1)
    vocabulary = _significant(sample)
    if not vocabulary:
        return OrdinalModel({}, np.zeros(0), np.array([5.0, 6.0, 7.0]))
    found = term_rows(sample, toxicity_terms, vocabulary)
    counts = [np.asarray(c, float) for c in found["counts"]]
    rows = [np.asarray(r, np.int64) for r in found["numbers"]]
    is_word = np.array([t.startswith("w:") for t in vocabulary])
    markers = np.array([c[is_word[r]].sum() if len(r) else 0.0 for r, c in zip(rows, counts)])
    toxic = found["label"].to_numpy() > 0
    cuts = np.quantile(markers[toxic], [1 / 3, 2 / 3]) if toxic.any() else [0, 0]
    grades = np.where(toxic, 1 + (markers > cuts[0]) + (markers > cuts[1]), 0)
    values = [np.log1p(c) for c in counts]
    weights, thresholds = fit_ordinal(rows, values, grades, len(vocabulary))
    model = OrdinalModel(vocabulary, weights, thresholds)
    p = model.probabilities(np.array([weights[r] @ v for r, v in zip(rows, values)]))[:, 0]
    gains = [(int((p[toxic] >= t).sum() - 2 * (p[~toxic] >= t).sum()), t) for t in np.arange(10, 51, 2) / 100]
    model.reject_at = float(max(gains)[1])
    return model


def score_toxicity(
    docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float | None = None
) -> DataFrame:
    """``docs`` with severity (expected grade), grade (most likely), p_toxic and rejected."""
    reject_at = model.reject_at if reject_at is None else reject_at
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a term of the bounded sample each

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known = {k: {t[2:]: n for t, n in model.vocabulary.items() if t[:2] == k} for k in ("w:", "4:", "5:")}
        by_word, by_four, by_five = known["w:"], known["4:"], known["5:"]
        weights = model.weights
        for texts in batches:
            scores = np.zeros(len(texts))
            for k, text in enumerate(texts):
                if not text:
                    continue
                found: dict[int, int] = {}
                for word, n in Counter(_WORDS(text.lower())).items():
                    if word in by_word:
                        found[by_word[word]] = n
                    if (four := word[:4]) in by_four and len(word) > 4:
                        found[by_four[four]] = found.get(by_four[four], 0) + n
                        # five-letter starts are looked up apart, for their first four may be common
                    if (five := word[:5]) in by_five and len(word) > 5:
                        found[by_five[five]] = found.get(by_five[five], 0) + n
                if found:
                    numbers = np.fromiter(found, np.int64, len(found))
                    counts = np.fromiter(found.values(), float, len(found))
                    scores[k] = weights[numbers] @ np.log1p(counts)
            p = model.probabilities(scores)
            chance = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            yield pd.DataFrame({"severity": p.sum(1), "grade": chance.argmax(1).astype("int32"), "p_toxic": p[:, 0]})
        release_memory()

    judge = F.pandas_udf(run, "severity double, grade int, p_toxic double")
    names = ("severity", "grade", "p_toxic", "rejected")
    keep = [c for c in docs.columns if c.lower() not in names]
    judged = docs.select(*keep, judge(F.col(text_col)).alias("severity"))
    parts = [F.col(f"severity.{n}").alias(n) for n in names[:3]]
    return judged.select(*keep, *parts, (F.col("severity.p_toxic") >= reject_at).alias("rejected"))


def drop_toxic(
    docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float | None = None
) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    columns = docs.columns
    whole = docs.select(F.col(text_col).alias("text"), F.struct(*columns).alias("row"))
    return score_toxicity(whole, model, reject_at=reject_at).where("NOT rejected").select("row.*").select(*columns)
