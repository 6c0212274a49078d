"""Quality rules with line sequence labelling by a linear-chain conditional random field.

Lines (text between ``\\n``, those with a word) are labelled content or boilerplate by Viterbi
decoding of a two-state linear-chain CRF over line features (length, case, symbols, separators,
repetition, line ends). A document is retained if the words of its content lines are at least
``MIN_CONTENT`` of all its words and the base rules hold.

Base rules: at least 50 words, and at most half of the words inside a 3-word window that the text
holds twice or more.

Labels say only whether a document is good, so the lines' states are hidden: the CRF is trained by
expectation maximisation on at most ``max_rows`` labelled documents outside the held-out fold, of
each at most ``WINDOWS`` windows of ``WINDOW`` neighbouring lines, drawn by a seeded hash from the
whole document. A logistic regression of the document's label on single lines starts it. Then the
expected states of all lines, given a document's lines and, as prior, its label, are what the next
CRF is fitted to. The prior is weak (``PRIOR``), so a boilerplate line of a good document, or a
content line of a bad one, is learnt as what its features and neighbours say. Decoding reads all
lines of all documents and no label. Without labels of both kinds every line is content.

Null and empty texts have no words and fail the base rules. Long texts are read whole, repeated rows
are judged alike, an empty table gives an empty result, and ties in decoding go to content. Other
columns pass through; result columns replace columns of their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import bound_batches, free_name, release_memory
from coldlake.llm.labelled import labelled_sample

MAX_ROWS = 2000
WINDOW = 64
WINDOWS = 16
#: Log odds that a document's label adds to each of its lines in training.
PRIOR = 0.5
ROUNDS = 4
MIN_CONTENT = 0.5
MIN_WORDS = 50
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile("[\x20\x09-\x0d]")
_UPPER_WORD = re.compile(r"\b[^\W\d_a-z]{2,}\b")
FEATURES = (
    "bias", "few words", "many words", "symbol words", "many symbol words", "upper", "mostly upper", "exclaims",
    "separators", "repeats words", "mostly repeats", "seen line", "closed", "open end", "digits", "long word",
)


def split_words(text: str | None) -> list[bytes]:
    """Words as bytes: runs outside space and ``\\t \\n \\v \\f \\r`` (bytes.split uses just these)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    book: dict[bytes, int] = {}
    codes = np.fromiter((book.setdefault(w, len(book)) for w in words), np.int64, n)
    pair = codes[:-1] * len(book) + codes[1:]  # below 2^63 for any text that fits in memory
    if len(book) < 1 << 20:
        triple = pair[:-1] * len(book) + codes[2:]
    else:
        _, pair = np.unique(pair, return_inverse=True)
        triple = pair[:-1] * len(book) + codes[2:]
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def line_features(lines: list[str]) -> np.ndarray:
    """0/1 features of each line, given all lines with words of a document in order."""
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    seen: set[str] = set()
    for k, line in enumerate(lines):
        words = line.split()
        n = max(1, len(words))
        letters = sum(map(str.isalpha, line)) or 1
        upper = sum(map(str.isupper, line)) / letters
        symbols = len(_SYMBOLS.findall(line))
        again = sum(map(str.__eq__, words[1:], words[:-1])) / n
        out[k] = (
            1, n <= 3, n > 8, symbols > 0, symbols > 0.5 * n, upper > 0.25, upper > 0.6, line.count("!") > 0.2 * n,
            line.count("|") > 0.2 * n, again > 0.1, again > 0.4, line in seen, line.rstrip().endswith((".", "!", "?", '"')),
            line.rstrip().endswith((",", "|", ":")), sum(map(str.isdigit, line)) > 0.2 * len(line), max(map(len, words), default=0) > 30,
        )
        seen.add(line)
    return out


@dataclass
class LineModel:
    """State scores are features @ emission; states are 0 boilerplate, 1 content."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Most likely states (Viterbi); ties go to content."""
        n = len(features)
        if not n:
            return np.zeros(0, np.int8)
        scores = (features @ self.emission).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        s0, s1 = scores[0]
        back = []
        for a, b in scores[1:]:
            from0, from1 = s0 + t00, s1 + t10
            to0, to1 = s0 + t01, s1 + t11
            back.append((from1 >= from0, to1 >= to0))
            s0, s1 = (from1 if from1 >= from0 else from0) + a, (to1 if to1 >= to0 else to0) + b
        state = s1 >= s0
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return np.array(out[::-1], np.int8)


class _Windows:
    """Padded windows of lines, and sums over all their labellings."""

    def __init__(self, windows: list[np.ndarray], labels: list[int]):
        self.n, self.width = len(windows), max(map(len, windows))
        self.x = np.zeros((self.n, self.width, len(FEATURES)), np.float32)
        self.mask = np.zeros((self.n, self.width), bool)
        for k, s in enumerate(windows):
            self.x[k, : len(s)] = s
            self.mask[k, : len(s)] = True
        self.y = np.array(labels)
        # both labels weigh the same, and a line as much as any other of its label
        lines = self.mask.sum(1)
        self.share = np.where(self.y == 1, 0.5 / max(1, lines[self.y == 1].sum()), 0.5 / max(1, lines[self.y == 0].sum()))
        self.prior = np.stack([-(2 * self.y - 1), 2 * self.y - 1], 1) * (PRIOR / 2)

    def expected(self, emission: np.ndarray, transition: np.ndarray, prior: bool) -> tuple[np.ndarray, np.ndarray]:
        """Chances of each line's states and of each pair of neighbours', by forward and backward sums."""
        width, n = self.width, self.n
        score = self.x @ emission.astype(np.float32) + (self.prior[:, None, :] if prior else 0.0)
        e = np.exp(score - score.max(2, keepdims=True)).transpose(1, 0, 2).astype(float)
        step, inside = np.exp(transition), self.mask.T[:, :, None]
        # chances are scaled to sum 1 at each line, which cancels in the results
        alpha, beta, scale = np.zeros((width, n, 2)), np.ones((width, n, 2)), np.ones((width, n, 1))
        alpha[0] = e[0] / e[0].sum(1, keepdims=True)
        for t in range(1, width):
            new = (alpha[t - 1] @ step) * e[t]
            scale[t] = np.where(inside[t], new.sum(1, keepdims=True), 1.0)
            alpha[t] = np.where(inside[t], new / scale[t], alpha[t - 1])
        ahead = np.zeros((width, n, 2))
        for t in range(width - 1, 0, -1):
            ahead[t] = e[t] * beta[t] / scale[t]
            beta[t - 1] = np.where(inside[t], ahead[t] @ step.T, 1.0)
        state = (alpha * beta * inside).transpose(1, 0, 2)
        edge = alpha[:-1, :, :, None] * step * ahead[1:, :, None, :] * inside[1:, :, :, None]
        return state, edge.transpose(1, 0, 2, 3)

    def fit(self, params: np.ndarray, state: np.ndarray, edge: np.ndarray | None, steps: int) -> np.ndarray:
        """Parameters raising the likelihood of the expected states, by Adam steps with an L2 penalty.

        Without ``edge`` lines count alone and transitions stay.
        """
        m, v = np.zeros_like(params), np.zeros_like(params)
        weighted = self.x * self.share[:, None, None]
        for step in range(1, steps + 1):
            emission, transition = params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2)
            if edge is None:
                score = np.exp(self.x @ emission.astype(np.float32))
                own = score / score.sum(2, keepdims=True) * self.mask[:, :, None]
                g_transition = np.zeros((2, 2))
            else:
                own, both = self.expected(emission, transition, prior=False)
                g_transition = np.einsum("ntab,n->ab", both - edge, self.share)
            g_emission = weighted.reshape(-1, len(FEATURES)).T @ (own - state).reshape(-1, 2)
            grad = np.concatenate([g_emission.ravel(), g_transition.ravel()]) + 1e-3 * params
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return params


def train_crf(sequences: list[np.ndarray], labels: list[int]) -> LineModel:
    """EM over windows of lines (features) of documents with a label; see the module's docstring."""
    windows = _Windows(sequences, labels)
    gold = np.zeros((windows.n, windows.width, 2))
    gold[np.arange(windows.n), :, windows.y] = 1
    params = windows.fit(np.zeros(len(FEATURES) * 2 + 4), gold * windows.mask[:, :, None], None, 150)
    for _ in range(ROUNDS):
        state, edge = windows.expected(params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2), prior=True)
        params = windows.fit(params, state, edge, 20)
    return LineModel(params[:-4].reshape(-1, 2).copy(), params[-4:].reshape(2, 2).copy())


def drawn_windows(features: np.ndarray, seed: int, most: int = WINDOWS) -> list[np.ndarray]:
    """At most ``most`` windows of a document's lines, drawn from all of them."""
    count = -(-len(features) // WINDOW)
    chosen = range(count)
    if count > most:
        chosen = np.sort(np.random.default_rng([seed & 0xFFFFFFFF, 3]).choice(count, most, replace=False)).tolist()
    return [features[k * WINDOW : (k + 1) * WINDOW] for k in chosen]


def text_lines(text: str | None) -> list[str]:
    """The lines of a text that hold a word."""
    return [x for x in (text or "").split("\n") if x.encode("utf-8", "surrogatepass").split()]


def fit_lines(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> LineModel:
    """CRF fitted on at most ``max_rows`` labelled rows of ``docs``, at most WINDOWS * WINDOW lines of each."""
    sample = labelled_sample(docs, labels, "quality", max_rows, per_class=True, seed=3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, label, text in zip(batch["doc_id"], batch["label"], batch["text"]):
                found = drawn_windows(line_features(text_lines(text)), int(i))
                rows += [(i, k, label, w.astype(np.uint8).tobytes()) for k, w in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "number", "label", "features"])
        release_memory()

    rows = sample.mapInPandas(run, "doc_id long, number int, label int, features binary").toPandas()
    rows = rows.sort_values(["doc_id", "number"])
    found = [np.frombuffer(x, np.uint8).reshape(-1, len(FEATURES)).astype(np.float32) for x in rows["features"]]
    states = [int(y > 0) for y in rows["label"]]
    if len(set(states)) < 2:
        content = np.zeros((len(FEATURES), 2))
        content[0, 1] = 1.0
        return LineModel(content, np.zeros((2, 2)))
    return train_crf(found, states)


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, content_words long, content_lines array<int>"
)


def judge(text: str | None, model: LineModel) -> tuple:
    """One row of RESULT; content_lines numbers the content lines among all lines, from 0."""
    text = text or ""
    words = split_words(text)
    n = len(words)
    repeated = repeated_words(words)
    numbers, lines, duplicates, seen = [], [], 0, set()
    for k, line in enumerate(text.split("\n")):
        if line.encode("utf-8", "surrogatepass").split():
            duplicates += line in seen
            seen.add(line)
            numbers.append(k)
            lines.append(line)
    states = model.decode(line_features(lines))
    content = [k for k, s in enumerate(states) if s]
    content_words = sum(len(split_words(lines[k])) for k in content)
    failed = n < MIN_WORDS or 100 * repeated > 50 * n
    kept = not failed and content_words >= MIN_CONTENT * n
    return (
        n, len(text) - len(_SPACE.findall(text)), len(_SYMBOLS.findall(text)), duplicates, repeated, failed, kept,
        len(lines), content_words, [numbers[k] for k in content],
    )


def apply_rules(docs: DataFrame, model: LineModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of RESULT."""
    bound_batches(docs.sparkSession)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([judge(t, model) for t in texts], columns=names)
        release_memory()

    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    rule = free_name(docs, "rule")
    rules = F.pandas_udf(run, RESULT)
    return docs.select(*keep, rules(F.col(text_col)).alias(rule)).select(*keep, f"{rule}.*")
