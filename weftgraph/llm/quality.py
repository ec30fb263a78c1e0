"""Quality by positive-unlabelled learning: non-negative unbiased risk over trusted positives and unlabelled text.

Positives are labelled rows of quality 1. Everything else that is learnt from is unlabelled: rows without a label.
Labelled rows of quality 0 are never looked at. The class prior is estimated from the two samples (the smallest ratio
of unlabelled to positive mass above a score), and the risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

is minimised with full-batch steps on a logistic loss; where the bracket is negative, the step goes against its
gradient, as the non-negative estimator asks for. The model is linear over binned shape features of the whole text.
Margins are shifted so that THRESHOLD loses the share LOST of trusted positives, measured by cross-fitting.
Training reads bounded samples on the driver (``POSITIVES``, ``UNLABELLED``); scoring streams Arrow batches.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.labelled import documents, held_out, hidden, samples, unlabelled
from weftgraph.llm.workers import strings, task

#: Most training texts of each sample.
POSITIVES, UNLABELLED = 6_000, 9_000
#: Bins of a feature, steps and step size of the fit, weight decay.
BINS, STEPS, RATE, DECAY = 8, 400, 0.05, 1e-4
THRESHOLD = 0.7
#: Share of unseen positives that may score below THRESHOLD: the margins are shifted to this.
LOST = 0.003

_ORDINARY_END = frozenset(".,;:!?'\"-)]}»”’…")
_DIGITS, _MARKS, _UPPER = re.compile(r"\d"), re.compile(r"[^\w\s]"), re.compile(r"[A-ZÀ-ÖØ-Þ]")
NAMES = ("repeat", "bars", "ends", "repeat_line", "bars_line", "ends_line", "distinct", "word_chars", "digits", "marks", "capitals", "line_words", "odd_lines", "short", "shouted", "shouted_line")


def features(text: str) -> list[float]:
    """Shape of a whole text: shares over all words, and the worst share of any line of four words or more."""
    words = repeat = bars = ends = odd = lines = chars = shouted = 0
    worst_repeat = worst_bars = worst_ends = worst_shouted = 0.0
    seen: set[str] = set()
    for line in text.split("\n"):
        ws = line.split()
        n = len(ws)
        if not n:
            continue
        lines += 1
        distinct = set(ws)
        seen |= distinct
        r = sum(map(str.__eq__, ws, ws[1:])) if len(distinct) < n else 0
        b = ws.count("|") if "|" in distinct else 0
        e = c = 0
        for w in distinct:
            last = w[-1]
            if not last.isalnum() and len(w) > 1 and (last not in _ORDINARY_END or w[-2] == last):
                e += 1
            if len(w) > 2 and w.isupper():
                c += 1
        words, repeat, bars, ends, shouted, chars = words + n, repeat + r, bars + b, ends + e, shouted + c, chars + len(line)
        if n >= 4:
            worst_repeat, worst_bars, worst_ends, worst_shouted = max(worst_repeat, r / n), max(worst_bars, b / n), max(worst_ends, e / n), max(worst_shouted, c / n)
            odd += r > 0.3 * n or b > 0.2 * n or e > 0.3 * n or c > 0.5 * n
    n = max(1, words)
    size = max(1, len(text))
    return [
        repeat / n, bars / n, ends / n, worst_repeat, worst_bars, worst_ends, len(seen) / math.sqrt(n), chars / n,
        len(_DIGITS.findall(text)) / size, len(_MARKS.findall(text)) / size, len(_UPPER.findall(text)) / size, n / max(1, lines), odd / max(1, lines), 1.0 if words < 5 else 0.0, shouted / n, worst_shouted,
    ]


class QualityModel:
    """Bin edges of each feature and one weight for each bin."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, prior: float, shift: float = 0.0):
        self.edges, self.weights, self.prior, self.shift = edges, weights, prior, shift

    def design(self, rows: np.ndarray) -> np.ndarray:
        """One-hot bins of every feature, and a constant."""
        parts = [np.eye(len(e) + 1)[np.searchsorted(e, rows[:, i], side="left")] for i, e in enumerate(self.edges)]
        return np.hstack([*parts, np.ones((len(rows), 1))])

    def margins(self, rows: np.ndarray) -> np.ndarray:
        offsets = np.cumsum([0, *(len(e) + 1 for e in self.edges)])
        total = np.full(len(rows), self.weights[-1] - self.shift)
        for i, e in enumerate(self.edges):
            total += self.weights[offsets[i] + np.searchsorted(e, rows[:, i], side="left")]
        return total

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def _edges(column: np.ndarray) -> np.ndarray:
    """Cut points at quantiles of the values and, for features that are mostly 0, of the values above 0."""
    inner = np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])
    above = column[column > 0]
    more = np.quantile(above, np.linspace(0, 1, BINS // 2 + 1)[:-1]) * 0.999 if 0 < len(above) < 0.8 * len(column) else []
    return np.unique(np.concatenate([inner, more]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int) -> np.ndarray:
    """Adam on the non-negative unbiased risk with the logistic loss."""
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        positive = -prior * (p.T @ _sigmoid(-zp)) / len(p)
        negative = (u.T @ _sigmoid(zu)) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = (positive + negative if risk >= 0 else -negative) + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio, over score levels, of the unlabelled share to the positive share above the level.

    Levels that keep few positives are passed over: their ratio is noise. An upper confidence margin is added to each
    ratio, so that a lucky level doesn't decide.
    """
    levels = np.unique(np.quantile(positive, np.linspace(0.0, 0.7, 36)))
    best = 1.0
    for level in levels:
        qp, qu = (positive >= level).mean(), (unlabelled >= level).mean()
        slack = 1.0 * (math.sqrt(max(qu * (1 - qu), 1e-4) / len(unlabelled)) + math.sqrt(max(qp * (1 - qp), 1e-4) / len(positive)))
        best = min(best, (qu + slack) / qp)
    return float(min(0.99, max(0.05, best)))


def train(positive: list[str], other: list[str], steps: int = STEPS) -> QualityModel:
    """Fit on two lists of texts. Without positives every score is 0; without unlabelled text every score is 1."""
    if not positive or not other:
        edges = [np.array([]) for _ in NAMES]
        weights = np.zeros(len(NAMES) + 1)
        weights[-1] = 30.0 if positive else -30.0
        return QualityModel(edges, weights, float(bool(positive)))
    ps, us = (np.array([features(t) for t in texts]) for texts in (positive, other))
    model = QualityModel([_edges(c) for c in np.vstack([ps, us]).T], np.zeros(0), 0.5)
    p, u = model.design(ps), model.design(us)
    rough = _descend(p[::2], u[::2], 0.5, steps // 2)  # every second row ranks, the others measure
    model.prior = estimate_prior(p[1::2] @ rough, u[1::2] @ rough) if min(len(p), len(u)) > 3 else 0.5
    halves = [_descend(p[i::2], u, model.prior, steps) for i in (0, 1)] if len(p) > 3 else []
    model.weights = _descend(p, u, model.prior, steps)
    if halves:  # positives are held against the fit that didn't see them
        unseen = np.concatenate([p[1::2] @ halves[0], p[0::2] @ halves[1]])
        model.shift = max(0.0, float(np.quantile(unseen, LOST))) - math.log(THRESHOLD / (1 - THRESHOLD))  # never below even odds
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", positives: int = POSITIVES, others: int = UNLABELLED) -> QualityModel:
    """Train on positives outside the held-out fold and on rows without a label.

    Where all rows of the fold are labelled, labelled rows of both values stand in with their labels hidden; a table
    without any row to contrast is refused.
    """
    trusted = samples(docs, labels, label, {1: positives}, doc_id, text)[1]
    rest = unlabelled(docs, labels, others, doc_id, text)
    if trusted and not rest:
        rest = hidden(docs, labels, label, others, doc_id, text)
    if trusted and not set(rest) - set(trusted):
        raise ValueError("no unlabelled text outside the held-out fold: every document would score 1")
    return train(trusted, rest)


def scorer(docs: DataFrame, model: QualityModel):
    """The model as an Arrow-batched column function; each task unpacks it once."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pickle.loads(held.value)
        for texts in batches:
            yield pa.array(own.scores(np.array([features(t) for t in strings(texts)])) if len(texts) else [], pa.float64())

    return F.arrow_udf(task(scored), "double")


def keep(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose score reaches the threshold, with all their columns; null texts count as empty."""
    return docs.where(scorer(docs, model)(F.col(text)) >= threshold)


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts count as empty; an empty text has the features of a text without words and is scored like any other.
    Repeated rows and ties are scored alike. An empty table gives no rows. Columns beside doc_id and text are not read.
    """
    rows = documents(docs, doc_id, text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(docs, model)("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the labels' positives and the unlabelled rows, and score every document."""
    return score(docs, fit(docs, labels, doc_id, text), doc_id, text)
