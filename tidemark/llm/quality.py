"""Quality by ordinal cumulative-link regression on graded ratings.

Features are hashed: the distinct words of a text and tokens for its shape (shares of capitals,
marks, repeats, length). One weight per feature is shared by all grades; ordered thresholds cut
the score, ``P(grade <= k) = logistic(threshold[k] - score)``. The expected grade and the tail
probability of the best grade serve for selection. Weights are fitted by accelerated proximal
steps under an L1 penalty, so words that say nothing weigh nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Features fall into so many buckets; weights are held sparsely.
BUCKETS = 1 << 30
#: The model is fitted on at most so many rated documents, the least by hash of their id.
MAX_RATED = 8_000
#: A feature needs so many rated documents to get a weight.
LEAST_DOCS = 3
#: Documents whose probability of the best grade is at least this are kept.
KEEP = 0.5
_MARKS = "!$%&#*|"
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class Features(dict):
    """Raw word -> bucket of the word without case and outer punctuation."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest("w " + word.strip(_OUTER)) % BUCKETS
        return n

    def __call__(self, text: str | None) -> set[int]:
        text = text or ""
        words = text.split()
        found = set(map(self.__getitem__, set(text.lower().split())))
        n, chars, lines = max(1, len(words)), max(1, len(text)), text.split("\n")
        shape = {
            "capitals": sum(map(str.isupper, words)) / n,
            "repeats": 1 - len(found) / n,
            "runs": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            "lines": 1 - len(set(lines)) / len(lines),
            "word": min(1, chars / n / 20),
            "length": min(1, len(words).bit_length() / 16),
        } | {m: min(1, 4 * text.count(m) / n) for m in _MARKS}
        return found | {xxhash.xxh64_intdigest(f"s {k} {round(10 * v)}") % BUCKETS for k, v in shape.items()}


@dataclass(frozen=True)
class Ordinal:
    """Sparse weights by bucket, and ascending thresholds between the grades."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def tail(self, features: set[int]) -> list[float]:
        """``P(grade > k)`` for each threshold."""
        s = sum(self.weights[i] for i in features if i in self.weights)
        return [float(1 / (1 + np.exp(np.clip(t - s, -60, 60)))) for t in self.thresholds]


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int, *, steps: int = 300, relax: float = 0.05) -> Ordinal:
    """Fit on rows of buckets. Without rows every document gets the best grade for certain.

    Two passes: one under an L1 penalty near the noise of a feature's gradient finds the
    features that matter, one under ``relax`` times that penalty weighs them.
    """
    if not len(grades):
        return Ordinal({}, (-60.0,) * (n_grades - 1))
    ids, inverse, counts = np.unique(np.concatenate(features), return_inverse=True, return_counts=True)
    row, n = np.repeat(np.arange(len(features)), [len(f) for f in features]), len(features)
    share = np.clip([(grades <= k).mean() for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    keep = np.flatnonzero(counts >= LEAST_DOCS)
    weights = np.zeros(len(keep))
    for strength in (0.6, relax):
        place = np.full(len(ids), -1)
        place[keep] = np.arange(len(keep))
        used = place[inverse] >= 0
        weights, theta = _solve(row[used], place[inverse[used]], grades, weights, theta, strength * np.sqrt(counts[keep]) / n, steps)
        keep, weights = keep[weights != 0], weights[weights != 0]
    return Ordinal(dict(zip(ids[keep].tolist(), weights.tolist(), strict=True)), tuple(theta.tolist()))


def _solve(row: np.ndarray, col: np.ndarray, grades: np.ndarray, w: np.ndarray, t: np.ndarray, penalty: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal steps; a weight's step follows from a diagonal bound of the curvature."""
    n, d = len(grades), len(w)
    rate = n / (0.5 * np.bincount(col, np.bincount(row, minlength=n)[row], d) + 1e-9)
    z, zt, a = w, t, 1.0
    for _ in range(steps):
        s = np.bincount(row, z[col], n) if d else np.zeros(n)
        edge = np.concatenate([[-np.inf], zt, [np.inf]])
        cdf = 1 / (1 + np.exp(-np.clip(edge[None, :] - s[:, None], -500, 500)))
        hi, lo = cdf[np.arange(n), grades + 1], cdf[np.arange(n), grades]
        p = np.maximum(hi - lo, 1e-12)
        up, down = hi * (1 - hi) / p, lo * (1 - lo) / p
        gt = np.array([(down[grades == k + 1].sum() - up[grades == k].sum()) / n for k in range(len(t))])
        new = z - rate * (np.bincount(col, (up - down)[row], d) / n if d else 0.0)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        tn = np.maximum.accumulate(zt - 0.5 * gt)
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        if ((z - new) * (new - w) / rate).sum() > 0:
            b, a = 1.0, 1.0
        z, zt = new + (a - 1) / b * (new - w), np.maximum.accumulate(tn + (a - 1) / b * (tn - t))
        w, t, a = new, tn, b
    return w, t


def train(docs: DataFrame, rated: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3, max_rated: int = MAX_RATED) -> Ordinal:
    """Fit on ``rated(doc_id, grade)``, grades from 0 to ``n_grades - 1``; other or null grades are left out.

    At most ``max_rated`` rows are used (and sent to all tasks), so the scan of documents
    shuffles no text. An id rated twice counts with its lower grade.
    """
    some = rated.where(F.col("grade").between(0, n_grades - 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id")

    def draw(rows: dict, features: Features) -> dict:
        return {"doc_id": rows["doc_id"], "grade": rows["grade"], "features": [sorted(features(t)) for t in rows["text"]]}

    kind = dict(texts.dtypes)["doc_id"]
    table = map_rows(texts, draw, f"doc_id {kind}, grade int, features array<int>", Features).toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    flat, ends = table["features"].combine_chunks(), None
    lists = flat.values.to_numpy() if len(order) else np.empty(0, np.int32)
    ends = flat.offsets.to_numpy() if len(order) else np.zeros(1, np.int32)
    return fit([lists[ends[i] : ends[i + 1]].astype(np.int64) for i in order], table["grade"].to_numpy()[order] if len(order) else np.empty(0, np.int64), n_grades)


def score(docs: DataFrame, model: Ordinal, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``expected_grade`` and ``p_best`` put last.

    Null text: empty, scored by its shape. Repeated rows score alike. Empty input: no rows.
    Columns of the input that bear the two new names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("expected_grade", "p_best")]

    def grade(rows: dict, features: Features) -> dict:
        tails = [sent.value.tail(features(t)) for t in rows[text_col]]
        return {c: rows[c] for c in kept} | {"expected_grade": [sum(t) for t in tails], "p_best": [t[-1] for t in tails]}

    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in kept]).add("expected_grade", "double").add("p_best", "double")
    return map_rows(docs, grade, schema, Features)


def graded(labels: DataFrame) -> DataFrame:
    """Grades from ``labels(doc_id, quality, toxic)``: a point for good quality, a point for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
