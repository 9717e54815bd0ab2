"""Quality scores by pairwise ranking: a Bradley-Terry model on document statistics.

Each preference pair sets a document of label 1 over one of label 0; the probability that it wins
is the logistic function of the difference of two linear scores. The cut between good and bad is a
quantile of the training scores, the share of label 0 among them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import doc_stats
from .common import keep_rows, per_text, table
from .quality_rules import sample_matrix
from .training import held_out, labelled

#: Most labelled rows that pairs are drawn from, and pairs for each row of label 0.
SAMPLE = 8000
PAIRS = 12
#: The published score at the cut; below it a document is predicted bad.
CUT = 0.3


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (spread(x) - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the raw score; CUT at the cut."""
        z = np.clip((self.raw(x) - self.cut) * self.slope + np.log(CUT / (1 - CUT)), -35, 35)
        return 1 / (1 + np.exp(-z))


def spread(x: np.ndarray) -> np.ndarray:
    """The statistics and the square roots of the shares: small shares of junk tell much."""
    return np.concatenate([x, np.sqrt(np.clip(x, 0, 1))], axis=1)


def fit_ranker(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, steps: int = 40) -> Ranker:
    """Newton's method on the mean logistic loss of the pairs' feature differences.

    Ties in labels make no pair. Without a pair (no rows or one label) the score is one constant: high
    where all labels are 1 or there are none, low where all are 0.
    """
    d = 2 * x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 1.0 if len(bad) else -1.0, 5.0)
    f = spread(x)
    mean, scale = f.mean(axis=0), f.std(axis=0)
    scale[scale < 1e-9] = 1.0
    f = (f - mean) / scale
    # Every row of label 0 meets `pairs` rows of label 1, dealt evenly.
    step = max(1, len(good) // pairs)
    meets = (np.arange(len(bad))[:, None] * 7 + np.arange(pairs)[None, :] * step) % len(good)
    diff = (f[good][meets] - f[bad][:, None, :]).reshape(-1, d)
    w = np.zeros(d)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -35, 35)))  # that the pair comes out wrong
        gradient = -(p @ diff) / len(diff) + l2 * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + (l2 + 1e-9) * np.eye(d)
        move = np.linalg.solve(curve, gradient)
        w -= move * min(1.0, 4.0 / (np.linalg.norm(move) + 1e-12))
        if np.linalg.norm(move) < 1e-6:
            break
    raw = f @ w
    cut = float(np.quantile(raw, len(bad) / len(y)))
    spreads = float(np.median(raw[good]) - cut)
    return Ranker(mean, scale, w, cut, 4.0 / max(spreads, 1e-6))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """The ranker, fitted on at most `sample` labelled rows outside the held-out fifth."""
    return fit_ranker(*sample_matrix(labelled(docs, labels, "quality", sample, id_col, text_col)))


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted (1 where score >= 0.3) for every whole text.

    Empty and null texts are scored as texts without words. A row out for each row in: null ids
    (held out), ties and repeated rows pass through; no column but the text enters the score.
    """

    scored = per_text(docs, id_col, text_col, "score double, predicted int", lambda: lambda texts: [(s, int(s >= CUT)) for s in scores(texts, ranker)])
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def scores(texts: list, ranker: Ranker) -> list[float]:
    return ranker.score(np.array([doc_stats.features(doc_stats.base(t)) for t in texts], dtype=float).reshape(len(texts), -1)).tolist()


def kept_documents(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows that score() predicts 1 for, with all their columns, whatever their names; no row moves.

    A null or empty text is scored as one without words. Null ids, ties and repeated rows are judged
    row by row, by the text alone. An empty table gives an empty one.
    """
    return keep_rows(docs, text_col, lambda: lambda texts: [s >= CUT for s in scores(texts, ranker)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op3_quality_rank": query}
SQL: dict[str, str] = {}
