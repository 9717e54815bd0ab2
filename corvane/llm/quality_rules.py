"""Quality rules: base rules on counts, then boosted trees over document statistics.

The trees learn labels.quality = 0 from a bounded sample of labelled rows and are flattened into
numpy node arrays, which score a slice of documents at once. More symbols, repeats, shouting, bare
signs or duplicate lines can only make the score worse: those features are constrained.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import boosting, doc_stats
from .common import keep_rows, per_text, table
from .training import labelled

#: Most labelled rows that the trees are fitted on.
SAMPLE = 8000
#: A document is rejected where the trees find it bad with more than this probability.
REJECT = 0.6
#: Statistics that can only speak against a document as they grow.
WORSE = ("symbol_share", "dup_line_share", "repeat_share", "same_next_share", "bare_share", "shout_share", "upper_share")
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, bad_score double, kept boolean"


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the array `x` of doc_stats.FEATURES, a row for each row in."""
    return per_text(docs, id_col, text_col, "x array<double>", lambda: lambda texts: [(doc_stats.features(doc_stats.base(t)),) for t in texts])


def sample_matrix(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample (id, text, label), on the driver, in an order of their own."""
    stats = sample.select("label", "text")
    got = per_text(stats, "label", "text", "x array<double>", lambda: lambda texts: [(doc_stats.features(doc_stats.base(t)),) for t in texts]).toPandas()
    if not len(got):
        return np.zeros((0, len(doc_stats.FEATURES))), np.zeros(0)
    x, y = np.array(got["x"].tolist(), dtype=float), got["label"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))  # the same whatever order the rows come in
    return x[order], y[order]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> boosting.FlatTrees:
    """The trees, fitted on at most `sample` labelled rows outside the held-out fifth."""
    x, y = sample_matrix(labelled(docs, labels, "quality", sample, id_col, text_col))
    return boosting.fit(x, 1 - y, {doc_stats.FEATURES.index(f): 1 for f in WORSE})


def apply_rules(docs: DataFrame, model: boosting.FlatTrees, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """id, the base counts, base_failed, bad_score and kept for every whole text.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words. kept: not base_failed and
    bad_score <= reject. A null or empty text has counts of 0 and fails the base. A row out for each
    row in: null ids, ties and repeated rows pass through, other columns are not read.
    """

    return per_text(docs, id_col, text_col, COLUMNS, lambda: lambda texts: verdicts(texts, model, reject))


def verdicts(texts: list, model: boosting.FlatTrees, reject: float = REJECT) -> list[tuple]:
    """What apply_rules() says of each text."""
    found = [doc_stats.base(t) for t in texts]
    bad = model.probability(np.array([doc_stats.features(f) for f in found], dtype=float).reshape(len(texts), -1))
    out = []
    for f, p in zip(found, bad.tolist(), strict=True):
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        out.append((*f[:5], failed, p, not failed and p <= reject))
    return out


def kept_documents(docs: DataFrame, model: boosting.FlatTrees, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows that apply_rules() keeps, with all their columns, whatever their names; no row moves.

    A null or empty text has no words and goes. Null ids, ties and repeated rows are judged row by
    row, by the text alone. An empty table gives an empty one.
    """
    return keep_rows(docs, text_col, lambda: lambda texts: [v[-1] for v in verdicts(texts, model, reject)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality_rules": query}
SQL: dict[str, str] = {}
