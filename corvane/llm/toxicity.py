"""Toxicity by a classifier chain: kinds of toxic documents first, toxicity last.

The categories are predicted one after another by linear (logistic) models; each later model also
sees the probabilities of the earlier categories, and is trained on out-of-fold ones, so that it
meets in training what it meets in use; a fold's labels have no part in what is predicted for it. labels.toxic marks the last category. The kinds before it
are found in the training rows: their toxic documents are clustered by the terms that tell toxic
documents from others, and each cluster is a category, the largest first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_text, table
from .training import labelled

#: Most labelled rows that the chain is fitted on, and most terms that it looks at.
SAMPLE = 8000
TERMS = 256
FOLDS = 5
#: Documents count as toxic from this probability of the last category.
THRESHOLD = 0.4
#: Kinds of toxic documents that are told apart; the chain's last category is toxicity itself.
KINDS = 2
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
_WORDS = re.compile(r"[^\W\d_]+")


#: Beginnings of longer words that count as terms too, written with a star.
STEMS = (5, 7)


def words(text: str | None) -> set[str]:
    """Distinct lower-cased stretches of letters, and the beginnings of the longer ones."""
    found = set(_WORDS.findall(text.lower())) if text else set()
    return found | {w[:k] + "*" for w in found for k in STEMS if len(w) > k}


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 60) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with halved steps; a constant target gives its share alone."""
    n, d = x.shape
    w = np.zeros(d + 1)
    share = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return w
    xb = np.hstack([x, np.ones((n, 1))])
    penalty = np.full(d + 1, l2)
    penalty[-1] = 1e-6
    loss = lambda v: float((np.logaddexp(0, xb @ v) - y * (xb @ v)).sum() + (penalty * v * v).sum() / 2)
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -35, 35)))
        move = np.linalg.solve((xb * (p * (1 - p) + 1e-9)[:, None]).T @ xb + np.diag(penalty), xb.T @ (p - y) + penalty * w)
        size = 1.0
        while (after := loss(w - size * move)) > now and size > 1e-6:
            size /= 2
        w, gain, now = w - size * move, now - after, after
        if gain < 1e-10 * max(1.0, now):
            break
    return w


def probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))


def kinds_of(x: np.ndarray, kinds: int, rounds: int = 50) -> np.ndarray:
    """The kind (0, 1, ...) of each row of term marks, by k-means on rows of length 1; the largest kind is 0.

    The first centre is the row nearest to the mean, each next one the row least like those before;
    among equals the first row, so that the same rows in the same order give the same kinds.
    """
    if not len(x):
        return np.zeros(0, dtype=int)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = unit[[int(np.argmax(unit @ unit.mean(axis=0)))]]
    while len(centres) < kinds:
        centres = np.vstack([centres, unit[int(np.argmin((unit @ centres.T).max(axis=1)))]])
    own = None
    for _ in range(rounds):
        near = np.argmax(np.round(unit @ centres.T, 12), axis=1)
        if own is not None and (near == own).all():
            break
        own = near
        centres = np.vstack([unit[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(kinds)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    order = np.argsort(-np.bincount(own, minlength=kinds), kind="stable")
    return np.argsort(order)[own]


@dataclass
class Chain:
    terms: dict[str, int]
    categories: tuple[str, ...]
    weights: list[np.ndarray]

    def matrix(self, found: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(found), len(self.terms)))
        for i, own in enumerate(found):
            for t in own & self.terms.keys():
                x[i, self.terms[t]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category, in the chain's order."""
        seen = np.zeros((len(x), 0))
        for w in self.weights:
            seen = np.hstack([seen, probabilities(np.hstack([x, seen]), w)[:, None]])
        return seen


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, seen: np.ndarray | None = None) -> list[np.ndarray]:
    """The chain's weights. y: a column for each category; folds: each row's fold.

    seen: the out-of-fold probabilities of all categories but the last. Where they aren't given, each category's come from models of
    the other folds on the same x and y: right where these were fixed without looking at the labels.
    """
    weights, own = [], np.zeros((len(x), 0)) if seen is None else seen
    for k in range(y.shape[1]):
        inputs = np.hstack([x, own[:, :k]])
        weights.append(fit_logistic(inputs, y[:, k]))
        if seen is None and k + 1 < y.shape[1]:
            out = np.zeros(len(x))
            for fold in np.unique(folds):
                held = folds == fold
                out[held] = probabilities(inputs[held], fit_logistic(inputs[~held], y[~held, k]))
            own = np.hstack([own, out[:, None]])
    return weights


def left_out(folds: list[int], kinds: int = KINDS) -> list[frozenset]:
    """The sets of folds that some model of the chain must not see: up to one fold for each category before the last."""
    return [frozenset(s) for size in range(kinds + 1) for s in combinations(sorted(folds), size)]


def named_alike(kinds: np.ndarray, model: np.ndarray, n: int = KINDS) -> np.ndarray:
    """kinds renumbered so that they share the most rows with the model's: the largest overlap is settled first."""
    shared = np.array([[((kinds == a) & (model == b)).sum() for b in range(n)] for a in range(n)])
    to: dict[int, int] = {}
    for a, b in sorted(np.ndindex(n, n), key=lambda p: (-shared[p], p)):
        if a not in to and b not in to.values():
            to[a] = b
    return np.array([to[k] for k in kinds.tolist()], dtype=int)


def fitted(found: list[set[str]], toxic: np.ndarray, folds: np.ndarray, terms: dict[frozenset, list[str]]) -> Chain:
    """The chain of rows with their words, whether they are toxic, and their folds; terms: the words to look at for each set of left-out folds.

    A row's probabilities that later models are trained with come from chains that were fitted without its fold
    from the beginning: its label had no part in their terms, their kinds or their weights. Such a chain's own
    inputs come from chains without a further fold, and so on, a category less each time. Kinds found
    without some rows are named after those of all rows that they share most rows with.
    """
    everywhere = np.zeros(len(found), dtype=int)
    chains: dict[frozenset, Chain] = {}

    def without(out: frozenset) -> Chain:
        if out in chains:
            return chains[out]
        chain = Chain({t: i for i, t in enumerate(terms[out])}, CATEGORIES[: len(CATEGORIES) - len(out)], [])
        on = np.flatnonzero(~np.isin(folds, list(out)))
        x, hot = chain.matrix([found[i] for i in on]), toxic[on]
        kind = kinds_of(x[hot], KINDS)
        if out:
            kind = named_alike(kind, everywhere[on][hot])
        else:
            everywhere[on[hot]] = kind
        y = np.zeros((len(on), len(CATEGORIES)))
        y[np.flatnonzero(hot), kind] = 1
        y[hot, -1] = 1
        n = len(chain.categories)
        seen = np.zeros((len(on), n - 1))
        if n > 1:
            for fold in np.unique(folds[on]).tolist():
                held = np.flatnonzero(folds[on] == fold)
                other = without(out | {fold})
                seen[held] = other.predict(other.matrix([found[on[i]] for i in held]))
        chain.weights = fit_chain(x, y[:, :n], folds[on], seen)
        chains[out] = chain
        return chain

    return without(frozenset())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain, fitted on at most `sample` labelled rows outside the held-out fifth.

    Its terms are the `terms` words that the sample's toxic documents use most unlike the others
    (chi-square of presence, more common in toxic ones, in 3 toxic documents at least; ties by the word).
    The kinds of toxic documents are found by the same terms in the same rows. For out-of-fold inputs both are found again without
    each fold (fitted()): words are counted once, by fold, and each set of left-out folds takes its sums off the total.
    """
    rows = labelled(docs, labels, "toxic", sample, id_col, text_col)
    keyed = rows.select(F.struct("id", "label").alias("key"), "text")
    found = per_text(keyed, "key", "text", "words array<string>", lambda: lambda texts: [(sorted(words(t)),) for t in texts])
    hashed = F.crc32(F.col("key.id").cast("string"))
    found = found.select(F.col("key.label").alias("label"), hashed.alias("h"), (F.floor(hashed / 5) % FOLDS).cast("int").alias("fold"), "words").persist()
    try:
        sizes = {r["fold"]: (r["n"], r["hot"]) for r in found.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("hot")).collect()}  # FOLDS rows
        outs = left_out(list(sizes))
        in_fold = lambda f, v: F.sum(F.when(F.col("fold") == f, v).otherwise(0)).cast("double")
        counts = [c for f in sizes for c in (in_fold(f, F.col("label")).alias(f"a{f}"), in_fold(f, F.lit(1)).alias(f"m{f}"))]
        used = found.select("label", "fold", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("uses"), *counts)

        def strength(out):
            kept = [f for f in sizes if f not in out]
            n, hot = (sum(sizes[f][k] for f in kept) for k in (0, 1))
            a, m = (sum((F.col(f"{c}{f}") for f in kept), F.lit(0.0)) for c in "am")
            gap = a * n - m * hot
            return F.when((a >= 3) & (gap > 0), gap * gap / (m * (n + 1 - m)))

        each = F.explode(F.array(*[F.struct(F.lit(k).alias("out"), strength(out).alias("strength")) for k, out in enumerate(outs)]))
        ranked = used.select("word", each.alias("own")).select("word", "own.*").where("strength is not null")
        place = F.row_number().over(Window.partitionBy("out").orderBy(F.desc("strength"), "word"))
        best = ranked.withColumn("place", place).where(F.col("place") <= terms).select("out", "word").collect()  # at most `terms` for each set
        chosen = {out: sorted(r["word"] for r in best if r["out"] == k) for k, out in enumerate(outs)}
        every = sorted({r["word"] for r in best})
        keep = F.array(*map(F.lit, every)) if every else F.array().cast("array<string>")
        got = found.select("label", "h", F.array_intersect("words", keep).alias("own")).toPandas()
    finally:
        found.unpersist()
    got = sorted(zip(got["h"], got["label"], map(set, got["own"]), strict=True), key=lambda r: (r[0], r[1], sorted(r[2])))
    folds = np.array([h // 5 % FOLDS for h, *_ in got], dtype=int)
    return fitted([own for *_, own in got], np.array([label == 1 for _, label, _ in got], dtype=bool), folds, chosen)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, p_kind_1, p_kind_2, p_toxic and toxic (1 where p_toxic >= threshold) for every whole text.

    A null or empty text has no terms and gets the chain's base probabilities. A row out for each row
    in: null ids, ties and repeated rows pass through, other columns are not read.
    """

    def make():
        def work(texts):
            p = chain.predict(chain.matrix([words(t) for t in texts])).tolist()
            return [(*row, int(row[-1] >= threshold)) for row in p]

        return work

    return per_text(docs, id_col, text_col, ", ".join(f"p_{c} double" for c in chain.categories) + ", toxic int", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity_chain": query}
SQL: dict[str, str] = {}
