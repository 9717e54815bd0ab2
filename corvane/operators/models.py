"""Linear and tree models: one-vs-rest logistic, ridge from Gram matrices, boosted trees, wrappers, a portable scorer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .heads import fold_sums


def gram(df: DataFrame, features: str, target: str, n_features: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, X'y, rows) in one pass: each task adds up its own matrices and hands on one row of numbers. Sizes depend on the features alone."""
    rows = df.select(F.col(features).alias("x"), F.array(F.col(target).cast("double")).alias("y"))
    sums = fold_sums(rows, [], "x", "y", n_features, 1).get(())
    if sums is None:
        return np.zeros((n_features, n_features)), np.zeros(n_features), 0
    return sums.xx, sums.xy[:, 0], int(sums.weight)


def ridge(xx: np.ndarray, xy: np.ndarray, alphas: list[float]) -> dict[float, np.ndarray]:
    """Solutions of (X'X + alpha I) w = X'y, many from one pass over the data."""
    return {a: np.linalg.solve(xx + a * np.eye(len(xx)), xy) for a in alphas}


def dot(features: Column, weights) -> Column:
    """The product of an array column with fixed weights, in the JVM."""
    return F.aggregate(F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda acc, v: acc + v)


def one_vs_rest(train: DataFrame, features: str, label: str, classes: list, c: float = 0.01) -> dict:
    """A logistic model for each class with a positive and a negative row: balanced weights, penalty 1 / (c * sum of weights)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(features).alias("features"), label).persist()
    n = rows.count()
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    models = {}
    for k in classes:
        p = counts.get(k, 0)
        if 0 < p < n:
            y = (F.col(label) == k).cast("double")
            weighed = rows.withColumn("y", y).withColumn("w", F.when(F.col("y") == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p))))
            models[k] = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1 / (c * n), standardization=False, maxIter=50).fit(weighed)
    rows.unpersist()
    return models


def class_scores(df: DataFrame, features: str, models: dict, classes: list) -> DataFrame:
    """A column p_<class> for each class: the model's probability, 0.5 where there is no model."""
    out = {f"p_{k}": F.lit(0.5) if k not in models else 1 / (1 + F.exp(-(dot(F.col(features), models[k].coefficients) + float(models[k].intercept)))) for k in classes}
    return df.withColumns(out)


def boosted(train: DataFrame, features: list[str], target: str, classify: bool, iterations: int = 20, depth: int = 3):
    """Gradient-boosted trees of Spark ML: absolute loss for a number, logistic for yes and no."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(train)
    kind = GBTClassifier(maxIter=iterations, maxDepth=depth, seed=1) if classify else GBTRegressor(lossType="absolute", maxIter=iterations, maxDepth=depth, seed=1)
    return kind.setLabelCol(target).setFeaturesCol("features").fit(rows)


def tree_score(nodes: list[dict], features: list[str], at: int = 0) -> Column:
    """One tree as a CASE expression: x <= threshold goes left, NaN where `nan_left` says, leaves give their value."""
    node = nodes[at]
    if "value" in node:
        return F.lit(float(node["value"]))
    x = F.col(features[node["feature"]])
    goes = F.when(F.isnan(x) | x.isNull(), F.lit(bool(node.get("nan_left", True)))).otherwise(x <= node["threshold"])
    return F.when(goes, tree_score(nodes, features, node["left"])).otherwise(tree_score(nodes, features, node["right"]))


def ensemble_score(trees: list[list[dict]], features: list[str], baseline: float = 0.0, logistic: bool = False) -> Column:
    """Sum of the trees and the baseline, through the logistic function if asked for."""
    total = F.lit(float(baseline))
    for t in trees:
        total = total + tree_score(t, features)
    return 1 / (1 + F.exp(-total)) if logistic else total


def exported(model) -> tuple[list[list[dict]], float]:
    """The trees of a fitted model of boosted() as lists of nodes for ensemble_score(), and its baseline.

    Leaves carry the tree's weight; a node's children follow it. A classifier's margins are doubled, as its probability is logistic in that.
    """
    scale = 2.0 if model.__class__.__name__.startswith("GBTClass") else 1.0
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list[dict] = []

        def add(node, nodes=nodes, weight=weight) -> int:
            at = len(nodes)
            if node.subtreeDepth() == 0:
                nodes.append({"value": scale * weight * node.prediction()})
                return at
            split = node.split()
            nodes.append({"feature": split.featureIndex(), "threshold": split.threshold()})
            nodes[at]["left"] = add(node.leftChild())
            nodes[at]["right"] = add(node.rightChild())
            return at

        add(tree._call_java("rootNode"))
        out.append(nodes)
    return out, 0.0


def export(model, features: list[str], path: str, rows: DataFrame, tolerance: float = 1e-6) -> None:
    """Writes a fitted model's trees as one JSON text table at path, after a check that they score rows as the model does.

    rows hold the features; where any score differs by more than the tolerance nothing is written and a ValueError says so.
    """
    import json

    from pyspark.ml.feature import VectorAssembler

    trees, baseline = exported(model)
    classify = model.__class__.__name__.startswith("GBTClass")
    scored = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    from pyspark.ml.functions import vector_to_array

    own = vector_to_array("probability")[1] if classify else F.col("prediction")
    gap = scored.select(F.max(F.abs(own - ensemble_score(trees, features, baseline, classify))).alias("gap")).first()["gap"]
    if gap is not None and gap > tolerance:
        raise ValueError(f"the exported trees differ from the model by {gap}")
    text = json.dumps({"features": features, "baseline": baseline, "logistic": classify, "trees": trees}, sort_keys=True)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def imported(spark, path: str) -> Column:
    """The score of a model that export() wrote, as a column over its features."""
    import json

    spec = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return ensemble_score(spec["trees"], spec["features"], spec["baseline"], spec["logistic"])


def mlp_probe(train: DataFrame, features: str, label: str, n_features: int, classes: int, hidden: int = 32, iterations: int = 60) -> Callable[[DataFrame], DataFrame]:
    """A network of one hidden layer on array features; what it returns adds `guess`, the likeliest class 0 to classes - 1."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    ready = lambda df: df.withColumn("__x", array_to_vector(features))
    probe = MultilayerPerceptronClassifier(layers=[n_features, hidden, classes], featuresCol="__x", labelCol=label, predictionCol="guess", probabilityCol="__p", rawPredictionCol="__r", seed=1, maxIter=iterations).fit(ready(train))
    return lambda df: probe.transform(ready(df)).drop("__x", "__p", "__r")


def kernel_features(df: DataFrame, features: str, n_features: int, width: float, count: int, seed: int = 0) -> DataFrame:
    """rff array<double>: random Fourier features whose products stand for an RBF kernel."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / width, (count, n_features)), rng.uniform(0, 2 * np.pi, count)
    columns = [F.cos(dot(F.col(features), w[k]) + float(b[k])) * float(np.sqrt(2 / count)) for k in range(count)]
    return df.withColumn("rff", F.array(*columns))


def pairwise_ranker(df: DataFrame, query: str, features: str, label: str, n_features: int, rounds: int = 30, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights of a pairwise logistic ranker: in each query every positive row against every other.

    A query's pairs stay in its group; each round adds up one gradient of n_features numbers.
    """
    import pandas as pd

    def gradients(w):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            x, y = np.array(rows["x"].tolist(), dtype=float), rows["y"].to_numpy() > 0
            total, pairs = np.zeros(n_features), 0
            for p in x[y]:
                d = p - x[~y]
                total += (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) @ d if len(d) else 0
                pairs += len(d)
            return pd.DataFrame({"g": [[*total.tolist(), float(pairs)]]})  # the pairs' number comes last

        return run

    rows = df.select(query, F.col(features).alias("x"), F.col(label).cast("int").alias("y")).persist()
    w = np.zeros(n_features)
    for _ in range(rounds):
        parts = rows.groupBy(query).applyInPandas(gradients(w), "g array<double>").select(F.posexplode("g").alias("i", "v"))
        total = {r["i"]: r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect()}
        if not (n := total.get(n_features, 0)):
            break
        g = np.array([total[k] / n for k in range(n_features)])
        w += rate * (g - l2 * w)
    rows.unpersist()
    return w


def out_of_fold(df: DataFrame, fold: str, folds: list, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Every row scored by the model that was fitted without its fold."""
    parts = [fit(df.where(F.col(fold) != k))(df.where(F.col(fold) == k)) for k in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clipped(guess: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(guess, F.lit(low)), F.lit(high))


def probability_mean(members: list[Column]) -> Column:
    """Mean of the members' probabilities, from their logits."""
    return sum((1 / (1 + F.exp(-m)) for m in members[1:]), 1 / (1 + F.exp(-members[0]))) / len(members)
