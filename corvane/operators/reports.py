"""What is asked of a ranker's table: how a score stands, cross-validated gains, a fit that is checked as it is exported, each feature's AUC.

A query's rows are a candidate list of bounded length (candidates.KEEP), so windows go by query.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import metrics, ranker
from .splits import group_fold

#: Places that count for a reciprocal rank, rows that an exported scorer is checked on, and by how much it may differ.
MOST, CHECKED, TOLERANCE = 25, 5000, 1e-9
_WHOLE = ("feature", "left", "right", "root")


def reciprocal_ranks(rows: DataFrame, queries: DataFrame, query: str, row: str, score: str, label: str, most: int = MOST, name: str = "rr") -> DataFrame:
    """(query, name): 1 over the place of the first row with label 1, by falling score (null last, ties by row); 0 beyond `most`, without such a row, and for queries without rows."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc_nulls_last(), row))
    first = rows.withColumn("__place", place).where(F.col(label) == 1).groupBy(query).agg(F.min("__place").alias("__first"))
    got = F.when(F.col("__first") <= most, 1 / F.col("__first")).otherwise(0.0)
    return queries.join(first, query, "left").withColumn(name, got).drop("__first")


def standing(rows: DataFrame, queries: DataFrame, query: str, row: str, score: str, label: str, cohort: str, most: int = MOST) -> DataFrame:
    """For each cohort (a column of queries): queries, the mean reciprocal rank of the score, and the ceilings: how many have their answer among the first `most`, and in the list at all."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc_nulls_last(), row))
    first = rows.withColumn("__place", place).where(F.col(label) == 1).groupBy(query).agg(F.min("__place").alias("__first"))
    near = F.coalesce(F.col("__first") <= most, F.lit(False))
    each = queries.select(query, cohort).join(first, query, "left")
    return each.groupBy(cohort).agg(F.count("*").alias("queries"), F.avg(F.when(near, 1 / F.col("__first")).otherwise(0.0)).alias("mrr"), F.sum(near.cast("long")).alias("near"), F.count("__first").alias("listed"))


def cross_validated(rows: DataFrame, query: str, row: str, features: list[str], label: str, folds: int = 5, weight: str | None = None, settings: ranker.Settings = ranker.Settings()) -> DataFrame:
    """rows with fold and score: each by the ranker of the other folds, which are grown side by side. A query's rows stay together; queries of a null id are left out."""
    held = rows.where(F.col(query).isNotNull()).withColumn("fold", group_fold(F.col(query), folds)).persist()  # read by several passes for each fold

    models = ranker.fit_without_each(held, query, row, features, label, "fold", list(range(folds)), weight, settings)
    return reduce(DataFrame.unionByName, [model.scored(held.where(F.col("fold") == k)) for k, model in models.items()])


def _both_ranks(rows: DataFrame, queries: DataFrame, query: str, row: str, base: str, score: str, label: str, most: int) -> DataFrame:
    """queries with the reciprocal ranks by base and by score (learned), as reciprocal_ranks gives each; the rows are read and shuffled once."""
    columns = {"base": base, "learned": score}
    place = lambda c: F.row_number().over(Window.partitionBy(query).orderBy(F.col(c).desc_nulls_last(), row))
    placed = rows.select(query, label, *[place(c).alias(f"__{name}") for name, c in columns.items()])
    first = placed.where(F.col(label) == 1).groupBy(query).agg(*[F.min(f"__{name}").alias(f"__{name}") for name in columns])
    both = queries.join(first, query, "left")
    return both.withColumns({name: F.when(F.col(f"__{name}") <= most, 1 / F.col(f"__{name}")).otherwise(0.0) for name in columns}).drop("__base", "__learned")


def gain(rows: DataFrame, queries: DataFrame, query: str, row: str, base: str, score: str, label: str, cohort: str, most: int = MOST) -> DataFrame:
    """For each cohort: queries, the mean reciprocal ranks by base and by score, and the paired difference with its standard error (sample sd; null for one query)."""
    both = _both_ranks(rows, queries.select(query, cohort), query, row, base, score, label, most)
    d = F.col("learned") - F.col("base")
    return both.groupBy(cohort).agg(F.count("*").alias("queries"), F.avg("base").alias("base"), F.avg("learned").alias("learned"), F.avg(d).alias("difference"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("error"))


def gain_bounds(rows: DataFrame, queries: DataFrame, query: str, row: str, base: str, score: str, label: str, most: int = MOST, replicates: int = 1000) -> DataFrame:
    """(mean, low, high) of the learned less the base reciprocal rank over all queries, by bootstrap."""
    both = _both_ranks(rows, queries.select(query), query, row, base, score, label, most)
    return metrics.bootstrap(both, query, "learned", "base", replicates)


def fit_and_export(rows: DataFrame, query: str, row: str, features: list[str], label: str, path: str, weight: str | None = None, settings: ranker.Settings = ranker.Settings(), checked: int = CHECKED) -> ranker.Ranker:
    """A ranker of all rows, written at path as flat arrays with its features and settings.

    What was written is read again and must score `checked` of the rows as the model does, to 1e-9; else a ValueError says by how much it differs.
    """
    spark = rows.sparkSession
    model = ranker.fit(rows, query, row, features, label, weight, settings)
    head = json.dumps({"features": features, "settings": asdict(settings)}, sort_keys=True, default=str)
    lines = [(k, part, np.asarray(v, float).tolist(), head) for k, seed in enumerate(model.flat()) for part, v in seed.items()]
    spark.createDataFrame(lines, "seed int, part string, numbers array<double>, head string").coalesce(1).write.parquet(path)
    names, flat = load(spark, path)
    some = rows.select(F.array(*[F.col(c).cast("double") for c in names]).alias("x"), model.score().alias("s")).limit(checked).collect()  # a bounded check of the export
    if some:
        x = np.array([[np.nan if v is None else v for v in r["x"]] for r in some])
        apart = float(np.abs(ranker.flat_scores(flat, x) - np.array([r["s"] for r in some])).max())
        if not apart < TOLERANCE:
            raise ValueError(f"the exported ranker's scores differ by {apart}")
    return model


def load(spark: SparkSession, path: str) -> tuple[list[str], list[dict[str, np.ndarray]]]:
    """The features, and the arrays for ranker.flat_scores, of a ranker that fit_and_export() wrote."""
    lines = spark.read.parquet(path).collect()  # a few rows a seed
    seeds: dict[int, dict[str, np.ndarray]] = {}
    for r in lines:
        seeds.setdefault(r["seed"], {})[r["part"]] = np.array(r["numbers"], dtype=int if r["part"] in _WHOLE else float)
    return json.loads(lines[0]["head"])["features"], [seeds[k] for k in sorted(seeds)]


def feature_auc(rows: DataFrame, query: str, features: list[str], label: str) -> DataFrame:
    """(feature, auc, queries): the mean over queries with both labels of the answer's AUC against the query's other rows, ties counted half. Null features are left out."""
    long = rows.select(query, F.col(label).cast("long").alias("__y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("f"))
    long = long.select(query, "__y", "f.*").where("v is not null and __y is not null")
    own = Window.partitionBy("feature", query)
    ranks = F.rank().over(own.orderBy("v")) + (F.count("*").over(Window.partitionBy("feature", query, "v")) - 1) / 2
    sums = long.withColumn("__r", ranks).groupBy("feature", query).agg(F.sum(F.when(F.col("__y") == 1, F.col("__r")).otherwise(0.0)).alias("__sum"), F.sum("__y").alias("__p"), F.count("*").alias("__n"))
    p, n = F.col("__p"), F.col("__n") - F.col("__p")
    each = sums.where((p > 0) & (n > 0)).withColumn("__auc", (F.col("__sum") - p * (p + 1) / 2) / (p * n))
    return each.groupBy("feature").agg(F.avg("__auc").alias("auc"), F.count("*").alias("queries"))


def swept(rows: DataFrame, queries: DataFrame, query: str, row: str, label: str, settings: list[dict[str, float]], most: int = MOST) -> DataFrame:
    """A row for each setting (term: weight, the same terms in all): its weights, queries, and the mean reciprocal rank of the weighed sum.

    The candidates are read and shuffled by query once, however many settings there are: each is a column of sums. Null terms count as 0; sums are rounded to 9 digits; ties go by row,
    which is a number; queries without rows or without an answer count as 0.
    """
    terms = list(settings[0])
    if any(set(s) != set(terms) for s in settings):
        raise ValueError("all settings weigh the same terms")
    marks = [F.struct(F.round(sum((F.coalesce(F.col(t).cast("double"), F.lit(0.0)) * float(s[t]) for t in terms), F.lit(0.0)), 9).alias("score"), (-F.col(row)).alias("row")) for s in settings]
    slim = rows.select(query, (F.col(label) == 1).alias("__hit"), *[m.alias(f"__m{k}") for k, m in enumerate(marks)])
    own = Window.partitionBy(query)
    best = slim.withColumns({f"__b{k}": F.max(F.when(F.col("__hit"), F.col(f"__m{k}"))).over(own) for k in range(len(settings))})
    places = [(F.sum((F.col(f"__m{k}") > F.col(f"__b{k}")).cast("long")) + 1).alias(f"__p{k}") for k in range(len(settings))]  # null without an answer
    each = queries.select(query).join(best.groupBy(query).agg(*places), query, "left")
    mean = lambda k: F.avg(F.when(F.col(f"__p{k}") <= most, 1 / F.col(f"__p{k}")).otherwise(0.0))
    one = each.agg(F.count("*").alias("queries"), *[mean(k).alias(f"__r{k}") for k in range(len(settings))])
    lines = [F.struct(*[F.lit(float(s[t])).alias(t) for t in terms], "queries", F.col(f"__r{k}").alias("mrr")) for k, s in enumerate(settings)]
    return one.select(F.explode(F.array(*lines)).alias("r")).select("r.*")
