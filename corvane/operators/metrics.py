"""Evaluation: AUC, reciprocal ranks, errors, correlations, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rangejoin import by_size
from .ranking import quantiles, tied_counts


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """(by, auc, positives, rows): ROC-AUC of each key, ties counted half; keys with one label alone are left out."""
    slim = df.where(F.col(score).isNotNull()).select(*by, F.col(score).alias("__s"), F.col(label).cast("long").alias("__y"))
    ranks = tied_counts(slim, by, "__s").withColumn("__r", F.col("below") + (F.col("n") + 1) / 2.0)
    hits = slim.groupBy(*by, "__s").agg(F.sum("__y").alias("__p"))
    both = ranks.join(hits, [*by, "__s"]).groupBy(*by).agg(F.sum("__p").alias("positives"), F.max("total").alias("rows"), F.sum(F.col("__p") * F.col("__r")).alias("__sum"))
    return _auc_of(both, by)


def auc_of_few(df: DataFrame, by: list[str], score: str, label: str, rows: int) -> DataFrame:
    """auc() for any number of keys of few distinct scores each: df has about `rows` rows, dealt with key and score to as many tasks as they ask for, and a key's distinct scores go to one task."""
    slim = df.where(F.col(score).isNotNull()).select(*by, F.col(score).alias("__s"), F.col(label).cast("long").alias("__y"))
    counts = by_size(slim, rows, *by, "__s").groupBy(*by, "__s").agg(F.count("*").alias("__n"), F.sum("__y").alias("__p"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, 0))
    ranks = by_size(counts, rows, *by).withColumn("__r", upto - (F.col("__n") - 1) / 2.0)
    return _auc_of(ranks.groupBy(*by).agg(F.sum("__p").alias("positives"), F.sum("__n").alias("rows"), F.sum(F.col("__p") * F.col("__r")).alias("__sum")), by)


def _auc_of(both: DataFrame, by: list[str]) -> DataFrame:
    p, n = F.col("positives").cast("double"), (F.col("rows") - F.col("positives")).cast("double")
    return both.where((p > 0) & (n > 0)).select(*by, ((F.col("__sum") - p * (p + 1) / 2) / (p * n)).alias("auc"), "positives", "rows")


def reciprocal_ranks(queries: DataFrame, ranked: DataFrame, key: str, rank: str, hit: Column, most: int = 25) -> DataFrame:
    """(key, rr): 1 / the first hit's rank up to `most`, 0 for queries without one, also those without rows."""
    first = ranked.where((F.col(rank) <= most) & hit).groupBy(key).agg(F.min(rank).alias("__first"))
    return queries.select(key).distinct().join(first, key, "left").select(key, F.coalesce(1.0 / F.col("__first"), F.lit(0.0)).alias("rr"))


def strict_rank(df: DataFrame, by: list[str], score: str, answer: Column) -> DataFrame:
    """(by, place): 1 + the rows that score strictly higher than the best answer of the key."""
    best = df.where(answer).groupBy(*by).agg(F.max(score).alias("__best"))
    return df.join(best, by).groupBy(*by).agg((1 + F.sum((F.col(score) > F.col("__best")).cast("long"))).alias("place"))


def error_by_fold(df: DataFrame, fold: str, truth: str, guess: Column) -> DataFrame:
    return df.groupBy(fold).agg(F.avg(F.abs(F.col(truth) - guess)).alias("mae"))


def spread_of(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, rho): correlation of tie-averaged ranks."""
    from .ranking import average_rank

    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = average_rank(average_rank(both, by, a, "__ra", False), by, b, "__rb", False)
    return both.groupBy(*by).agg(F.corr("__ra", "__rb").alias("rho"))


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference a - b, its standard error (sample sd), how many such errors it is, and the rows that a wins."""
    d = F.col(a) - F.col(b)
    got = df.agg(F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("sem"), F.sum((d > 0).cast("long")).alias("wins"), F.count(d).alias("n"))
    return got.withColumn("sigma", F.when(F.col("sem") > 0, F.col("mean") / F.col("sem")).otherwise(0.0))


def bootstrap(df: DataFrame, key: str, a: str, b: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(mean, low, high): the mean difference a - b and the 2.5 and 97.5 percentiles of its bootstrap means.

    Rows are weighed by Poisson(1) counts that a hash of seed, replicate and key draws, so replicates
    need no shuffle of the rows: each task sums weights and weighted differences for each replicate.
    """
    d = F.col(a) - F.col(b)
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    steps, cumulative, term = [], 0.0, 2.718281828459045**-1
    for k in range(12):
        cumulative += term
        steps.append(F.when(u > cumulative, 1).otherwise(0))
        term /= k + 1
    drawn = df.select(key, d.alias("d")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("w", sum(steps[1:], steps[0]))
    means = drawn.groupBy("replicate").agg((F.sum(F.col("w") * F.col("d")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    whole = df.agg(F.avg(d).alias("mean"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")).crossJoin(whole).select("mean", "low", "high")


def bucket_of(value: Column, edges: list[int]) -> Column:
    """The index of the last edge at or below the value."""
    out = F.lit(-1)
    for i, e in enumerate(edges):
        out = F.when(value >= e, i).otherwise(out)
    return out


def leave_one_out_median(df: DataFrame, fold: str, value: str) -> DataFrame:
    """(fold, median): of the values of all other folds. Values are counted first; a fold meets the counts, not the rows."""
    counts = df.groupBy(fold, value).agg(F.count("*").alias("n"))
    folds = df.select(F.col(fold).alias("__held")).distinct()
    other = folds.join(counts, F.col("__held") != F.col(fold))
    other = other.select(F.col("__held").alias(fold), value, "n")
    return quantiles(other, [fold], value, {"median": 0.5}, "n")


def rows_before(by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
