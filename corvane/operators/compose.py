"""Terms of several searches put together into one score, its features and its ranked list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the terms as the composite uses them by default (fixed values).
WEIGHTS = {"spectral": 1.0, "analog": 1.0, "fingerprint": 32.0, "shifted": 16.0, "prior": 0.5}
GATE = 0.8


def union_terms(terms: dict[str, DataFrame], key: list[str], value: str = "value") -> DataFrame:
    """Long rows (key, term, value) of the named term tables."""
    return reduce(DataFrame.unionByName, [t.select(*key, F.lit(name).alias("term"), F.col(value).cast("double").alias("value")) for name, t in terms.items()])


def composite(rows: DataFrame, key: list[str], query: str, weights: dict[str, float] | None = None, gate: float = GATE) -> DataFrame:
    """(key, a column for each term, total): missing terms are 0; the prior counts only for queries whose best spectral value is under the gate."""
    weights = weights or WEIGHTS
    wide = rows.groupBy(*key).agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("value"))), F.lit(0.0)).alias(t) for t in weights])
    best = wide.groupBy(query).agg(F.max("spectral").alias("best_spectral"))
    wide = wide.join(best, query)
    part = {t: F.col(t) * w for t, w in weights.items()}
    part["prior"] = F.when(F.col("best_spectral") < gate, part["prior"]).otherwise(0.0)
    return wide.withColumn("total", sum(list(part.values())[1:], list(part.values())[0]))


def normalised_term(query: str, value: str, kind: str) -> Column:
    """A term within its query's pool: raw, over its sd, as z-score, or as scaled rank (best 0)."""
    from .ranking import ordinal_rank, z_score

    if kind == "raw":
        return F.col(value).cast("double")
    if kind in ("std", "z"):
        return z_score([query], value, kind == "z")
    return ordinal_rank([query], [F.col(value).desc(), F.col("key")])


def features(scored: DataFrame, query: str, key: str, terms: list[str]) -> DataFrame:
    """For each candidate and term: value, scaled rank, gap to the best and z-score, and the pool's log size and the term flags."""
    from .ranking import gap_to_best, ordinal_rank, z_score

    columns = [F.col(query), F.col(key), F.ln(F.count("*").over(Window.partitionBy(query))).alias("log_pool")]
    for t in terms:
        columns += [F.col(t), ordinal_rank([query], [F.col(t).desc(), F.col(key)]).alias(f"{t}_rank"), gap_to_best([query], t).alias(f"{t}_gap"), z_score([query], t).alias(f"{t}_z"), (F.col(t) > 0).cast("int").alias(f"{t}_has")]
    return scored.select(*columns)


def ranked_list(df: DataFrame, query: str, rank: str, item: str, fallback: str, queries: DataFrame, glue: str = ";") -> DataFrame:
    """(query, items): each query's items in rank order in one string; the fallback where it has none."""
    lists = df.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda s: s[item].cast("string")), glue).alias("items"))
    return queries.select(query).distinct().join(lists, query, "left").select(query, F.coalesce("items", F.lit(fallback)).alias("items"))


def two_level(rows: DataFrame, query: str, record: str, key: str, sim: str) -> DataFrame:
    """(query, key, score): the best similarity of each record of the query, summed over its records."""
    return rows.groupBy(query, record, key).agg(F.max(sim).alias("__best")).groupBy(query, key).agg(F.sum("__best").alias("score"))
