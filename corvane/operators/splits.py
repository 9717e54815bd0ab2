"""Leak-free splits: grouped folds, leave one group out, a three-class novelty split, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .topk import capped_sample, shuffled


def group_fold(key: Column, k: int, seed: str = "fold") -> Column:
    """The fold of a group's key: rows of a group stay together, equal keys of other tables get the same fold."""
    return F.pmod(F.conv(F.substring(shuffled(seed, key), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def balanced_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, fold): groups by falling size (then key) dealt out to k folds in turn."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__n"))
    return numbered(sizes, [F.col("__n").desc(), F.col(key)], "__place").select(key, F.pmod("__place", F.lit(k)).cast("int").alias("fold"))


def novelty_split(rows: DataFrame, row_id: str, key: str, source: str, per_class: int, queries_each: int, seed: str) -> dict[str, DataFrame]:
    """Queries, dropped rows and banned keys of a split by how new a query's key is to the library.

    Class 1: the key stays known by other sources, one source's rows are held out. Class 2: all of the
    key's rows are held out. Class 3: its rows are held out and its key is banned. Keys are dealt by a
    hash: class 1 takes keys of two sources or more, the others of the rest. At most queries_each
    rows of a key become queries; all its held-out rows are dropped.
    """
    keys = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(source).alias("sources"), F.min(source).alias("held"))
    turn = F.pmod(F.conv(F.substring(shuffled(seed, F.col(key)), 1, 8), 16, 10).cast("long"), F.lit(3))
    keys = keys.withColumn("qclass", F.when((F.col("sources") > 1) & (turn == 0), 1).when(turn == 1, 2).when(turn == 2, 3)).where("qclass is not null")
    picked = capped_sample(keys, ["qclass"], [key], per_class, seed).select(key, "qclass", "held")
    out = rows.join(picked, key).where((F.col("qclass") > 1) | (F.col(source) == F.col("held")))
    queries = capped_sample(out, [key], [row_id], queries_each, seed)
    return {"queries": queries.select(row_id, key, "qclass"), "drop": out.select(row_id), "banned": picked.where("qclass = 3").select(key)}


def violations(split: dict[str, DataFrame], row_id: str, key: str) -> DataFrame:
    """(rule, broken): rows that break a rule of the split; all 0 in a sound one."""
    q, drop, banned = split["queries"], split["drop"], split["banned"]
    kept = q.join(drop, row_id, "left_anti").agg(F.lit("queries are dropped rows").alias("rule"), F.count("*").alias("broken"))
    foreign = banned.join(q, key, "left_anti").agg(F.lit("banned keys are queries' keys").alias("rule"), F.count("*").alias("broken"))
    loose = q.where("qclass = 3").join(banned, key, "left_anti").agg(F.lit("class 3 keys are banned").alias("rule"), F.count("*").alias("broken"))
    return kept.union(foreign).union(loose)
