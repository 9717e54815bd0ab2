"""Top rows of groups, representatives, and samples that hashes decide, so that any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import placed


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group by an order without ties; Spark keeps k rows a group before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def first_of_each(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, by, order, 1, "__first").drop("__first")


def both_ends(df: DataFrame, by: list[str], value: str, tiebreak: str, k: int) -> DataFrame:
    """The k highest (side 'top') and k lowest (side 'bottom') rows of each group."""
    top = top_k(df, by, [F.col(value).desc(), F.col(tiebreak)], k).withColumn("side", F.lit("top"))
    return top.unionByName(top_k(df, by, [F.col(value).asc(), F.col(tiebreak)], k).withColumn("side", F.lit("bottom")))


def shuffled(seed: str, *ids: Column) -> Column:
    """A place in an order that the seed and the ids decide."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in ids]))


def capped_sample(df: DataFrame, by: list[str], ids: list[str], cap: int, seed: str) -> DataFrame:
    """At most cap rows of each group, chosen by the hash of seed and ids; the cap is the operator's purpose."""
    return top_k(df, by, [shuffled(seed, *map(F.col, ids)), *map(F.col, ids)], cap, "__place").drop("__place")


def fraction(seed: str, share: float, *ids: Column) -> Column:
    """True for about the given share of ids: by the hash's first 8 hexadecimal digits."""
    return F.conv(F.substring(shuffled(seed, *ids), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))


def every_nth(df: DataFrame, order: str, n: int, by: list[str]) -> DataFrame:
    """Rows 1, n + 1, 2n + 1, ... of each group by the order."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__place", place).where(F.pmod(F.col("__place") - 1, F.lit(n)) == 0).drop("__place")


def evenly_spaced(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """k rows of each group (all, where it has fewer) at even distances from first to last, halves rounded to even."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    ranked = placed(df, by, [order], "__place").join(sizes, by)
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("__n") - 1) / float(max(1, k - 1))))
    return ranked.where((F.col("__n") <= k) | F.array_contains(picks, F.col("__place").cast("double"))).drop("__place", "__n")
