"""Packed bits and similarities on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(flags: Column) -> Column:
    """An array of up to 63 booleans as one long, the first one highest."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long"))


def unpack(word: Column, n: int) -> Column:
    """The n lowest bits of a long as an array of 0 and 1, the highest first."""
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: F.getbit(word, i).cast("int"))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def shared_bits(a: Column, b: Column) -> Column:
    """Set bits that two arrays of longs have in common."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, v: acc + v)


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over all bits of both; 0 where neither has one."""
    inter = shared_bits(a, b)
    return inter / F.greatest(popcount(a) + popcount(b) - inter, F.lit(1))


def soft_tanimoto(p: Column, b: Column) -> Column:
    """Sum p*b over (sum b + sum p - sum p*b) for probabilities p and bits b as arrays of doubles; 0 where that is 0."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(p, b, lambda x, y: x * y), zero, lambda acc, v: acc + v)
    whole = F.aggregate(p, zero, lambda acc, v: acc + v) + F.aggregate(b, zero, lambda acc, v: acc + v) - dot
    return F.when(whole > 0, dot / whole).otherwise(0.0)


def propagated(pool: DataFrame, seeds: DataFrame, on: str, pool_key: str, pool_fp: str, seed_fp: str, score: str, how: str = "max", power: float = 1.0) -> DataFrame:
    """(on, pool_key, analog): the best (or summed) score ** power * tanimoto over the seeds of the same query, where above 0."""
    both = pool.select(on, pool_key, pool_fp).join(seeds.select(on, F.col(seed_fp).alias("__fp"), F.col(score).alias("__score")), on)
    term = F.pow("__score", F.lit(float(power))) * tanimoto(F.col(pool_fp), F.col("__fp"))
    return both.groupBy(on, pool_key).agg({"max": F.max, "sum": F.sum}[how](term).alias("analog")).where("analog > 0")
