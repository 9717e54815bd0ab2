"""How many records of a mass window lie in each of several widths, and nearer than a given one: counted on sorted masses, without pairs."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rangejoin import MOST_PARTS, ppm_sides

#: Records of a chunk of a window, about, and rows of a task.
CHUNK, ROWS = 500_000, 500_000
#: Gaps are rounded to so many digits; two that differ by more than EDGE are in order before and after.
DIGITS, EDGE = 6, 2e-6


def gaps(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """|a - b| rounded as Spark and the SQL round: halves up."""
    x = np.abs(a - b)
    out = np.round(x, DIGITS)
    part = x * 10.0**DIGITS
    for k in np.flatnonzero(np.abs(part - np.floor(part) - 0.5) < 1e-3):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP))
    return out


def _within(mz: np.ndarray, at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(mz, at - reach, side="left"), np.searchsorted(mz, at + reach, side="right")


def _counts(mz: np.ndarray, rid: np.ndarray, q: np.ndarray, at: np.ndarray, widest: float, reach: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """For each ask (q, at) the records other than itself within the share widest of its mass, unrounded, and whose gap is at most reach; with before: below reach, or equal to it and of a smaller rid than before. NaN reaches count 0."""
    on = np.flatnonzero(~np.isnan(reach))
    out = np.zeros(len(at), np.int64)
    slack = EDGE + np.abs(at[on]) * 1e-12
    sure, most = reach[on] - slack, reach[on] + slack
    a, b = _within(mz, at[on], np.maximum(sure, 0))
    none = sure < 0
    b = np.where(none, a, b)
    lo, hi = _within(mz, at[on], most)
    a, b = np.where(none, lo, a), np.where(none, lo, b)
    own = np.zeros(len(on), np.int64)
    # The record itself lies in the middle of its window.
    i, j = np.searchsorted(mz, at[on], side="left"), np.searchsorted(mz, at[on], side="right")
    for k, (n, x, y) in enumerate(zip(on, i, j, strict=True)):
        if not none[k] and x < y:
            own[k] = int((rid[x:y] == q[n]).sum())
    out[on] = b - a - own
    for k, n in enumerate(on):
        edge = np.concatenate((np.arange(lo[k], a[k]), np.arange(b[k], hi[k])))
        if len(edge):
            gap = gaps(mz[edge], at[n])
            ok = gap <= reach[n] if before is None else (gap < reach[n]) | ((gap == reach[n]) & (rid[edge] < before[n]))
            out[n] += int((ok & (rid[edge] != q[n]) & (np.abs(mz[edge] - at[n]) <= at[n] * widest)).sum())
    return out


def counted(asks: DataFrame, library: DataFrame, ppm: float, shares: list[str], widths: list[int]) -> DataFrame:
    """q and, for each share and width (in this order), <share><width>_pool, the records of the share within the width, and <share><width>_before, those nearer than the ask's own one.

    asks: q, q_mz, and gaps and rids, arrays by share and width of the ask's own nearest record (NaN: none). library: rid, mz and a boolean column for each share. A record has one row.
    Counts of an ask come in a row for each chunk that it meets, and are to be added up.
    """
    spark = asks.sparkSession
    flags = sum((F.when(F.col(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(shares)), F.lit(0))
    mine, theirs, _ = ppm_sides(asks, "q_mz", library.select("rid", F.col("mz").alias("__mz"), flags.alias("flags")), "__mz", ppm)
    sizes = theirs.groupBy("__bin").agg(F.ceil(F.count("*") / CHUNK).alias("__chunks"), F.count("*").alias("__n"))
    total, large = sizes.agg(F.sum("__n"), F.collect_list(F.when(F.col("__chunks") > 1, F.struct("__bin", "__chunks")))).first()
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // ROWS), MOST_PARTS)
    large = F.broadcast(spark.createDataFrame([tuple(x) for x in large], "__bin long, __chunks long"))
    chunks = F.coalesce("__chunks", F.lit(1).cast("long"))
    theirs = theirs.join(large, "__bin", "left").select("__bin", F.pmod(F.xxhash64("rid"), chunks).alias("__slot"), "rid", F.col("__mz").alias("mz"), "flags")
    mine = mine.join(large, "__bin", "left").select("__bin", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("__slot"), "q", "q_mz", "gaps", "rids")
    sides = [side.repartition(n, "__bin", "__slot").groupBy("__bin", "__slot") for side in (theirs, mine)]
    settings = [(k, w) for k in range(len(shares)) for w in widths]
    names = [f"{shares[k]}{w}_{c}" for k, w in settings for c in ("pool", "before")]

    def run(_, held, asked):
        import pyarrow as pa

        if not held.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("q", *names)})
        rid, mz, flags = (held.column(c).to_numpy() for c in ("rid", "mz", "flags"))
        order = np.argsort(mz, kind="stable")
        chunk = [(mz[own], rid[own]) for own in (order[(flags[order] >> k) & 1 == 1] for k in range(len(shares)))]
        q, at = asked.column("q").to_numpy(), asked.column("q_mz").to_numpy()
        gap, own = (asked.column(c).combine_chunks().flatten().to_numpy().reshape(len(q), -1) for c in ("gaps", "rids"))
        columns = [q]
        for s, (k, w) in enumerate(settings):
            columns += [_counts(*chunk[k], q, at, ppm / 1e6, at * (w / 1e6)), _counts(*chunk[k], q, at, ppm / 1e6, gap[:, s], own[:, s])]
        return pa.table([pa.array(c) for c in columns], names=["q", *names])

    return sides[0].cogroup(sides[1]).applyInArrow(run, "q long, " + ", ".join(f"{c} long" for c in names))
