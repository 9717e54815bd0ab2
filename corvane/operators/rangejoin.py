"""Joins on closeness: absolute and proportional windows, shifted windows, intervals, nearest values.

All are equi joins on bins with a residual condition, so that they shuffle or broadcast like any
other join and never become a nested loop.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import MOST_SLOTS, slotted

#: Rows of a slot of an order that rows and points share.
PER_SLOT = 100_000
#: Pairs that a task makes at most of a key's rows, and the most tasks of a key.
PAIRS, MOST_PARTS = 20_000_000, 20_000
#: Bins of a window whose pairs are all returned.
FINE = 16


def _bins(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low.cast("long"), high.cast("long")))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly: a table of few files may have many pairs to make."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_out(asks: DataFrame, rows: DataFrame, on: str, by: str, pairs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on `on`, for a join on [on, "__lot"]: a key of many pairs deals its rows to lots of about `pairs` pairs by the hash of the column `by`, and each lot has the key's asks.

    Rows of a key are counted first, so a key with any share of the pairs is shared out, and no task grows with the tables.
    """
    sizes = asks.groupBy(on).agg(F.count("*").alias("__a")).join(rows.groupBy(on).agg(F.count("*").alias("__b")), on)
    lots = F.least(F.ceil(F.col("__a") * F.col("__b") / (pairs or PAIRS)), F.col("__b"), F.lit(MOST_PARTS)).cast("long")
    sizes = sizes.select(on, lots.alias("__lots")).persist()
    total = sizes.agg(F.sum("__lots")).first()[0] or 0
    n = min(max(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), total), MOST_PARTS)
    rows = rows.join(sizes, on).withColumn("__lot", F.pmod(F.xxhash64(by), "__lots")).drop("__lots")
    asks = asks.join(sizes, on).withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__lots") - 1))).drop("__lots")
    return asks.repartition(n, on, "__lot"), rows.repartition(n, on, "__lot")


#: Rows of a task that sorts or groups them.
ROWS = 500_000


def by_size(df: DataFrame, rows: int, *keys) -> DataFrame:
    """df dealt by the keys to as many tasks as its number of rows asks for, so that what a task holds doesn't grow with the table."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-rows // ROWS), MOST_PARTS))
    return df.repartition(n, *keys)


def absolute_join(queries: DataFrame, q_value: str, library: DataFrame, l_value: str, tolerance: float) -> DataFrame:
    """Pairs with abs(l_value - q_value) <= tolerance. A query meets two or three bins of width 2 * tolerance; a library row lies in one."""
    width = 2 * tolerance
    q = queries.withColumn("__bin", _bins(F.floor((F.col(q_value) - tolerance) / width), F.floor((F.col(q_value) + tolerance) / width)))
    lib = library.withColumn("__bin", F.floor(F.col(l_value) / width).cast("long"))
    return q.join(lib, "__bin").where(F.abs(F.col(l_value) - F.col(q_value)) <= tolerance).drop("__bin")


def ppm_sides(queries: DataFrame, q_value: str, library: DataFrame, l_value: str, ppm: float, fine: int = 1) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with a bin (__bin) on which rows within q_value * ppm / 1e6 meet, values positive, and the condition that says which of those are.

    Bins are logarithmic, so a query meets fine + 2 at most, at any size. Other columns may join the bin as keys.
    """
    step = 2 * ppm / 1e6
    scale = log1p(step) / fine
    place = lambda c: F.floor(F.ln(c) / scale)
    slack = 1e-9  # a value on a bin's edge may be computed on either side of it
    q = queries.where(F.col(q_value) > 0).withColumn("__bin", _bins(place(F.col(q_value) * (1 - ppm / 1e6 - slack)), place(F.col(q_value) * (1 + ppm / 1e6 + slack))))
    lib = library.where(F.col(l_value) > 0).withColumn("__bin", place(F.col(l_value)).cast("long"))
    return q, lib, F.abs(F.col(l_value) - F.col(q_value)) <= F.col(q_value) * (ppm / 1e6)


def ppm_join(queries: DataFrame, q_value: str, library: DataFrame, l_value: str, ppm: float, fine: int | None = None) -> DataFrame:
    """Pairs with abs(l_value - q_value) <= q_value * ppm / 1e6, values positive.

    fine (FINE, say) is for results of all pairs: so many bins to a window leave few rows that meet without being a pair. They are
    merged, never broadcast: queries of a bin then follow one another and meet the same rows in one order, and what is written of the pairs packs well.
    """
    q, lib, near = ppm_sides(queries, q_value, library, l_value, ppm, fine or 1)
    return q.join(lib.hint("merge") if fine else lib, "__bin").where(near).drop("__bin")


def shifted_join(queries: DataFrame, q_value: str, q_id: str, library: DataFrame, l_value: str, l_id: str, shifts: Iterable[float], tolerance: float) -> DataFrame:
    """Distinct (q_id, l_id) with abs(l_value - (q_value - shift)) <= tolerance for any of the shifts.

    A pair comes from the first shift that it fits, so no pairs are shuffled; only where an id has several rows they are made distinct.
    """
    moves = [F.col(q_value) - float(s) for s in shifts]
    once = all(rows.groupBy(k).count().where("count > 1").isEmpty() for rows, k in ((queries, q_id), (library, l_id)))
    moved = spread(queries.select(q_id, q_value)).select(q_id, *[m.alias(f"__moved{i}") for i, m in enumerate(moves)], F.posexplode(F.array(*moves)).alias("__shift", "__moved"))
    pairs = absolute_join(moved, "__moved", library.select(l_id, l_value), l_value, tolerance)
    for i in range(len(moves) - 1):
        pairs = pairs.where((F.col("__shift") <= i) | (F.abs(F.col(l_value) - F.col(f"__moved{i}")) > tolerance))
    pairs = pairs.select(q_id, l_id)
    return pairs if once else pairs.distinct()


def interval_join(rows: DataFrame, value: str, intervals: DataFrame, low: str, high: str, per_slot: int = PER_SLOT) -> DataFrame:
    """Each row with the interval that holds its value (low <= value < high); intervals don't overlap.

    An as-of join without pairs: both sides are put in one order and each row takes the last
    interval that began. Rows before the first or after the last interval are left out.
    Ordering goes by slots of the order, and a slot starts with the interval open at its start.
    """
    return _as_of(rows, value, intervals, low, per_slot).where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high)))


def _as_of(rows: DataFrame, value: str, points: DataFrame, at: str, per_slot: int = PER_SLOT) -> DataFrame:
    """Each row with the point of the largest `at` <= value (none, or no value: nulls). Slots of the order hold like numbers of rows and points."""
    names = points.columns
    packed = points.where(F.col(at).isNotNull()).select(F.col(at).alias("__at"), F.struct(*names).alias("__point"))
    mine = rows.select(F.col(value).alias("__at"), F.struct(*rows.columns).alias("__row"))
    both = packed.withColumn("__row", F.lit(None).cast(mine.schema["__row"].dataType)).unionByName(mine.withColumn("__point", F.lit(None).cast(packed.schema["__point"].dataType)))
    cut = slotted(both, "__at", per_slot=per_slot)
    # The last point of each slot opens the following ones: one row for each slot.
    ends = cut.where("__point is not null").groupBy("__slot").agg(F.max_by("__point", "__at").alias("__point"))
    ends = rows.sparkSession.range(MOST_SLOTS + 1).select(F.col("id").cast("double").alias("__slot")).join(F.broadcast(ends), "__slot", "left")
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    opens = ends.select("__slot", F.last("__point", ignorenulls=True).over(before).alias("__open"))
    line = Window.partitionBy("__slot").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = cut.withColumn("__last", F.last("__point", ignorenulls=True).over(line)).where(F.col("__row").isNotNull())
    found = seen.join(F.broadcast(opens), "__slot", "left").withColumn("__hit", F.when(F.col("__at").isNotNull(), F.coalesce("__last", "__open")))
    return found.select("__row.*", *[F.col("__hit")[c].alias(c) for c in names])


def window_counts(rows: DataFrame, value: str, library: DataFrame, at: str, tolerance: float, per_slot: int = PER_SLOT) -> DataFrame:
    """rows with n, the number of library rows with abs(at - value) <= tolerance, and most, the largest such `at` (none: 0 and null).

    No pairs are made, so a window may hold any share of the library: distinct values of `at` are
    counted and cumulated, and each distinct value looks up where its window ends. Values that differ
    from each other by rounding alone (4e-15 of their size) may fall on either side of a window's edge.
    """
    v, lib = F.col("__value"), F.col("__lib")
    slack = (F.abs(v) + tolerance) * 4e-15
    looks = {"over": v + tolerance + slack, "sure": v + tolerance - slack, "low": v - tolerance + slack}
    held = library.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("double").alias("__at")).agg(F.count("*").alias("__n"))
    asks = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("__value")).distinct()
    asks = asks.select("__value", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("at")) for k, x in looks.items()])).alias("l")).select("__value", F.col("l.kind").alias("__kind"), F.col("l.at").alias("__at"))
    cut = slotted(held.unionByName(asks, allowMissingColumns=True), "__at", per_slot=per_slot)
    ends = cut.where("__kind is null").groupBy("__slot").agg(F.sum("__n").alias("__sum"), F.max("__at").alias("__end"), F.max_by("__n", "__at").alias("__of_end"))
    ends = rows.sparkSession.range(MOST_SLOTS + 1).select(F.col("id").cast("double").alias("__slot")).join(F.broadcast(ends), "__slot", "left")
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    opens = ends.select("__slot", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.last("__end", ignorenulls=True).over(before).alias("__open"), F.last("__of_end", ignorenulls=True).over(before).alias("__of_open"))
    line = Window.partitionBy("__slot").orderBy("__at", F.col("__kind").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda x: F.last(F.when(F.col("__kind").isNull(), F.col(x)), ignorenulls=True).over(line)
    seen = cut.withColumns({"__sum": F.coalesce(F.sum("__n").over(line), F.lit(0)), "__last": last("__at"), "__of_last": last("__n")}).where("__kind is not null")
    seen = seen.join(F.broadcast(opens), "__slot").withColumns({"__lib": F.coalesce("__last", "__open"), "__upto": F.col("__before") + F.col("__sum")})
    seen = seen.withColumn("__below", F.col("__upto") - F.coalesce("__of_last", "__of_open", F.lit(0)))
    of = lambda kind, x: F.max(F.when(F.col("__kind") == kind, x))
    ends = seen.groupBy("__value").agg(
        (of("over", F.when(lib - v > tolerance, F.col("__below")).otherwise(F.col("__upto"))) - of("low", F.when(v - lib <= tolerance, F.col("__below")).otherwise(F.col("__upto")))).alias("n"),
        F.coalesce(of("over", F.when(lib - v <= tolerance, lib)), of("sure", lib)).alias("most"),
    )
    ends = ends.select(F.col("__value").alias(value), "n", F.when(F.col("n") > 0, F.col("most")).alias("most"))
    return rows.join(ends, value, "left").withColumn("n", F.coalesce("n", F.lit(0))).select(*rows.columns, "n", "most")


def nearest_join(rows: DataFrame, value: str, points: DataFrame, at: str, tolerance: float) -> DataFrame:
    """Each row with the nearest point's `at` within the tolerance (the smaller on ties), else null. Rows need no key."""
    keyed = rows.withColumn("__row", F.struct(*rows.columns))
    pairs = absolute_join(keyed, value, points.select(F.col(at).alias("__at")).distinct(), "__at", tolerance)
    best = pairs.groupBy("__row").agg(F.min(F.struct(F.abs(F.col("__at") - F.col(value)).alias("gap"), F.col("__at").alias("at"))).alias("__best"))
    return keyed.join(best, "__row", "left").select(*rows.columns, F.col("__best.at").alias(at))


def has_near(rows: DataFrame, value: str, points: DataFrame, at: str, tolerance: float) -> DataFrame:
    """The distinct rows that have a point within the tolerance."""
    keyed = rows.withColumn("__row", F.struct(*rows.columns))
    pairs = absolute_join(keyed, value, points.select(F.col(at).alias("__at")).distinct(), "__at", tolerance)
    return pairs.select("__row").distinct().select("__row.*")
