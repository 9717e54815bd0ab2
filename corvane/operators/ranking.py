"""Ranks, gaps, rolling statistics and quantile maps, with explicit treatment of ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a value's range for each key: ranks inside a bucket, offsets between them.
BUCKETS = 512
#: Rows of a slot of an order, and the most slots.
PER_SLOT, MOST_SLOTS = 1_000_000, 4096
#: Places of a key's order that a task takes together where a row needs its neighbours.
STRETCH = 100_000


def tied_counts(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """by, value, n (rows of that value, or their summed weights, which are whole numbers), below (rows of smaller values) and total, a row for each distinct value.

    Values are counted first; then counts are cumulated inside buckets of the value's range and
    between buckets, so that a key with a third of all rows is spread over many tasks.
    """
    held = df.where(F.col(value).isNotNull())
    counts = held.groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    ends = counts.groupBy(*by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.sum("n").alias("total"))
    counts = _with(counts, ends, by)
    wide = F.col("__high") > F.col("__low")
    counts = counts.withColumn("__bucket", F.when(wide, F.floor((F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")) * BUCKETS)).otherwise(0).cast("long"))
    sums = counts.groupBy(*by, "__bucket").agg(F.sum("n").alias("__sum"))
    line = Window.partitionBy(*by).orderBy("__bucket") if by else Window.orderBy("__bucket")
    sums = sums.select(*by, "__bucket", F.coalesce(F.sum("__sum").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    counts = _with(counts, sums, [*by, "__bucket"])
    inside = Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", F.col("__before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).select(*by, value, "n", "below", "total")


def slotted(df: DataFrame, value: str, name: str = "__slot", per_slot: int | None = None) -> DataFrame:
    """df with the number of a slot of the value's order: slots hold about PER_SLOT rows each, whatever the distribution.

    Their bounds are approximate quantiles of the value, so results must not depend on them. Rows of one
    value share a slot. Tables of fewer rows have one slot, and no quantiles are taken.
    """
    n = df.count()
    slots = min(MOST_SLOTS, n // (per_slot or PER_SLOT))
    if slots < 2:
        return df.withColumn(name, F.lit(0.0))
    from pyspark.ml.feature import Bucketizer

    keyed = df.withColumn("__slot_by", F.col(value).cast("double"))
    bounds = sorted(set(keyed.approxQuantile("__slot_by", [k / slots for k in range(1, slots)], 1 / (4 * slots))))
    splits = [-float("inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol="__slot_by", outputCol=name, handleInvalid="keep").transform(keyed).drop("__slot_by")


def placed(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """name: 0, 1, ... within each key by the order, whose first column is a number.

    Rows are numbered inside slots of that column, and start after the rows of the key's slots before:
    a key of any share of the rows is numbered by many tasks.
    """
    cut = slotted(df, order[0])
    counts = cut.groupBy(*by, "__slot").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "__slot", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__slot").orderBy(*order))
    return _with(cut.withColumn(name, inside - 1), counts, [*by, "__slot"]).withColumn(name, F.col(name) + F.col("__before")).drop("__slot", "__before")


def in_stretches(df: DataFrame, by: list[str], order: list[str], reach: int, name: str = "pos", length: int | None = None) -> DataFrame:
    """df with the place of each row in its key (name: 0, 1, ...), a stretch of `length` places, and own.

    A stretch also has the `reach` rows before and after it, for which own is false: windows over
    (by, stretch) ordered by the place see at each own row as far as they would over the whole key,
    which many tasks share. length: STRETCH, or what is given; reach may not exceed it.
    """
    length = length or STRETCH
    at = placed(df, by, order, name)
    near = F.array_distinct(F.array(*[F.floor((F.col(name) + d) / length) for d in (-reach, 0, reach)]))
    spread = at.withColumn("stretch", F.explode(F.filter(near, lambda x: x >= 0)))
    return spread.withColumn("own", F.col("stretch") == F.floor(F.col(name) / length))


def rolled(df: DataFrame, by: list[str], order: list[str], value: str, k: int, columns: dict[str, str]) -> DataFrame:
    """df with centred statistics over k rows to each side, clipped at the ends: columns says name: max or mean. A key of any length is shared out in stretches."""
    rows = in_stretches(df, by, order, k, "__at")
    named = {name: rolling([*by, "stretch"], "__at", value, k, how) for name, how in columns.items()}
    return rows.withColumns(named).where("own").drop("__at", "stretch", "own")


def with_neighbours(df: DataFrame, by: list[str], order: list[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """df with columns of the rows before (-1) or after (1) in each key: name: (column, distance); and first, whether the row is its key's first."""
    rows = in_stretches(df, by, order, max(abs(d) for _, d in columns.values()), "__at")
    w = Window.partitionBy(*by, "stretch").orderBy("__at")
    named = {name: F.lag(c, -d).over(w) if d < 0 else F.lead(c, d).over(w) for name, (c, d) in columns.items()}
    return rows.withColumns(named | {"first": F.col("__at") == 0}).where("own").drop("__at", "stretch", "own")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """by and a column for each name of shares: the exact quantile, linearly interpolated; a row counts as often as its weight says.

    Distinct values are counted and cumulated in buckets; only those that hold one of the wanted
    ranks go on, two for each share and key.
    """
    counts = tied_counts(df.select(*by, F.col(value).cast("double").alias("__v"), *([weight] if weight else [])), by, "__v", weight)
    place = {k: F.lit(float(q)) * (F.col("total") - 1) for k, q in shares.items()}
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    some = reduce(lambda a, b: a | b, [holds(f(x)) for x in place.values() for f in (F.floor, F.ceil)])
    ends = [F.max(F.when(holds(f(x)), F.col("__v"))).alias(f"__{side}_{k}") for k, x in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    got = counts.where(some).groupBy(*by).agg(*ends, F.max("total").alias("total"))
    part = {k: x - F.floor(x) for k, x in place.items()}
    return got.select(*by, *[(F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * part[k]).alias(k) for k in shares])


def _with(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.crossJoin(F.broadcast(right))


def average_rank(df: DataFrame, by: list[str], value: str, name: str, scaled: bool = True) -> DataFrame:
    """df with the tie-averaged rank of value among its key's rows: 1 to n, or scaled to 0..1 by (rank - 1) / max(1, n - 1). Null values get null."""
    counts = tied_counts(df, by, value)
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    rank = (rank - 1) / F.greatest(F.lit(1), F.col("total") - 1) if scaled else rank
    return df.join(counts.select(*by, value, rank.alias(name)), [*by, value], "left")


def ordinal_rank(by: list[str], order: list[Column], scaled: bool = True) -> Column:
    """0 for the first to 1 for the last by the order (or 1 to n); the order must leave no ties."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(*order))
    return (place - 1) / F.greatest(F.lit(1), F.count("*").over(w) - 1) if scaled else place


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with 0, 1, 2, ... by an order without ties, without putting all rows into one task.

    Rows are sorted by range; a partition's rows are numbered in place, and start after the rows of
    the partitions before it. The window runs over one row for each partition.
    """
    kept = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).persist()
    parts = kept.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("__part", "__first", before.alias("__before")))
    return kept.join(parts, "__part").withColumn(name, F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__at", "__first", "__before")


def gap_to_best(by: list[str], value: str) -> Column:
    return F.col(value) - F.max(value).over(Window.partitionBy(*by))


def z_score(by: list[str], value: str, centred: bool = True) -> Column:
    """(value - mean) / sd with the population's sd; 0 where sd < 1e-9 or there is one row. Not centred: value / sd."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    top = F.col(value) - F.avg(value).over(w) if centred else F.col(value)
    return F.when((F.count(value).over(w) < 2) | (sd < 1e-9), 0.0).otherwise(top / sd)


def rolling(by: list[str], order: str, value: str, k: int, how: str = "max") -> Column:
    """Centred maximum or mean over k rows to each side, clipped at the ends; NaN is left out."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-k, k)
    clean = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return {"max": F.max, "mean": F.avg}[how](clean).over(w)


def changes(by: list[str], order: str, value: str) -> Column:
    """1 where the value differs from the row before (and in the first row), else 0."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)


def running_before(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """df with the sum of the key's rows before, 0 in the first. order is a number without ties. Sums of slots first, then rows inside their slot."""
    cut = slotted(df, order)
    sums = cut.groupBy(*by, "__slot").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, "__slot", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "__slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return _with(cut.withColumn(name, F.coalesce(inside, F.lit(0))), sums, [*by, "__slot"]).withColumn(name, F.col(name) + F.col("__before")).drop("__slot", "__before")


def quantile_map(scores: DataFrame, by: list[str], score: str, reference: DataFrame, value: str, name: str, tiebreak: str) -> DataFrame:
    """scores with reference values dealt out in score order; tied scores share the mean of theirs. Both sides have as many rows for each key."""
    left = placed(scores, by, [score, tiebreak], "__n")
    right = placed(reference.select(*by, F.col(value).alias("__value")), by, ["__value"], "__n")
    dealt = left.join(right, [*by, "__n"])
    means = dealt.groupBy(*by, score).agg(F.avg("__value").alias(name))
    return dealt.drop("__n", "__value").join(means, [*by, score])
