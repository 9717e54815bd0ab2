"""Series laid out by position, so that slices of a few positions read little more than themselves.

Rows are numbered along their series and stored in folders by part (a stretch of positions), sorted by
series and position inside. A slice names its parts, so other folders aren't listed; in a file, row groups and pages
whose statistics rule the slice out are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import placed

#: Positions of a part, and rows of a row group and of a page.
PER_PART, PER_GROUP, PER_PAGE = 50_000_000, 1_000_000, 20_000


def write(rows: DataFrame, path: str, series: str, order: list[str], name: str = "pos", per_part: int = PER_PART, per_group: int = PER_GROUP, per_page: int = PER_PAGE, files: int | None = None) -> None:
    """Stores rows with their place in the series (name: 0, 1, ...) by the order, whose first column is a number.

    A series of any length is numbered and stored by many tasks. Rows of a null series have no place and are left out; ties of the order are
    numbered in no given order. files: tasks that write (None: Spark's shuffle setting). A table that is already there is an error.
    """
    if taken := {name, "part"} & set(rows.columns):
        raise ValueError(f"the rows have columns of these names: {sorted(taken)}")
    laid = placed(rows.where(F.col(series).isNotNull()), [series], order, name).withColumn("part", F.floor(F.col(name) / per_part).cast("long"))
    keys = ["part", series, name]
    laid = laid.repartitionByRange(files, *keys) if files else laid.repartitionByRange(*keys)
    kept = {"parquet.block.row.count.limit": per_group, "parquet.page.row.count.limit": per_page}
    laid.sortWithinPartitions(*keys).write.options(**kept).partitionBy("part").parquet(path)


def one_slice(spark: SparkSession, path: str, start: int, length: int, name: str = "pos", per_part: int = PER_PART) -> DataFrame:
    """The rows at positions start to start + length - 1 of every series; those that are shorter give what they have. Further conditions, on the series say, are pushed down too."""
    at = F.col(name)
    stored = spark.read.parquet(path)
    return stored.where(F.col("part").between(start // per_part, (start + length - 1) // per_part) & (at >= start) & (at < start + length)).drop("part")


def slices(spark: SparkSession, path: str, wanted: DataFrame, series: str, end: str, length: int, name: str = "pos", per_part: int = PER_PART) -> DataFrame:
    """For each row of wanted (all its columns are kept) the `length` rows of its series before position `end`, one row each; clipped at the series' ends.

    Slices meet the stored rows by series and stretches of `length` positions: two for each slice, so overlapping slices of a long series don't meet all of it.
    wanted may not have columns of the stored table but the series; slices of a null series or end give nothing.
    """
    stored = spark.read.parquet(path)
    if taken := (set(wanted.columns) & set(stored.columns)) - {series}:
        raise ValueError(f"wanted has columns of the stored table: {sorted(taken)}")
    step = lambda p: F.floor(p / length).cast("long")
    last = F.col(end) - 1
    first = F.greatest(F.col(end) - length, F.lit(0))
    asked = wanted.where((F.col(end) > 0) & F.col(series).isNotNull()).withColumn("__step", F.explode(F.sequence(step(first), step(last))))
    asked = asked.withColumn("__part", F.explode(F.array_distinct(F.array(F.floor(F.greatest(first, F.col("__step") * length) / per_part), F.floor(F.least(last, F.col("__step") * length + length - 1) / per_part)))))
    held = stored.withColumn("__step", step(F.col(name))).withColumnRenamed("part", "__part")
    return held.join(asked, [series, "__step", "__part"]).where((F.col(name) < F.col(end)) & (F.col(name) >= F.col(end) - length)).drop("__step", "__part")
