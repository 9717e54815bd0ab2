"""Writing results: validated submissions, resumable shards, content-addressed tables, an idempotent log."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def submission_faults(df: DataFrame, key: str, items: str, most: int = 25, glue: str = ";") -> DataFrame:
    """One row of counts: nulls, empty lists, repeated keys and lists that are too long."""
    n = F.size(F.split(items, glue))
    one = df.groupBy(key).agg(F.count("*").alias("__rows"), F.sum(F.col(items).isNull().cast("long")).alias("__nulls"), F.sum((F.col(items) == "").cast("long")).alias("__empty"), F.sum((n > most).cast("long")).alias("__long"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return one.agg(total(F.when(F.col(key).isNull(), F.col("__rows")).otherwise(F.col("__nulls"))).alias("nulls"), total("__empty").alias("empty"), total(F.when(F.col("__rows") > 1, 1).otherwise(0)).alias("repeated"), total("__long").alias("too_long"))


def validated(df: DataFrame, key: str, items: str, most: int = 25) -> DataFrame:
    """df, or a ValueError that names what is wrong with it."""
    if missing := {key, items} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    faults = submission_faults(df, key, items, most).first().asDict()
    if any(faults.values()):
        raise ValueError(f"the submission isn't valid: {faults}")
    return df


def wide_scores(df: DataFrame, row: str, column: str, value: str, classes: list[str]) -> DataFrame:
    """A row for each id, a column for each class; classes without a score get 0.5."""
    return df.groupBy(row).pivot(column, classes).agg(F.first(value)).fillna(0.5, classes)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end; Spark's committer marks that."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").select("path").limit(1).collect()
        return True
    except AnalysisException:
        return False


def add_shards(df: DataFrame, path: str, shard: str) -> DataFrame:
    """Writes the shards that aren't at path yet, each as a partition folder, and returns the table. A rerun adds only what is missing."""
    spark = df.sparkSession
    if exists(spark, path):  # anything else that is wrong with the table there is an error
        df = df.join(spark.read.parquet(path).select(shard).distinct(), shard, "left_anti")
    df.write.mode("append").partitionBy(shard).parquet(path)
    return spark.read.parquet(path)


def settings_key(version: int, **settings) -> str:
    """A name that changes with the version and the settings."""
    return hashlib.sha1(json.dumps([version, settings], sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(make, spark: SparkSession, folder: str, name: str, version: int, **settings) -> DataFrame:
    """The table of make() under a name of its settings, written once."""
    path = f"{folder}/{name}-{settings_key(version, **settings)}"
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_settings(df: DataFrame, **settings) -> DataFrame:
    """df that carries the settings it was built with: in its first column's metadata, so that Parquet keeps them in the files of the rows."""
    first = df.schema[0]
    return df.withMetadata(first.name, first.metadata | {"settings": json.dumps(settings, sort_keys=True, default=str)})


def at_settings(df: DataFrame, **settings) -> DataFrame:
    """df, or a ValueError that names the settings in which it was built otherwise (all, where it carries none)."""
    held = json.loads(df.schema[0].metadata.get("settings", "{}"))
    asked = json.loads(json.dumps(settings, sort_keys=True, default=str))
    absent = object()
    if differ := sorted(k for k in held.keys() | asked.keys() if held.get(k, absent) != asked.get(k, absent)):
        raise ValueError(f"built at other settings: {', '.join(f'{k} is {held.get(k)!r}, not {asked.get(k)!r}' for k in differ)}")
    return df


def log_once(runs: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """The log with the runs whose key it lacks, one row for each key."""
    return log.unionByName(runs.join(log.select(*key).distinct(), key, "left_anti").dropDuplicates(key))
