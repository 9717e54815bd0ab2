"""The Parquet tables and the views that stand for spectra, signals, scores and fingerprints on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


class Tables:
    """Tables of a folder as attributes: Tables(spark, path).orders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def spectra(t: Tables) -> DataFrame:
    """Records: rid, mz (their mass), positive, lib (where from), key (whose)."""
    return t.orders.select(F.col("o_orderkey").alias("rid"), F.col("o_totalprice").alias("mz"), (F.col("o_orderstatus") == "F").alias("positive"), F.col("o_orderpriority").alias("lib"), F.col("o_custkey").alias("key"))


def peaks(t: Tables) -> DataFrame:
    """Peaks: rid, bin, w. Peaks of a record that share a bin are not merged."""
    return t.lineitem.select(F.col("l_orderkey").alias("rid"), (F.col("l_partkey") % 200).alias("bin"), F.sqrt("l_quantity").alias("w"))


def signal(t: Tables) -> DataFrame:
    """Events as a signal: series, event_id, sec (seconds since 1970), value, reset."""
    return t.events.select(F.col("user_id").alias("series"), "event_id", F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)").alias("sec"), "value", (F.col("event_type") == "error").alias("reset"), "event_type")


def scores(t: Tables) -> DataFrame:
    """Scores by window: file, start (hour), class, score."""
    s = signal(t)
    return s.groupBy(F.col("series").alias("file"), F.floor(F.col("sec") / 3600).cast("long").alias("start"), F.col("event_type").alias("class")).agg(F.round(F.avg("value"), 9).alias("score"))


def fingerprints(t: Tables) -> DataFrame:
    """Structures: key, label, fp (array of one long: the signs of the embedding's first 60 values)."""
    from ..operators.bits import pack

    flags = F.transform(F.slice("embedding", 1, 60), lambda x: x > 0)
    return t.embeddings.select(F.col("vec_id").alias("key"), "label", F.array(pack(flags)).alias("fp"))
