"""Window features as a stream over files: each file is taken once, by the checkpoint, however often the job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_features(source: str, schema: str, sink: str, checkpoint: str, spark: SparkSession, size: int = 1000) -> int:
    """Tumbling features (series, win, rows, total, peak) of the new files under source, appended under sink; the rows taken.

    A batch's windows are partial sums: finished() puts those of several batches together.
    """
    taken = 0

    def each(batch: DataFrame, epoch: int) -> None:
        nonlocal taken
        out = batch.groupBy("series", F.floor(F.col("pos") / size).cast("long").alias("win")).agg(F.count("*").alias("rows"), F.sum("value").alias("total"), F.max(F.abs("value")).alias("peak"))
        # The epoch's own folder is replaced if a batch is run again, so nothing counts twice.
        out.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        taken += 1

    stream = spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    return taken


def finished(spark: SparkSession, sink: str) -> DataFrame:
    """(series, win, rows, mean, peak) over all batches."""
    parts = spark.read.parquet(sink)
    return parts.groupBy("series", "win").agg(F.sum("rows").alias("rows"), (F.sum("total") / F.sum("rows")).alias("mean"), F.max("peak").alias("peak"))
