"""The shard data source: round trips, pruning, half-written shards, failed and repeated writes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.sources import shards
from corvane.sources.shards import Shards


@pytest.fixture
def rows(spark):
    spark.dataSource.register(Shards)
    df = spark.range(100).select((F.col("id") % 7).alias("key"), "id", (F.col("id") / 3).cast("float").alias("x"), F.array(F.col("id"), F.col("id") * 2).alias("pair"), F.concat(F.lit("é"), "id").alias("name"))
    return df.repartition(5)


def test_round_trip(spark, rows, tmp_path):
    folder = str(tmp_path / "t")
    shards.add_missing(rows, folder, "key")
    assert sorted(os.listdir(folder)) == [f"{k}.npz" for k in range(7)]
    back = spark.read.format("shards").load(folder)
    assert dict(back.dtypes) == dict(rows.dtypes) and back.rdd.getNumPartitions() == 7
    order = sorted(rows.columns)
    assert sorted(map(tuple, back.select(order).collect())) == sorted(map(tuple, rows.select(order).collect()))


def test_only_the_asked_columns_are_read(spark, rows, tmp_path):
    folder = str(tmp_path / "t")
    shards.add_missing(rows, folder, "key")
    for k in range(7):  # what isn't asked for may even be broken
        with np.load(f"{folder}/{k}.npz") as held:
            kept = {n: held[n] for n in held.files if n != "pair"}
        np.savez(f"{folder}/{k}.npz", pair=np.zeros(1), **kept)
    some = spark.read.format("shards").option("columns", "id, name").load(folder)
    assert some.columns == ["id", "name"] and some.agg(F.sum("id")).first()[0] == 4950
    with pytest.raises(Exception, match="nothing"):
        spark.read.format("shards").option("columns", "id,nothing").load(folder).count()


def test_half_written_shards_are_passed_over(spark, rows, tmp_path):
    folder = tmp_path / "t"
    shards.add_missing(rows, str(folder), "key")
    (folder / "_abc.part").write_bytes(b"half")
    (folder / ".9.npz").write_bytes(b"half")
    assert spark.read.format("shards").load(str(folder)).count() == 100


def test_a_rerun_adds_what_is_missing(spark, rows, tmp_path):
    folder = str(tmp_path / "t")
    shards.add_missing(rows.where("key < 3"), folder, "key")
    before = {n: os.stat(f"{folder}/{n}").st_mtime_ns for n in os.listdir(folder)}
    shards.add_missing(rows, folder, "key")
    shards.add_missing(rows, folder, "key")
    assert all(os.stat(f"{folder}/{n}").st_mtime_ns == t for n, t in before.items())
    assert len(os.listdir(folder)) == 7 and spark.read.format("shards").load(folder).count() == 100


def test_a_failed_write_leaves_nothing(spark, rows, tmp_path):
    folder = str(tmp_path / "t")
    shards.add_missing(rows.where("key = 0"), folder, "key")
    broken = rows.where("key > 0").withColumn("pair", F.when(F.col("id") == 50, F.array(F.lit(1).cast("long"))).otherwise(F.col("pair")))
    with pytest.raises(Exception, match="differ in shape|inhomogeneous"):
        shards.add_missing(broken, folder, "key")
    assert shards.complete(folder) == ["0"] and spark.read.format("shards").load(folder).count() == 15
    with pytest.raises(Exception, match="there already"):
        rows.where("key = 0").coalesce(1).write.format("shards").option("key", "key").mode("append").save(folder)
    with pytest.raises(Exception, match="two tasks"):
        rows.where("key = 1").repartition(4).write.format("shards").option("key", "key").mode("append").save(folder)
    assert os.listdir(folder) == ["0.npz"] or shards.complete(folder) == ["0"]


def test_overwriting_and_odd_keys(spark, rows, tmp_path):
    folder = str(tmp_path / "t")
    shards.add_missing(rows, folder, "key")
    other = spark.createDataFrame([("a/b c", 1.5), ("ü%", 2.5)], "key string, v double")
    other.repartition("key").write.format("shards").option("key", "key").mode("overwrite").save(folder)
    assert shards.complete(folder) == ["a/b c", "ü%"]
    assert sorted(map(tuple, spark.read.format("shards").load(folder).select("key", "v").collect())) == [("a/b c", 1.5), ("ü%", 2.5)]
    with pytest.raises(Exception, match="no shards"):
        spark.read.format("shards").load(str(tmp_path / "none")).count()
