"""Readers, sinks and the streaming job."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.sources import readers, sinks
from corvane.streaming import features


def test_csv_keeps_declared_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,x,y\n0012,1.5,\nab,2,7\n")
    got = readers.csv(spark, str(tmp_path / "a.csv"), "label string, x double, y int", ["label", "x"]).orderBy("x").collect()
    assert [tuple(r) for r in got] == [("0012", 1.5), ("ab", 2.0)]


def test_delimited_skips_malformed_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write("1\ta\nbroken\n2\tb\n3\tc\textra\n")
    assert sorted(tuple(r) for r in readers.delimited(spark, str(tmp_path / "a.tsv.gz"), ["id", "v"]).collect()) == [("1", "a"), ("2", "b")]


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", 'id,v\n1,"x, y"\n2,z\n')
    assert [tuple(r) for r in readers.zipped_csv(spark, str(tmp_path / "a.zip"), ["v", "id"]).orderBy("id").collect()] == [("x, y", "1"), ("z", "2")]


def test_listing_and_labels(spark, tmp_path):
    (tmp_path / "x.ogg").write_bytes(b"12345")
    (tmp_path / "labels.txt").write_text("header\nb\na\n")
    assert [tuple(r) for r in readers.listing(spark, str(tmp_path), "*.ogg").collect()] == [("x.ogg", "x", 5)]
    assert [tuple(r) for r in readers.numbered_lines(spark, str(tmp_path / "labels.txt"), 1).orderBy("id").collect()] == [(0, "b"), (1, "a")]


def test_logs(spark):
    df = spark.createDataFrame([('[{"data": "one\\ntw"}, {"data": "o\\n"}]',)], "log string")
    assert [r["line"] for r in readers.log_lines(df, "log").collect()] == ["one", "two"]
    lines = spark.createDataFrame([(0, "Warning: old"), (1, "id,score"), (2, "a,1"), (3, "KEY=va lue")], "n long, line string")
    assert [r["n"] for r in readers.after_header(lines, "line", "n", "id,score").collect()] == [2, 3]
    assert [tuple(r) for r in readers.key_values(lines.where("n = 3"), "line").collect()] == [("KEY", "va lue")]
    row = spark.createDataFrame([("['a', 'b']", "01:02:03")], "l string, t string").select(readers.list_literal(F.col("l")), readers.clock_seconds(F.col("t"))).first()
    assert tuple(row) == (["a", "b"], 3723)


def test_validator(spark):
    good = spark.createDataFrame([("a", "x;y"), ("b", "z")], "id string, items string")
    assert sinks.validated(good, "id", "items") is good
    for bad in ([("a", "x"), ("a", "y")], [("a", None)], [(None, "x")], [("a", "")], [("a", ";".join("x" * 26))]):
        with pytest.raises(ValueError):
            sinks.validated(spark.createDataFrame(bad, "id string, items string"), "id", "items")
    with pytest.raises(ValueError):
        sinks.validated(good, "id", "other")


def test_shards_and_cache(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") % 3).alias("shard"))
    path = str(tmp_path / "shards")
    assert sinks.add_shards(rows.where("shard < 2"), path, "shard").count() == 7
    assert sinks.add_shards(rows, path, "shard").count() == 10
    assert sinks.add_shards(rows, path, "shard").count() == 10
    made = []
    make = lambda: made.append(1) or rows
    for setting in (1, 1, 2):
        assert sinks.cached(make, spark, str(tmp_path), "t", 1, a=setting).count() == 10
    assert len(made) == 2
    log = rows.where("id < 4")
    assert sinks.log_once(rows, log, ["id"]).count() == 10


def test_stream_takes_each_file_once(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "series long, pos long, value double"
    part = lambda a, b: spark.range(a, b).select((F.col("id") % 2).alias("series"), F.col("id").alias("pos"), F.col("id").cast("double").alias("value"))
    part(0, 1500).write.parquet(source)
    assert features.window_features(source, schema, sink, mark, spark) == 1
    part(1500, 3000).write.mode("append").parquet(source)
    assert features.window_features(source, schema, sink, mark, spark) == 1
    assert features.window_features(source, schema, sink, mark, spark) == 0
    got = features.finished(spark, sink)
    want = part(0, 3000).groupBy("series", F.floor(F.col("pos") / 1000).alias("win")).agg(F.count("*").alias("rows"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_features_only_at_the_settings_of_their_table(spark, tmp_path):
    path = str(tmp_path / "features")
    sinks.with_settings(spark.range(3).toDF("id"), width=5, bands=[1, 2], note=None).write.parquet(path)
    got = spark.read.parquet(path)
    assert sinks.at_settings(got, width=5, bands=(1, 2), note=None).count() == 3
    for other, named in (({"width": 6, "bands": [1, 2], "note": None}, "width"), ({"width": 5, "note": None}, "bands"), ({"width": 5, "bands": [1, 2]}, "note")):
        with pytest.raises(ValueError, match=named):
            sinks.at_settings(got, **other)
    with pytest.raises(ValueError, match="width"):
        sinks.at_settings(spark.range(3), width=5)
