"""Slices by position: what they hold and how much is read for them."""

import pytest

from corvane.sources import positioned

LAYOUT = {"per_part": 4000, "per_group": 500, "per_page": 100}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("series") / "laid")
    rows = spark.range(10_000).selectExpr("if(id < 9000, 'long', 'short') as s", "id as at", "double(id * id) as value").orderBy("value")
    positioned.write(rows, path, "s", ["at"], files=2, **LAYOUT)
    return path


def read_rows(df):
    """Rows that the scan handed on, counted before any filter."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_a_slice_reads_little_more_than_itself(spark, stored):
    got = positioned.one_slice(spark, stored, 6310, 20, per_part=4000)
    assert sorted((r["s"], r["pos"], r["value"]) for r in got.collect()) == [("long", p, float(p * p)) for p in range(6310, 6330)]
    assert 20 <= read_rows(got) <= 500
    assert read_rows(spark.read.parquet(stored).drop("part")) == 10_000


def test_a_slice_over_the_edge_of_parts_and_of_short_series(spark, stored):
    got = positioned.one_slice(spark, stored, 3990, 20, per_part=4000)
    assert sorted(r["pos"] for r in got.collect()) == list(range(3990, 4010))
    ends = positioned.one_slice(spark, stored, 990, 20, per_part=4000).where("s = 'short'")
    assert sorted((r["pos"], r["at"]) for r in ends.collect()) == [(p, p + 9000) for p in range(990, 1000)]
    assert positioned.one_slice(spark, stored, 50_000, 5, per_part=4000).count() == 0


def test_many_slices(spark, stored):
    wanted = [(0, "long", 30), (1, "long", 4010), (2, "long", 9020), (3, "short", 500), (4, "short", 3), (5, "none", 30), (6, None, 30), (7, "long", None), (8, "long", 0), (9, "long", 4010)]
    got = positioned.slices(spark, stored, spark.createDataFrame(wanted, "id int, s string, stop int"), "s", "stop", 30, per_part=4000).collect()
    sizes = {"long": 9000, "short": 1000}
    want = sorted((i, p, (p if s == "long" else p + 9000)) for i, s, e in wanted if s in sizes and e for p in range(max(0, e - 30), min(e, sizes[s])))
    assert sorted((r["id"], r["pos"], r["at"]) for r in got) == want


def test_hard_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, 2, 1.0), (None, 1, None), ("a", 5, 3.0), ("a", 5, 3.0)], "s string, at int, value double")
    positioned.write(rows, str(tmp_path / "t"), "s", ["at"], files=1)
    assert sorted((r["s"], r["pos"], r["value"]) for r in positioned.one_slice(spark, str(tmp_path / "t"), 0, 9).collect()) == [("a", 0, 3.0), ("a", 1, 3.0)]
    with pytest.raises(ValueError, match="pos"):
        positioned.write(rows.withColumnRenamed("value", "pos"), str(tmp_path / "u"), "s", ["at"])
    with pytest.raises(ValueError, match="value"):
        positioned.slices(spark, str(tmp_path / "t"), rows, "s", "at", 3)
    positioned.write(rows.where("false"), str(tmp_path / "v"), "s", ["at"], files=1)
