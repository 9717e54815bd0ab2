"""Searches in arrays: chunks and batches of any size give the pairs of the SQL, odd ids, keys and masses included, and no pair is joined."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane import plans
from corvane.operators import searches

from .conftest import SMALL

NAMES = ["sim01_cosine", "sim02_reverse_cosine", "sim04_entropy_similarity", "sim05_shifted"]


def twin(name, folder):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'' if folder == SMALL else '/*.parquet'}'")
    cursor = con.execute(plans.SQL[name])
    columns = [c[0] for c in cursor.description]
    return {tuple(r[columns.index(k)] for k in ("q", "rid")): [r[columns.index(c)] for c in sorted(set(columns) - {"q", "rid"})] for r in cursor.fetchall()}


def mine(spark, name, folder):
    df = plans.QUERIES[name](spark, folder)
    rows = df.collect()
    got = {(r["q"], r["rid"]): [r[c] for c in sorted(set(df.columns) - {"q", "rid"})] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("name", NAMES)
def test_small_chunks_and_batches(spark, monkeypatch, name):
    for k, v in {"CHUNK": 5, "ASKS": 1, "CELLS": 3, "ROWS": 200}.items():
        monkeypatch.setattr(searches, k, v)
    got, want = mine(spark, name, SMALL), twin(name, SMALL)
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k], abs=1.1e-6) for k in want)


def odd_tables(spark, tmp_path):
    rows = [(k, None if k == 7 else k % 5, 100.0 * (1 + (k % 9) * 0.0005) if k != 11 else None) for k in range(-100, 200)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").withColumn("o_orderstatus", F.lit("F")).withColumn("o_orderpriority", F.lit("x"))
    lines = spark.range(-99, 200).select(F.col("id").alias("l_orderkey"), F.explode(F.sequence(F.lit(0), F.col("id").cast("int") % 4 + 4)).alias("n"))
    lines = lines.select("l_orderkey", ((F.col("l_orderkey") * 7 + F.col("n") * 3) % 40 + 40).alias("l_partkey"), (F.col("n") + 1.0).alias("l_quantity"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")


@pytest.mark.parametrize("name", NAMES)
def test_one_dense_window_and_odd_rows(spark, tmp_path, monkeypatch, name):
    """All records within a window or at its edge, null keys and masses, a record without peaks."""
    monkeypatch.setattr(searches, "CHUNK", 40)
    odd_tables(spark, tmp_path)
    got, want = mine(spark, name, str(tmp_path)), twin(name, str(tmp_path))
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1.1e-6) for k in want)


def test_ids_of_several_rows_are_added_up(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    orders.unionByName(orders.where("o_orderkey % 50 = 0")).write.parquet(f"{tmp_path}/orders.parquet")
    got, want = mine(spark, "sim01_cosine", str(tmp_path)), twin("sim01_cosine", str(tmp_path))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1.1e-6) for k in want)


@pytest.mark.parametrize("name", NAMES)
def test_no_pair_is_joined(spark, name):
    """Peaks meet in arrays: no join has a bin among its keys, and no record is copied for the queries of its window."""
    plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if " Join " in f" {x} "]
    assert joins and "MapInArrow" in plan and not any("(bin#" in x for x in joins)


@pytest.mark.parametrize("customers", [2, 45])
def test_sums_over_several_queries_of_a_customer(spark, tmp_path, monkeypatch, customers):
    """Customers with several query records, far and near each other, against customers that meet one or several of them; more than 25 of each, and ties."""
    monkeypatch.setattr(searches, "CHUNK", 30)
    monkeypatch.setattr(searches, "WORDS", 1)
    rows = [(50 * k, k % customers, 1000.0 * 1.0021 ** (k * 7 % 40)) for k in range(60)]
    rows += [(k, k % 97 + 1000, 1000.0 * 1.00047 ** (k * 31 % 200)) for k in range(1, 3000) if k % 50]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").withColumn("o_orderstatus", F.lit("F")).withColumn("o_orderpriority", F.lit("x"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(3000).select(F.col("id").alias("l_orderkey"), F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("n"))
    lines.selectExpr("l_orderkey", "(l_orderkey * 7 + n * 3) % 40 as l_partkey", "double(1 + (l_orderkey + n) % 5) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {(r[0], r[3]): (r[1], r[2]) for r in con.execute(f"select qkey, key, score, n from ({plans.SQL['flagship_library_search']})").fetchall()}
    df = plans.QUERIES["flagship_library_search"](spark, str(tmp_path))
    got = {(r["qkey"], r["n"]): (r["key"], r["score"]) for r in df.collect()}
    assert got.keys() == want.keys() and len(want) >= 50
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1.1e-6) for k in want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("(bin#" in x for x in plan.splitlines() if " Join " in f" {x} ")
