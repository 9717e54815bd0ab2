"""Dilution counted on sorted masses: chunks of any size, ties, edges and odd rows give the SQL's figures, and no pair is made."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import plans
from corvane.operators import dilution

from .conftest import SMALL


@pytest.mark.parametrize("several", [False, True])
def test_ties_edges_and_odd_rows(spark, tmp_path, monkeypatch, several):
    """Many records of one mass, at the windows' edges and nearly there, without customer or mass; and ids of several rows, which go by pairs."""
    monkeypatch.setattr(dilution, "CHUNK", 60)
    rng = np.random.default_rng(5)
    steps = [0.0, 0.0005, 0.002, 0.0005 + 3e-10, 0.002 - 4e-10, 0.002 + 2e-9, 0.00123456]
    rows = [(k, None if k == 9 else int(rng.integers(0, 12)), None if k == 13 else 1000.0 * (1 + float(rng.choice([-1, 1])) * steps[int(rng.integers(0, 7))])) for k in range(600)]
    rows += [rows[100], rows[101]] if several else []
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").withColumn("o_orderstatus", F.lit("F")).withColumn("o_orderpriority", F.lit("x"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = {(r[0], r[1]): r[2:] for r in con.execute(f"select share, ppm, queries, pool, mrr from ({plans.SQL['evl06_dilution']})").fetchall()}
    got = {(r["share"], r["ppm"]): (r["queries"], r["pool"], r["mrr"]) for r in plans.QUERIES["evl06_dilution"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(want) == 6
    if not several:  # equal rows of one id are ties that the SQL leaves open
        assert all(got[k] == pytest.approx(want[k], abs=1.1e-6) for k in want)


def test_no_pairs_are_made(spark):
    """The window's records and the queries are put in one order; only a query's own customer's records are joined to it."""
    plan = plans.QUERIES["evl06_dilution"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if " Join " in f" {x} " and "__bin#" in x]
    assert "CoGroupsInArrow" in plan and all("LeftOuter" in x for x in joins)
