"""Every query of the library against its SQL on the smallest tables, and the shapes of plans."""

import math
from pathlib import Path

import duckdb
import pytest

from corvane import plans

from .conftest import SMALL

#: Queries without a twin: seeded or iterative work, checked elsewhere.
ROWS_ONLY = {"agg21_bootstrap", "evl07_out_of_fold", "evl08_cv", "mlo01_one_vs_rest", "mlo04_boosted_trees", "mlo05_kernel_ridge", "mlo05_nu_svr", "mlo07_lambdarank", "mlo07_pairwise_ranker", "mlo09_ranking_network", "mlo11_pseudo_labels", "mlo12_head_variants", "mlo14_mlp_probe", "mlo15_grouped_cv", "scf42_spectrum", "top09_backward_elimination", "udf04_subformulas", "udf05_evidence_with_adducts", "udf05_explained_by_formula", "udf06_fragments", "udf06_structure_fragments", "udf12_log_mel", "win19_hashed_crop"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


def key(row):
    return tuple((v is None, str(type(v)), v) for v in row)


def test_every_query_has_a_twin_or_a_reason():
    assert set(plans.QUERIES) - set(plans.SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equal_to_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL)
    cursor = duck.execute(plans.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = [tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in cursor.fetchall()]
    mine = [tuple(plain(r[c]) for c in order) for r in got.collect()]
    assert len(mine) == len(want)
    for a, b in zip(sorted(mine, key=key), sorted(want, key=key), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1.1e-4 * max(1, abs(y))), (a, b)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["jon01_ppm_window", "jon02_shift_window", "jon03_wide_window", "jon04_point_in_interval", "jon14_nearest", "sim01_cosine", "flagship_library_search"])
def test_no_nested_loops(spark, name):
    plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    # One-row sides may be broadcast; range conditions never run over all pairs.
    assert all("abs(" not in line for line in plan.splitlines() if "BroadcastNestedLoopJoin" in line)


def test_pruned_scan(spark):
    plan = plans.QUERIES["src01_pruned_scan"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "PushedFilters: [IsNotNull(l_shipdate)" in plan


def test_formula_kernels_take_all_parts(spark, tables):
    """Each part has its row, and each part's chain its fragments."""
    parts = {r["p_partkey"] for r in tables.part.collect()}
    n = {r["p_partkey"]: r["n"] for r in plans.QUERIES["udf04_subformulas"](spark, SMALL).collect()}
    share = {r["p_partkey"]: r["share"] for r in plans.QUERIES["udf05_explained_by_formula"](spark, SMALL).collect()}
    assert set(n) == set(share) == parts
    for k in parts:
        assert 0 < n[k] <= (k % 7 + 2) * (k % 9 + 3) * (k % 3 + 2) - 1 and 0 <= share[k] <= 1
    whole = {}
    for r in plans.QUERIES["udf06_fragments"](spark, SMALL).collect():
        whole[r["p_partkey"]] = max(whole.get(r["p_partkey"], 0), r["mass"])
    assert whole == {k: sum(12.0 + (i + k) % 3 for i in range(k % 5 + 3)) for k in parts}


def test_windows_of_a_long_series(spark, tmp_path):
    """Windows go on to the end of a series, however long it is."""
    n = 1500
    rows = spark.range(n).selectExpr("id as event_id", "1L as user_id", "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "double(id) as value", "'view' as event_type")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["win"]: (r["rows"], r["mean"]) for r in plans.QUERIES["win13_sliding_windows"](spark, str(tmp_path)).collect()}
    want = {k: range(5 * k, min(5 * k + 20, n)) for k in range(n // 5)}
    assert got == {k: (len(w), sum(w) / len(w)) for k, w in want.items()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qkey", "key", "score", "n"]
    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
