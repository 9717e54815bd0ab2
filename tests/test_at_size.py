"""Steps that grow with the input, not with its pairs: what is shuffled, and equal results where groups are split."""

import re

import pytest

from corvane import plans
from corvane.operators import peaks as pk

from .conftest import SMALL


def shuffles(df):
    """The keys of each exchange of the plan."""
    return re.findall(r"Exchange hashpartitioning\(([^()]*)\)", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])


@pytest.mark.parametrize("name", ["sim01_cosine", "sim02_reverse_cosine", "sim04_entropy_similarity", "jon13_bin_match"])
def test_searches_shuffle_no_pairs(spark, name):
    found = [re.findall(r"(\w+)#", keys) for keys in shuffles(plans.QUERIES[name](spark, SMALL))]
    assert found and not any({"q", "rid"} <= set(keys) for keys in found)


@pytest.mark.parametrize("name", ["sim02_reverse_cosine", "jon13_bin_match"])
def test_windows_in_slots_give_the_same(spark, monkeypatch, name):
    rows = lambda: {(r["q"], r["rid"]): tuple(r)[2:] for r in plans.QUERIES[name](spark, SMALL).collect()}
    whole = rows()
    monkeypatch.setattr(pk, "PER_SLOT", 20)
    got = rows()
    assert got.keys() == whole.keys() and whole and all(got[k] == pytest.approx(whole[k]) for k in whole)


def test_shifted_search_compares_no_whole_records(spark, monkeypatch):
    got = plans.QUERIES["sim05_shifted"](spark, SMALL)
    assert got.count() > 0 and not any({"q", "rid"} <= set(re.findall(r"(\w+)#", keys)) for keys in shuffles(got))
    assert "_peaks" not in got._jdf.queryExecution().executedPlan().toString()


def test_dilution_shuffles_no_pairs(spark):
    """Pairs are counted by query before anything is shuffled, and no window sorts them."""
    plan = plans.QUERIES["evl06_dilution"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Union" not in plan


def test_shifted_window_shuffles_no_pairs(spark):
    assert not any({"q", "p_partkey"} <= set(re.findall(r"(\w+)#", keys)) for keys in shuffles(plans.QUERIES["jon02_shift_window"](spark, SMALL)))


def test_window_of_all_pairs_merges_fine_bins(spark):
    """No table is broadcast, so pairs come bin by bin, and most rows that meet are pairs; copies, edges and odd values give the pairs of coarse bins."""
    from corvane.operators.rangejoin import FINE, ppm_join, ppm_sides

    plan = plans.QUERIES["jon01_ppm_window"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    values = [100 * 1.0001**n for n in range(300)] + [100.0] * 40 + [100.05, 99.95, None, 0.0, -5.0, 1e-9, 1e12]
    rows = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    asks = rows.selectExpr("k as q", "v as q_v")
    got = lambda fine: sorted(tuple(r) for r in ppm_join(asks, "q_v", rows, "v", 500, fine).select("q", "k").collect())
    assert got(FINE) == got(None) == sorted((n, m) for n, a in enumerate(values) for m, b in enumerate(values) if a and b and a > 0 and b > 0 and abs(b - a) <= a * (500 / 1e6))
    q, lib, _ = ppm_sides(asks, "q_v", rows, "v", 500, FINE)
    assert q.join(lib, "__bin").count() < 1.3 * len(got(None))


def test_shifted_window_of_repeated_ids(spark):
    """Shifts that overlap and ids with several rows give a pair once."""
    from corvane.operators.rangejoin import shifted_join

    q = spark.createDataFrame([(1, 10.0), (1, 10.5), (2, 30.0), (3, None)], "q long, v double")
    lib = spark.createDataFrame([(7, 9.8), (7, 9.9), (8, 29.0)], "k long, m double")
    assert sorted(tuple(r) for r in shifted_join(q, "v", "q", lib, "m", "k", (0.0, 0.5, 1.0), 0.6).collect()) == [(1, 7), (2, 8)]
    single = q.where("v <> 10.5")
    assert sorted(tuple(r) for r in shifted_join(single, "v", "q", lib.where("m <> 9.9"), "m", "k", (0.0, 0.5, 1.0), 0.6).collect()) == [(1, 7), (2, 8)]


def test_negatives_from_part_of_the_window(spark, monkeypatch):
    """A bound under which almost no row lies gives the same negatives: those queries draw their whole window."""
    from corvane.plans import joins

    rows = lambda: sorted(tuple(r) for r in plans.QUERIES["jon21_window_negatives"](spark, SMALL).collect())
    whole = rows()
    monkeypatch.setattr(joins, "NEGATIVES_DRAWN", 1)
    assert rows() == whole != []


def test_flagship_keeps_the_best_before_it_shuffles(spark):
    """No exchange takes single records of a pair, and the best of lone query records are kept where they meet."""
    got = plans.QUERIES["flagship_library_search"](spark, SMALL)
    assert not any({"q", "rid"} <= set(re.findall(r"(\w+)#", keys)) for keys in shuffles(got))
    assert "WindowGroupLimit [q_key" in (plan := got._jdf.queryExecution().executedPlan().toString()) or re.search(r"WindowGroupLimit \[qkey#\w+, q#", plan)


def test_spectra_of_one_candidate_together():
    """Shares of many spectra at once are those of each alone."""
    import numpy as np

    from corvane.functions import adducts

    draw, names = np.random.default_rng(0), ["[M+H]+", "[M+Na]+"]
    formula, sizes = {"C": 6, "H": 12, "O": 2}, [3, 0, 5, 1]
    row = np.repeat(np.arange(4), sizes)
    mz, weight, at = draw.uniform(0, 120, 9), draw.uniform(0, 5, 9), np.array([117.09, 50.0, 139.07, 117.1])
    own = [(mz[row == k], weight[row == k]) for k in range(4)]
    want = [adducts.explained_by_formula(formula, m, w, at[k], names, 0.3) for k, (m, w) in enumerate(own)]
    assert adducts.all_explained_by_formula(formula, mz, weight, row, at, names, 0.3).tolist() == pytest.approx(want) and max(want) > 0
    ions = adducts.ions_of([15.0, 43.0, 80.0], "[M+Na]+")
    want = [adducts.explained_by_pieces([15.0, 43.0, 80.0], m, w, "[M+Na]+", 5.0) for m, w in own]
    assert adducts.all_explained_by_pieces(ions, mz, weight, row, 4, 5.0).tolist() == pytest.approx(want) and max(want) > 0


def test_pairs_of_a_key_in_lots_give_the_same(spark, monkeypatch):
    """Joins on a few keys deal a key's pairs to many tasks."""
    from corvane.operators import rangejoin

    monkeypatch.setattr(rangejoin, "PAIRS", 50)
    got = plans.QUERIES["flt13_same_attribute"](spark, SMALL)
    assert any("__lot" in keys for keys in shuffles(got))
    part, supplier = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("part", "supplier"))
    want = part.join(supplier, part["p_size"] == supplier["s_nationkey"]).select("p_partkey", "s_suppkey")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("name", ["sim06_tanimoto", "sim07_soft_tanimoto", "agg30_relatives"])
def test_labels_in_blocks_give_the_same(spark, monkeypatch, name):
    """A label's pairs are worked out by blocks, and no join puts a label into one task."""
    from corvane.operators import blocks

    rows = lambda: sorted(map(tuple, plans.QUERIES[name](spark, SMALL).collect()))
    whole = rows()
    monkeypatch.setattr(blocks, "BLOCK", 7)
    got = rows()
    assert whole and len(got) == len(whole) and all(a == pytest.approx(b) for a, b in zip(got, whole, strict=True))


def test_a_lambda_works_out_nothing_twice():
    from pyspark.sql import functions as F

    from corvane.operators.signal import mix_at_snr

    assert str(mix_at_snr(F.col("a"), F.col("b"), F.lit(6.0))).lower().count("pow") == 1


def test_formulas_are_spread_and_worked_out_once(spark):
    from corvane.plans.scalars import _once

    asked = []
    fn = _once(lambda text: asked.append(text) or len(text), most=2)
    assert [fn(x) for x in ("a", "bb", "a", "a")] == [1, 2, 1, 1] and asked == ["a", "bb"]
    assert "RoundRobinPartitioning" in plans.QUERIES["udf04_subformulas"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_odd_kinds():
    import pyarrow as pa

    from corvane.operators import blocks

    p = blocks.vectors(pa.array([[0.5, 0.5], None, [1.0], [None, 1.0], []], pa.list_(pa.float64())))
    assert blocks.soft_tanimotos(p, [p[0] * 2, p[2]]).tolist() == [[0.5, 0.0], [0.0, 0.0], [0.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


@pytest.mark.parametrize("name", ["agg01_two_level", "snk08_log_once", "evl08_feature_auc"])
def test_tasks_follow_the_number_of_rows(spark, monkeypatch, name):
    """A larger table is dealt to more tasks than the session's shuffles have."""
    from corvane.operators import rangejoin

    monkeypatch.setattr(rangejoin, "ROWS", 100)
    plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert max(int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan)) > 20


def test_auc_of_few_scores_deals_rows_and_keys_by_their_number(spark, monkeypatch):
    from corvane.operators import metrics, rangejoin

    rows = spark.range(3000).selectExpr("id % 70 as k", "if(id % 70 = 3, null, id % 4) as g", "if(id % 11 = 0, null, cast(id % 13 as double)) as s", "cast(id % 3 = 0 or id % 70 = 9 as int) as y")
    monkeypatch.setattr(rangejoin, "ROWS", 100)
    got = metrics.auc_of_few(rows, ["k", "g"], "s", "y", 3000)
    assert got.where("g is null").count() == 1
    assert sorted(map(tuple, got.where("g is not null").collect())) == sorted(map(tuple, metrics.auc(rows, ["k", "g"], "s", "y").collect()))
    assert got.rdd.getNumPartitions() == 30  # no later step deals the keys to fewer tasks
