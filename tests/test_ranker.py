"""The learned ranker: gradients against all pairs, splits against plain sums, exports, and what it learns on held-out queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import models, ranker
from corvane.operators.ranker import Settings


def all_pairs(scores, labels, rows, weight, top):
    """Gradient and curvature of each row of one query, pair by pair."""
    order = sorted(range(len(scores)), key=lambda k: (-scores[k], rows[k]))
    place = {k: n for n, k in enumerate(order)}
    gain = lambda k: 1 / np.log2(place[k] + 2) if place[k] < top else 0.0
    ideal = sum(1 / np.log2(n + 2) for n in range(min(top, sum(labels))))
    g, h = np.zeros(len(scores)), np.zeros(len(scores))
    for i in range(len(scores)):
        for j in range(len(scores)):
            if labels[i] == 1 and labels[j] == 0 and min(place[i], place[j]) < top:
                change, miss = abs(gain(i) - gain(j)) / ideal, 1 / (1 + np.exp(scores[i] - scores[j]))
                g[i] -= weight * change * miss
                g[j] += weight * change * miss
                h[[i, j]] += weight * change * miss * (1 - miss)
    return g, h


@pytest.fixture(scope="module")
def table(spark):
    """60 queries of 5 to 40 rows and one of 1,500; a row is positive where two features are near 0, which no linear score sees."""
    rng, rows = np.random.default_rng(3), []
    for q in range(61):
        n = 1500 if q == 60 else int(rng.integers(5, 40))
        x = rng.normal(size=(n, 4)).round(2)
        hidden = -np.abs(x[:, 0]) - np.abs(x[:, 1]) + 0.1 * x[:, 2]
        best = set(np.argsort(-hidden)[: 3 if q == 60 else 1].tolist())
        for k in range(n):
            rows.append((f"q{q}", k, *map(float, x[k]), int(k in best), q % 3 + 1))
    return spark.createDataFrame(rows, "qid string, row long, a double, b double, c double, d double, y int, cls int").repartition(7).persist()


FEATURES = ["a", "b", "c", "d"]


@pytest.mark.parametrize("top", [3, 30])
def test_histograms_hold_all_pairs_gradients(spark, table, top):
    s = Settings(bins=8, top=top, seeds=(5, 6), queries=1.0, features=1.0, l2=0.0)
    edges = [sorted(set(q)) for q in table.approxQuantile(FEATURES, [k / 8 for k in range(1, 8)], 0.01)]
    rows = table.select(F.col("qid").alias("query"), "row", F.col("y").alias("label"), (F.col("cls") * 1.0).alias("weight"), F.array(*FEATURES).alias("x"))
    per_query = rows.groupBy("query").agg(F.sum("label").alias("p")).collect()
    ideal = spark.createDataFrame([(r.query, float(ranker.discounts(min(top, r.p)).sum())) for r in per_query], "query string, ideal double")
    base = ranker._binned(rows.join(ideal, "query"), edges, 2)
    tree = [{"feature": 0, "bin": 3, "left": 1, "right": 2}, {"value": 0.7}, {"value": -0.4}]
    scored = ranker._scored(base, [[tree], []], edges)
    ready = scored.join(ranker._best(scored, top, 2), "query")
    found = ranker._splits(ranker._statistics(ready, 4, s, 0), [[{}], [{}]], [{0}, {0}], [np.arange(4)] * 2, edges, s)
    pdf = scored.toPandas()
    for seed in (0, 1):
        total = np.zeros((4, 8, 2))
        for _, part in pdf.groupby("query"):
            part = part.reset_index(drop=True)
            g, h = all_pairs(part["scores"].str[seed].to_numpy(), part["label"].to_numpy(), part["row"].to_numpy(), part["weight"][0], top)
            bins = np.stack([np.frombuffer(bytes(b), np.uint8) for b in part["bins"]])
            for f in range(4):
                np.add.at(total[f], bins[:, f], np.stack([g, h], axis=1))
        for f in range(4):
            split = found[seed, 0, f]
            assert (split["g"], split["h"]) == pytest.approx(total[f].sum(axis=0).tolist(), abs=1e-9)
            left = np.cumsum(total[f], axis=0)[:-1]
            rest = total[f].sum(axis=0) - left
            gains = left[:, 0] ** 2 / left[:, 1] + rest[:, 0] ** 2 / rest[:, 1] - total[f][:, 0].sum() ** 2 / total[f][:, 1].sum()
            assert split["gain"] == pytest.approx(max(gains[: len(edges[f])].max(), 0), rel=1e-6, abs=1e-9)


def mean_reciprocal_rank(scored):
    places = scored.groupBy("qid").agg(F.max(F.when(F.col("y") == 1, F.col("score"))).alias("own"), F.collect_list("score").alias("all"))
    return places.select(F.avg(1 / (1 + F.size(F.filter("all", lambda x: x > F.col("own"))))).alias("m")).first()["m"]


def test_better_than_a_linear_ranker_on_held_out_queries(table):
    held = F.crc32(F.col("qid")) % 3 == 0
    train = ranker.class_weights(table.where(~held), "qid", "y", "cls", {1: 0.14, 2: 0.126, 3: 0.735})
    model = ranker.fit(train, "qid", "row", FEATURES, "y", "weight", Settings(trees=8, depth=4, bins=32, rate=0.5, least_rows=5, l2=1e-3, kept_after=5))
    got = mean_reciprocal_rank(table.where(held).withColumn("score", model.score()))
    w = models.pairwise_ranker(table.where(~held).withColumn("x", F.array(*FEATURES)), "qid", "x", "y", 4, rounds=5)
    linear = mean_reciprocal_rank(table.where(held).withColumn("score", models.dot(F.array(*FEATURES), w)))
    assert got > linear + 0.15 and got > 0.4
    assert len(model.trees) == 4 and all(len(t) == 8 for t in model.trees) and model.trees[0] != model.trees[1]
    rows = table.withColumn("score", model.score()).toPandas()
    x = rows[FEATURES].to_numpy()
    assert np.abs(ranker.flat_scores(model.flat(), x) - rows["score"]).max() < 1e-9


def test_a_rerun_agrees_and_weights_count(table):
    few = Settings(trees=2, depth=2, bins=8, seeds=(1,), least_rows=2)
    edges = ranker.quantile_edges(table, FEATURES, 8)
    once, again = (ranker.fit(table.repartition(n), "qid", "row", FEATURES, "y", None, few, edges) for n in (3, 5))
    shape = lambda m: [[(n.get("feature"), n.get("threshold")) for n in t] for t in m.trees[0]]
    assert shape(once) == shape(again)
    weights = {r.cls: r.weight for r in ranker.class_weights(table, "qid", "y", "cls", {1: 0.5, 2: 0.5}).select("cls", "weight").distinct().collect()}
    assert weights == {1: 0.5 / 21, 2: 0.5 / 20, 3: 0.0}


def test_odd_rows(spark):
    rows = [("a", 1, None, 1), ("a", 2, 1.0, 0), ("a", 3, 2.0, 0), (None, 1, 1.0, 1), ("b", 1, 1.0, 1), ("c", 1, float("nan"), None), ("d", 1, 5.0, 0)]
    df = spark.createDataFrame(rows, "qid string, row long, a double, y int")
    model = ranker.fit(df, "qid", "row", ["a"], "y", None, Settings(trees=1, seeds=(0,), least_rows=1, queries=1.0, features=1.0))
    scores = {r.row: r.s for r in df.where("qid = 'a'").select("row", model.score().alias("s")).collect()}
    assert scores[1] == scores[2] > scores[3]  # the smallest value shares NaN's way
    empty = ranker.fit(df.limit(0), "qid", "row", ["a"], "y", None, Settings(trees=1, seeds=(0,)))
    assert {r.s for r in df.select(empty.score().alias("s")).collect()} == {0.0}


def test_queries_in_blocks_give_the_rows_statistics(spark, table):
    s = Settings(bins=8, top=3, seeds=(5, 6), queries=0.7, features=1.0)
    edges = ranker.quantile_edges(table, FEATURES, 8)
    rows = table.where("qid <> 'q60'").select(F.col("qid").alias("query"), "row", F.col("y").alias("label"), (F.col("cls") * 1.0).alias("weight"), F.array(*FEATURES).alias("x"))
    sizes = rows.groupBy("query").agg(F.lit(1.0).alias("ideal")).withColumn("whole", F.lit(True))
    trees = [[[{"feature": 0, "bin": 3, "left": 1, "right": 2}, {"value": 0.7}, {"value": -0.4}]], []]
    scored = ranker._scored(ranker._binned(rows.join(sizes, "query"), edges, 2), trees, edges)
    want = ranker._splits(ranker._statistics(scored.join(ranker._best(scored, 3, 2), "query"), 4, s, 1), [[{}], [{}]], [{0}, {0}], [np.arange(4)] * 2, edges, s)
    blocks = ranker._blocks(rows, sizes, rows.count(), False, edges)
    for held, later in ((blocks, trees), (ranker._block_scored(blocks, trees, edges), [[], []])):
        got = ranker._splits(None, [[{}], [{}]], [{0}, {0}], [np.arange(4)] * 2, edges, s, ranker._block_statistics(held, later, edges, s, 1))
        assert got.keys() == want.keys() and len(got) == 8
        for k in want:
            assert [got[k][c] for c in ("bin", "gain", "g", "h")] == pytest.approx([want[k][c] for c in ("bin", "gain", "g", "h")], rel=1e-9, abs=1e-12)


def test_blocks_hold_whole_queries_and_no_rows_of_trees_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ranker, "BLOCK", 50)
    rows = spark.range(2000).selectExpr("id div 7 as query", "id as row", "cast(id % 7 = 0 as int) as label", "1.0D as weight", "array(cast(id % 13 as double)) as x")
    sizes = rows.groupBy("query").agg(F.lit(1.0).alias("ideal")).withColumn("whole", F.lit(True))
    blocks = ranker._blocks(rows, sizes, 2000, False, [[3.0, 6.0]])
    held = [(n.decode(), k) for r in blocks.collect() for n, k in zip(r["names"], np.frombuffer(r["sizes"], np.int32), strict=True)]
    assert len(held) == len(set(held)) == 286 and {k for _, k in held} == {7, 5} and blocks.count() > 20
    plan = ranker._block_statistics(blocks.persist(), [[]], [[3.0, 6.0]], Settings(seeds=(0,)), 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]


def test_scores_by_batch(table):
    model = ranker.fit(table, "qid", "row", FEATURES, "y", None, Settings(trees=2, depth=2, bins=8, seeds=(1, 2), least_rows=2))
    rows = table.unionByName(table.limit(3).withColumn("a", F.lit(None).cast("double"))).withColumn("want", model.score())
    got = model.scored(rows)
    assert got.columns == [*rows.columns, "score"] and got.where(F.abs(F.col("score") - F.col("want")) > 1e-9).isEmpty() and got.where("score is null").isEmpty()


def test_folds_side_by_side_are_the_rankers_of_the_other_folds(table):
    """Small queries lie in blocks, the one of 1,500 rows doesn't; each ranker is the one that its folds' rows alone give."""
    few = Settings(trees=3, depth=3, bins=8, seeds=(1, 2), least_rows=2, kept_after=2)
    edges = ranker.quantile_edges(table, FEATURES, 8)
    rows = table.withColumn("fold", F.crc32("qid") % 3)
    got = ranker.fit_without_each(rows, "qid", "row", FEATURES, "y", "fold", [0, 1, 2], None, few, edges)
    shape = lambda m: [[[(n.get("feature"), n.get("threshold")) for n in t] for t in own] for own in m.trees]
    leaves = lambda m: [n["value"] for own in m.trees for t in own for n in t if "value" in n]
    for k in (0, 1, 2):
        want = ranker.fit(rows.where(F.col("fold") != k), "qid", "row", FEATURES, "y", None, few, edges)
        assert shape(got[k]) == shape(want) and leaves(got[k]) == pytest.approx(leaves(want), rel=1e-9, abs=1e-12)
    assert shape(got[0]) != shape(got[1])


def test_cross_validation_grows_the_whole_ranker(spark, tables, monkeypatch):
    """evl08_cv leaves out nothing of the ranker's own settings, and has five folds."""
    from corvane import plans

    asked = []

    def fitted(df, query, row, features, label, weight, s, edges, fold=None):
        asked.append(s)
        return [[[{"value": 0.0}]] for _ in s.seeds]

    monkeypatch.setattr(ranker, "_fitted", fitted)
    assert plans.QUERIES["evl08_cv"](spark, tables.path).count() == 5
    (s,) = asked
    whole = Settings()
    assert all(getattr(s, k) == getattr(whole, k) for k in ("trees", "depth", "bins", "rate", "l2", "least_rows", "top", "queries", "features"))
    assert s.seeds == whole.seeds * 5 and s.without == tuple(k for k in range(5) for _ in whole.seeds)


def test_seeds_grown_in_a_task_each_are_those_of_the_rounds(table, monkeypatch):
    s = Settings(trees=5, depth=3, bins=8, seeds=(1, 2), least_rows=2, kept_after=2)
    rows = table.where("qid <> 'q60'").withColumn("fold", F.crc32("qid") % 2)
    edges = ranker.quantile_edges(rows, FEATURES, 8)
    fitted = lambda: ranker.fit_without_each(rows, "qid", "row", FEATURES, "y", "fold", [0, 1], None, s, edges)
    alone = fitted()
    monkeypatch.setattr(ranker, "SENT", 0)
    rounds = fitted()
    for k in (0, 1):
        for a, b in zip(alone[k].trees, rounds[k].trees, strict=True):
            assert [[(n.get("feature"), n.get("bin")) for n in t] for t in a] == [[(n.get("feature"), n.get("bin")) for n in t] for t in b]
            assert [n["value"] for t in a for n in t if "value" in n] == pytest.approx([n["value"] for t in b for n in t if "value" in n], rel=1e-9, abs=1e-12)
