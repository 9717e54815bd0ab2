"""The network that ranks candidates: gradients, resumed runs, batched guesses, hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import network
from corvane.operators.network import Network, Settings

SMALL = Settings(hidden=(8,), epochs=3, batches=3, rate=0.02, rank=0.5, tau=0.2, keep_every=2)


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    w = draw.normal(size=(5, 6))
    x = draw.normal(size=(120, 5))
    y = (x @ w > 0).astype(int)
    df = spark.createDataFrame([(n, n % 4, a.tolist(), b.tolist()) for n, (a, b) in enumerate(zip(x, y, strict=True))], "k long, g long, x array<double>, y array<int>")
    return network.with_pools(df, "k", "g", "y", most=4).select("k", "g", "x", "y", "pool").cache()


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(1)
    net = Network.fresh([4, 5, 3, 6], 2)
    x, y = draw.normal(size=(7, 4)), (draw.random((7, 6)) > 0.5).astype(float)
    pools = [(draw.random((n % 4, 6)) > 0.5).astype(float) for n in range(7)]
    _, grad = network.gradients(net, x, y, pools, 0.7, 0.3)
    flat, eps = net.flat(), 1e-6
    for at in draw.choice(len(flat), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[at] += eps
        down[at] -= eps
        slope = (network.gradients(net.filled(up), x, y, pools, 0.7, 0.3)[0] - network.gradients(net.filled(down), x, y, pools, 0.7, 0.3)[0]) / (2 * eps)
        assert slope == pytest.approx(grad[at], rel=1e-4, abs=1e-6)


def test_pools_hold_others_of_the_group(rows):
    held = {r["k"]: r for r in rows.collect()}
    assert set(held) == set(range(120))
    for r in held.values():
        same = [tuple(o["y"]) for o in held.values() if o["g"] == r["g"] and o["k"] != r["k"]]
        assert len(r["pool"]) <= 4 and all(tuple(b) in same for b in r["pool"])
    assert sum(map(len, (r["pool"] for r in held.values()))) > 200
    loose = network.with_pools(rows.select("k", F.when(F.col("g") > 0, F.col("g")).alias("g"), "y"), "k", "g", "y", most=4).where("g is null").collect()
    assert len(loose) == 30 and all(r["pool"] == [] for r in loose)


def test_a_stopped_run_goes_on_to_the_same_weights(spark, rows, tmp_path):
    whole = network.fit(rows, "k", "x", "y", str(tmp_path / "a"), "pool", SMALL)
    seen = []

    def stop(step, loss):
        seen.append(step)
        if step == 5:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        network.fit(rows, "k", "x", "y", str(tmp_path / "b"), "pool", SMALL, watch=stop)
    again = []
    resumed = network.fit(rows, "k", "x", "y", str(tmp_path / "b"), "pool", SMALL, watch=lambda step, loss: again.append(step))
    assert seen == [1, 2, 3, 4, 5] and again == [5, 6, 7, 8, 9]
    assert np.allclose(whole.flat(), resumed.flat(), rtol=0, atol=1e-12)
    assert len(whole.losses) == 9 and np.mean(whole.losses[-3:]) < np.mean(whole.losses[:3])
    calm = []
    assert np.array_equal(network.fit(rows, "k", "x", "y", str(tmp_path / "b"), "pool", SMALL, watch=lambda *a: calm.append(a)).flat(), resumed.flat()) and not calm


def test_steps_are_those_of_one_machine(spark, rows, tmp_path):
    """One batch, one step: the weights that AdamW gives by hand from all rows' gradient."""
    s = Settings(hidden=(3,), epochs=1, batches=1, rate=0.1, decay=0.01, rank=1.0, tau=0.2)
    got = network.fit(rows, "k", "x", "y", str(tmp_path), "pool", s).flat()
    held = rows.collect()
    net = Network.fresh([5, 3, 6], 0)
    _, grad = network.gradients(net, np.array([r["x"] for r in held]), np.array([r["y"] for r in held], float), [np.array(r["pool"], float).reshape(-1, 6) for r in held], 1.0, 0.2)
    grad /= len(held)
    assert np.allclose(got, net.flat() * (1 - 0.1 * 0.01) - 0.1 * grad / (np.abs(grad) + 1e-8), atol=1e-9)


def test_guesses_by_batch_and_hard_rows(spark, rows, tmp_path):
    odd = spark.createDataFrame([(900, None, [1] * 6, None), (901, [1.0] * 4, [1] * 6, None), (902, [None] + [1.0] * 4, [1] * 6, None), (903, [1.0] * 5, None, None), (None, [1.0] * 5, [1] * 6, [])], "k long, x array<double>, y array<int>, pool array<array<int>>")
    both = rows.select("k", "x", "y", "pool").unionByName(odd)
    net = network.fit(both, "k", "x", "y", str(tmp_path), "pool", Settings(hidden=(), epochs=6, batches=2, rate=0.3, rank=0.0, cosine=False))
    got = {r["k"]: r["probabilities"] for r in network.predicted(both, "x", net).collect()}
    assert [got[k] for k in (900, 901, 902)] == [None] * 3 and len(got[903]) == len(got[None]) == 6
    for r in rows.collect():
        assert np.allclose(got[r["k"]], net.predict(np.array([r["x"]]))[0])
    right = rows.select("k", "y").collect()
    assert np.mean([(np.array(got[r["k"]]) > 0.5) == np.array(r["y"]) for r in right]) > 0.7
    with pytest.raises(ValueError, match="no rows"):
        network.fit(rows.where("false"), "k", "x", "y", str(tmp_path), "pool", SMALL, run="none")
    assert network.predicted(rows.where("false"), "x", net).count() == 0
    assert "probabilities" in network.predicted(rows.select(F.col("x"), F.col("g").alias("layers")), "x", net).columns


def test_places_are_those_of_all_pairs(spark, monkeypatch):
    """Blocks give what a join of all pairs gives, with equal bits, nulls and rows of another length, and no pair is shuffled."""
    from corvane import plans
    from corvane.operators import bits
    from corvane.plans import outputs

    draw = np.random.default_rng(5)
    some = draw.integers(0, 2, (40, 5)).astype(float).tolist()
    odd = [(900, 0, None), (901, 0, [1.0] * 4), (902, 0, [1.0, None, 0.0, 0.0, 1.0]), (None, 0, [1.0] * 5), (903, None, [1.0] * 5), (904, 1, [0.0] * 5)]
    rows = spark.createDataFrame([(n, n % 3, some[n % 40]) for n in range(300)] + odd, "vec_id long, label long, bits array<double>")
    guesses = [(n, draw.choice([0.0, 0.1, 0.3, 0.7, 1.0], 5).tolist()) for n in range(0, 300, 4)] + [(900, [0.5] * 5), (901, [0.5] * 5), (904, [0.0] * 5), (903, [0.5] * 5), (902, None), (8, [0.2] * 5)]
    guesses += [(12, [float("nan")] * 5), (900, [float("nan")] * 5)]
    asked = spark.createDataFrame([(k, n, p) for n, (k, p) in enumerate(guesses)], "k long, vec_id long, probabilities array<double>").join(rows.withColumnRenamed("vec_id", "k"), "k")
    rows = rows.unionByName(asked.select("vec_id", "label", "bits"))
    asked = asked.select("vec_id", "label", "probabilities", bits.soft_tanimoto(F.col("probabilities"), F.col("bits")).alias("own")).cache()
    both = asked.join(rows.select("label", F.col("vec_id").alias("other"), F.col("bits").alias("b")), "label")
    ahead = (F.col("other") != F.col("vec_id")) & (bits.soft_tanimoto(F.col("probabilities"), F.col("b")) > F.col("own"))
    want = both.groupBy("vec_id").agg(F.first("own").alias("own"), (F.sum(ahead.cast("long")) + 1).alias("place"), F.count("*").alias("candidates"))
    as_set = lambda df: sorted(map(str, df.drop("own").collect()))
    assert len(want := as_set(want)) > 70
    for block in (8192, 7):
        monkeypatch.setattr(outputs, "PLACED", block)
        got = outputs._places(asked, rows, 5)
        assert as_set(got) == want and got.join(asked.select("vec_id", "own"), ["vec_id", "own"]).select("vec_id").distinct().count() == len(want)
    plan = plans.QUERIES["mlo09_ranking_network"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "HashJoin" in line and "__a#" in line and "__b#" in line]
