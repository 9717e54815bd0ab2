"""Hand-checked cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import kernels, scalars
from corvane.operators import bits, compose, metrics, models, peaks, rangejoin, ranking, signal, splits, topk


def column(df, c, order=None):
    return [r[c] for r in (df.orderBy(order) if order else df).collect()]


def test_curated_peaks(spark):
    rows = [([(100.0, 0.25), (150.0, 0.001), (200.0, 1.0), (402.0, 0.04), (500.0, 0.9)], 402.0), ([], 1.0), ([(float(k), (k * 37 % 500 + 1) / 500) for k in range(500)], 1000.0)]
    df = spark.createDataFrame(rows, "p array<struct<mz:double,it:double>>, top double")
    a, b, c = (r[0] for r in df.select(peaks.curate(F.col("p"), F.col("top"))).collect())
    assert [(p["mz"], round(p["it"], 6)) for p in a] == [(100.0, 0.5), (200.0, 1.0), (402.0, 0.2)]
    assert b == [] and len(c) == 64
    strongest = sorted(rows[2][0], key=lambda p: (-p[1], p[0]))[:64]
    assert [p["mz"] for p in c] == sorted(m for m, _ in strongest)


def pair_of(spark, q, r, weigh):
    """met() of the pair (1, 2) of two peak lists."""
    rows = spark.createDataFrame([(1, *x) for x in q] + [(2, *x) for x in r] + [(3, 5, 1.0)], "rid long, bin long, w double")
    return peaks.met(spark.createDataFrame([(1, 2)], "q long, r long"), weigh(peaks.records(rows, "rid", "bin", "w")), "rid", "q", "r")


def sims(spark, q, r, kind):
    weigh = peaks.entropy_weights if kind == "entropy" else peaks.normalised
    got = (peaks.entropy_similarity if kind == "entropy" else peaks.cosine)(pair_of(spark, q, r, weigh)).collect()
    return got[0]["sim"] if got else 0.0


@pytest.mark.parametrize("kind", ["entropy", "cosine"])
def test_similarity_of_two_records(spark, kind):
    q = [(100, 0.5), (200, 0.5)]
    assert sims(spark, q, [(100, 0.5), (300, 0.5)], kind) == pytest.approx(0.5)
    assert sims(spark, q, q, kind) == pytest.approx(1)
    assert sims(spark, q, [(7, 1.0)], kind) == 0


def test_reverse_cosine_ignores_junk(spark):
    r = [(k, 1.0) for k in range(8)]
    q = r + [(100 + k, 2.0) for k in range(3)]
    got = peaks.reverse_cosine(pair_of(spark, q, r, peaks.normalised)).first()
    assert got["reverse"] > 0.99 > got["plain"] and got["hybrid"] == pytest.approx((got["reverse"] + got["plain"]) / 2)


def test_shifted_match(spark):
    rows = pair_of(spark, [(114, 1.0), (214, 1.0), (300, 1.0)], [(100, 1.0), (200, 1.0), (286, 1.0)], peaks.normalised)
    got = peaks.shifted_similarity(rows.withColumn("s", F.lit(14)), "s").first()
    assert got["direct"] < 0.2 and got["shifted"] > 0.99 and got["sim"] == got["shifted"]


@pytest.mark.parametrize("per_slot", [100_000, 7])
def test_window_counts_and_intervals_by_slots(spark, per_slot):
    """Ties, edges met exactly, a value with a third of all rows, nulls, an empty library; one slot and many."""
    rng = np.random.default_rng(3)
    lib = [float(x) for x in rng.integers(0, 60, 80)] + [20.0] * 40 + [0.1 * k for k in range(20)] + [None]
    ask = [float(x) for x in rng.integers(-10, 75, 40)] + [20.0, 20.0, 0.3, 1e6, -1e6, None]
    rows = spark.createDataFrame(list(enumerate(ask)), "id long, v double")
    library = spark.createDataFrame([(x,) for x in lib], "y double")
    got = {r["id"]: (r["n"], r["most"]) for r in rangejoin.window_counts(rows, "v", library, "y", 2.0, per_slot).collect()}
    for i, v in enumerate(ask):
        near = [y for y in lib if v is not None and y is not None and abs(y - v) <= 2.0]
        assert got[i] == (len(near), max(near, default=None)), v
    assert {(r["n"], r["most"]) for r in rangejoin.window_counts(rows, "v", library.limit(0), "y", 2.0, per_slot).collect()} == {(0, None)}
    cuts = spark.createDataFrame([(10.0 * k, 10.0 * k + 7) for k in range(-1, 7)], "lo double, hi double")
    held = {r["id"]: r["lo"] for r in rangejoin.interval_join(rows, "v", cuts, "lo", "hi", per_slot).collect()}
    assert held == {i: 10.0 * (v // 10) for i, v in enumerate(ask) if v is not None and -10 <= v < 67 and v % 10 < 7}


def test_tanimoto_and_propagation(spark):
    pool = spark.createDataFrame([(1, "a", [0b011]), (1, "b", [0b101]), (1, "c", [0b1000])], "q long, key string, fp array<long>")
    seeds = spark.createDataFrame([(1, [0b011], 0.5)], "q long, sfp array<long>, score double")
    got = {r["key"]: r["analog"] for r in bits.propagated(pool, seeds, "q", "key", "fp", "sfp", "score", power=3).collect()}
    assert got == {"a": pytest.approx(0.125), "b": pytest.approx(0.125 / 3)}
    assert bits.propagated(pool, seeds.limit(0), "q", "key", "fp", "sfp", "score").count() == 0
    none = spark.createDataFrame([([0], [0])], "a array<long>, b array<long>").select(bits.tanimoto(F.col("a"), F.col("b"))).first()[0]
    assert none == 0
    word = spark.range(1).select(bits.unpack(bits.pack(F.array(F.lit(True), F.lit(False), F.lit(True))), 3)).first()[0]
    assert word == [1, 0, 1]


@pytest.mark.parametrize("kind", ["absolute", "ppm"])
def test_range_joins_against_all_pairs(spark, kind):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.uniform(100, 1000, 60), 3), np.round(rng.uniform(100, 1000, 400), 3)
    b[:20] = a[:20] + 2.0
    q = spark.createDataFrame([(float(v),) for v in a], "x double")
    lib = spark.createDataFrame([(float(v),) for v in b], "y double")
    got = rangejoin.absolute_join(q, "x", lib, "y", 2.0) if kind == "absolute" else rangejoin.ppm_join(q, "x", lib, "y", 5000)
    tolerance = (lambda x: 2.0) if kind == "absolute" else (lambda x: x * (5000 / 1e6))
    assert sorted((r["x"], r["y"]) for r in got.collect()) == sorted((float(x), float(y)) for x in a for y in b if abs(y - x) <= tolerance(x))


def test_intervals_and_nearest(spark):
    cuts = spark.createDataFrame([(0.0, 5.0, "a"), (5.0, 9.0, "b"), (20.0, 30.0, "c")], "lo double, hi double, name string")
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 4.9, 5.0, 9.0, 25.0, 30.0)], "v double")
    assert sorted((r["v"], r["name"]) for r in rangejoin.interval_join(rows, "v", cuts, "lo", "hi").collect()) == [(0.0, "a"), (4.9, "a"), (5.0, "b"), (25.0, "c")]
    near = rangejoin.nearest_join(rows, "v", spark.createDataFrame([(4.0,), (6.0,)], "at double"), "at", 1.0)
    assert {(r["v"], r["at"]) for r in near.collect()} == {(-1.0, None), (0.0, None), (4.9, 4.0), (5.0, 4.0), (9.0, None), (25.0, None), (30.0, None)}


def test_average_rank_of_ties(spark):
    rows = [(1, 0.5)] * 120 + [(1, k / 100) for k in range(60, 140)] + [(2, None), (2, 7.0)]
    got = ranking.average_rank(spark.createDataFrame(rows, "k long, s double"), ["k"], "s", "r").collect()
    assert {r["r"] for r in got if r["k"] == 1 and r["s"] == 0.5} == {59.5 / 199}
    assert all(0 <= r["r"] <= 1 for r in got if r["s"] is not None) and [r["r"] for r in got if r["s"] is None] == [None]


def test_rolling_in_files(spark):
    rows = [("b", 5, 20.0), ("a", 10, 0.0), ("a", 0, 0.0), ("b", 0, 10.0), ("a", 5, 1.0)]
    df = spark.createDataFrame(rows, "f string, s long, v double")
    got = df.select("f", "s", ranking.rolling(["f"], "s", "v", 1, "mean").alias("m"), ranking.rolling(["f"], "s", "v", 1).alias("t")).orderBy("f", "s").collect()
    assert [r["m"] for r in got] == pytest.approx([0.5, 1 / 3, 0.5, 15, 15]) and [r["t"] for r in got] == [1, 1, 1, 20, 20]


def test_quantile_map_keeps_order_and_ties(spark):
    left = spark.createDataFrame([("x", 1, 0.3), ("x", 2, 0.1), ("x", 3, 0.3)], "k string, i long, s double")
    right = spark.createDataFrame([("x", 10.0), ("x", 30.0), ("x", 20.0)], "k string, v double")
    got = ranking.quantile_map(left, ["k"], "s", right, "v", "m", "i")
    assert column(got, "m", "i") == [25.0, 10.0, 25.0]


def test_top_and_samples(spark):
    df = spark.createDataFrame(list(enumerate([0.9, 0.1, 0.5, 0.99, 0.01])), "i long, v double").withColumn("k", F.lit(0))
    ends = topk.both_ends(df, ["k"], "v", "i", 2)
    assert column(ends.where("side = 'top'"), "i", "rank") == [3, 0] and set(column(ends.where("side = 'bottom'"), "i")) == {4, 1}
    many = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    one, two = (topk.capped_sample(many, ["k"], ["id"], 30, s) for s in ("a", "b"))
    assert one.groupBy("k").count().agg(F.max("count")).first()[0] == 30
    assert set(column(one, "id")) == set(column(topk.capped_sample(many.repartition(5), ["k"], ["id"], 30, "a"), "id")) != set(column(two, "id"))
    assert column(topk.every_nth(many.where("k = 0"), "id", 50, ["k"]), "id", "id") == [0, 350, 700]


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 3, 1), (2, 1, 0), (3, 26, 1)], "q long, n long, y long")
    rr = metrics.reciprocal_ranks(spark.range(5).select(F.col("id").alias("q")), ranked, "q", "n", F.col("y") == 1)
    assert column(rr, "rr", "q") == [0.5, 1.0, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([(0, 3.0, 1), (0, 1.0, 0), (0, 2.0, 0), (1, 1.0, 1), (1, 1.0, 0), (2, 5.0, 1)], "q long, s double, y long")
    assert {r["q"]: r["auc"] for r in metrics.auc(rows, ["q"], "s", "y").collect()} == {0: 1.0, 1: 0.5}
    same = spark.range(50).select("id", F.lit(1.5).alias("a"), F.lit(1.5).alias("b"))
    assert tuple(metrics.bootstrap(same, "id", "a", "b", 50).first()) == (0, 0, 0)
    moved = spark.range(400).select("id", (F.col("id") % 5).cast("double").alias("a"), F.lit(1.0).alias("b"))
    got = metrics.bootstrap(moved, "id", "a", "b", 200).first()
    assert got["mean"] == pytest.approx(1.0) and got["low"] < 1.0 < got["high"] and got["high"] - got["low"] == pytest.approx(4 * math.sqrt(2 / 400), rel=0.25)


def test_composite_gate(spark):
    terms = {"spectral": [("a", 0.9)], "analog": [("a", 1.0), ("b", 0.5)], "fingerprint": [("a", 1.0), ("b", 0.25)], "shifted": [("b", 0.1)], "prior": [("a", 1.8), ("b", 2.0), ("c", 1.8)]}
    rows = compose.union_terms({t: spark.createDataFrame([(1, k, v) for k, v in x], "q long, key string, value double") for t, x in terms.items()}, ["q", "key"])
    total = lambda gate: {r["key"]: r["total"] for r in compose.composite(rows, ["q", "key"], "q", gate=gate).collect()}
    assert total(0.8) == {"a": pytest.approx(33.9), "b": pytest.approx(10.1), "c": 0}
    assert total(0.95) == {"a": pytest.approx(34.8), "b": pytest.approx(11.1), "c": pytest.approx(0.9)}


def test_signal_windows(spark):
    df = spark.range(100).select(F.lit(1).alias("series"), F.col("id").alias("pos"), F.when(F.col("id").between(40, 49), 9.0).otherwise(1.0).alias("value"))
    loud = signal.loudest(df, "series", "value", 10).first()
    assert (loud["start"], loud["rms"]) == (40, 9.0)
    assert signal.sliding(df, 20, 5).groupBy("win").count().where("count = 20").count() == 17
    wave = df.withColumn("value", F.sin(F.col("pos") * 2 * math.pi * 8 / 100))
    got = signal.spectrum(signal.tumbling(wave, 100), ["series", "win"], "value").first()
    # Without the constant part, the eighth of fifty frequencies lies at 7 / 49; bands are log10 shares.
    assert got["centroid"] == pytest.approx(7 / 49, abs=1e-6) and sum(10 ** got[f"band_{k}"] for k in range(8)) == pytest.approx(1)
    assert spark.range(1).select(signal.quantised(F.array(F.lit(0.5), F.lit(-1.0), F.lit(1.2)))).first()[0] == [16384, -32767, 32767]


def test_splits(spark):
    rows = spark.range(3000).select(F.col("id").alias("rid"), (F.col("id") % 400).alias("key"), (F.col("id") % 7).cast("string").alias("lib"))
    split = splits.novelty_split(rows, "rid", "key", "lib", 20, 4, "s")
    assert {r["broken"] for r in splits.violations(split, "rid", "key").collect()} == {0}
    per = split["queries"].groupBy("key").count().agg(F.max("count")).first()[0]
    assert per <= 4 and {r["qclass"] for r in split["queries"].select("qclass").distinct().collect()} == {1, 2, 3}
    fold = lambda df: {(r["key"], r["f"]) for r in df.select("key", splits.group_fold(F.col("key"), 5).alias("f")).distinct().collect()}
    assert fold(rows) == fold(rows.where("rid < 400"))
    assert splits.balanced_folds(rows, "key", 4).groupBy("fold").count().agg(F.min("count"), F.max("count")).first() == (100, 100)


def test_ridge_from_gram(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 12)), rng.normal(size=200)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(3)
    xx, xy, n = models.gram(df, "x", "y", 12)
    assert n == 200 and np.allclose(models.ridge(xx, xy, [0.5])[0.5], np.linalg.solve(x.T @ x + 0.5 * np.eye(12), x.T @ y))


def test_tree_scorer_on_thresholds(spark):
    trees = [[{"feature": 0, "threshold": 1.0, "left": 1, "right": 2, "nan_left": False}, {"value": -1.0}, {"value": 2.0}]]
    df = spark.createDataFrame([(1.0,), (1.0000001,), (float("nan"),), (None,)], "x double")
    assert column(df.select(models.ensemble_score(trees, ["x"], 0.5).alias("s")), "s") == [-0.5, 2.5, 2.5, 2.5]


def test_pairwise_ranker(spark):
    rng = np.random.default_rng(1)
    rows = [(int(q), rng.normal(size=3).tolist()) for q in range(20) for _ in range(10)]
    df = spark.createDataFrame([(q, x, int(x[1] > 0.8)) for q, x in rows], "q long, x array<double>, y int")
    w = models.pairwise_ranker(df, "q", "x", "y", 3, rounds=10)
    assert abs(w[1]) == max(abs(w)) and w[1] > 0


def test_kernels():
    assert kernels.elements("C2H6O") == {"C": 2, "H": 6, "O": 1} and kernels.elements("c?") == {}
    assert kernels.mass("C2H6O") == pytest.approx(46.041865, abs=1e-5)
    h, c, o = kernels.MASSES["H"], 12.0, kernels.MASSES["O"]
    masses = kernels.fragments([c + 3 * h, c + 2 * h, o + h], [(0, 1), (1, 2)])
    for m in (15.02348, 31.01839, 29.03913, 17.00274, 14.01565, 46.04186):
        assert any(abs(m - x) < 1e-4 for x in masses)
    peaks_ = [(15.02348 + kernels.PROTON, 1.0), (99.0, 3.0)]
    assert kernels.explained(peaks_, masses) == pytest.approx(0.25) and kernels.explained([], masses) == 0
    assert kernels.subformula_masses("CH2")[-1] == pytest.approx(kernels.mass("CH2"), abs=1e-5)
    assert kernels.subformula_masses("C9999H9999") == []  # too many: no evidence


def test_scalars(spark):
    df = spark.createDataFrame([("x_y_10", "a|b|c", "NaN"), ("q", "None", "1.5"), ("z_1", None, "oops")], "a string, b string, c string")
    head, tail = scalars.split_last(F.col("a"))
    got = df.select(head.alias("h"), tail.alias("t"), scalars.count_items(F.col("b")).alias("n"), scalars.clean_number(F.col("c")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("x_y", "10", 3, 0.0), ("", "", 0, 1.5), ("z", "1", 0, 0.0)]


def spectrum_of(x):
    """The definition for one window: power without its constant part, eight log-spaced bands, centroid, roll-off."""
    power = np.abs(np.fft.rfft(x))[1:] ** 2
    total, at = power.sum() + 1e-30, np.linspace(0, 1, len(power))
    edges = np.geomspace(1e-3, 1, 9)
    bands = [np.log10(power[(at >= a) & (at < b)].sum() / total + 1e-12) for a, b in zip(edges, edges[1:])]
    return [*bands, (at * power).sum() / total, at[np.searchsorted(np.cumsum(power) / total, 0.95)]]


def test_spectrum_against_its_definition(spark):
    rng = np.random.default_rng(5)
    windows = {k: rng.normal(size=n) + np.sin(np.arange(n) * k) for k, n in enumerate([64, 64, 2000, 33, 64])}
    rows = [(k, i, float(v)) for k, x in windows.items() for i, v in enumerate(x)] + [(9, 0, 1.0)]
    got = {r["k"]: list(r)[1:] for r in signal.spectrum(spark.createDataFrame(rows, "k int, off long, v double"), ["k"], "v").collect()}
    assert got.pop(9) == [-12.0] * 8 + [0.0, 0.0]
    for k, x in windows.items():
        assert np.allclose(got[k], spectrum_of(x), atol=1e-6), k


def test_one_long_series(spark, monkeypatch):
    """Numbers, sums and looks ahead of a series over many slots are those of one window, and no window is keyed by the series alone."""
    from corvane.operators import ranking

    rng = np.random.default_rng(6)
    data = [(1, int(s), i, float(v), bool(v > 1.5)) for i, (s, v) in enumerate(zip(np.sort(rng.integers(0, 900, 3000)), rng.normal(size=3000)))]
    df = spark.createDataFrame(data, "series int, sec long, id long, v double, reset boolean").repartition(4)
    want = {i: (k, sum(d[3] for d in data[:k]), next((d[1] for d in data[k:] if d[4]), None)) for k, (_, _, i, _, _) in enumerate(data)}
    monkeypatch.setattr(ranking, "PER_SLOT", 200)
    pos = signal.positions(df, "series", "sec", "id")
    assert {r["id"]: r["pos"] for r in pos.collect()} == {i: w[0] for i, w in want.items()}
    sums = ranking.running_before(df, ["series"], "id", "v", "before")
    assert all(abs(r["before"] - want[r["id"]][1]) < 1e-9 for r in sums.collect())
    ahead = signal.time_to_next(df, "series", "sec", F.col("reset"), "id")
    assert {r["id"]: r["ttf"] for r in ahead.collect()} == {i: None if w[2] is None else w[2] - data[w[0]][1] for i, w in want.items()}
    rms = [np.sqrt(np.mean([d[3] ** 2 for d in data[k : k + 50]])) for k in range(len(data) - 49)]
    top = signal.loudest(pos, "series", "v", 50, stretch=128).first()
    assert top["start"] == int(np.argmax(np.round(rms, 9))) and top["rms"] == pytest.approx(max(rms))
    for plan in (pos, sums, ahead):
        lines = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "windowspecdefinition" in x]
        assert lines and all("__slot" in x for x in lines)


def test_exact_quantiles(spark):
    from corvane.operators.ranking import quantiles

    rng = np.random.default_rng(7)
    data = [(k, float(v)) for k in range(3) for v in np.round(rng.exponential(size=500 + k), 1)] + [(7, 2.5), (8, None)]
    got = {r["k"]: r for r in quantiles(spark.createDataFrame(data, "k int, v double"), ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.999, "d": 1.0}).collect()}
    assert set(got) == {0, 1, 2, 7}
    for k, r in got.items():
        own = [v for i, v in data if i == k]
        assert [r[c] for c in "abcd"] == pytest.approx([np.quantile(own, q) for q in (0.05, 0.5, 0.999, 1.0)])


def test_fragments_against_all_cuts():
    from itertools import combinations

    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        weights = [float(w) for w in rng.integers(1, 1000, n)]
        bonds = [(int(rng.integers(0, k)), k) for k in range(1, n)] + [tuple(map(int, rng.choice(n, 2, replace=False))) for _ in range(int(rng.integers(0, 3))) if n > 1]

        def parts(cut):
            left = set(range(n))
            while left:
                todo, own = [left.pop()], []
                while todo:
                    own.append(todo.pop())
                    for k, (a, b) in enumerate(bonds):
                        if k not in cut and own[-1] in (a, b) and (c := b if own[-1] == a else a) in left:
                            left.remove(c)
                            todo.append(c)
                yield round(sum(weights[a] for a in own), 6)

        want = {m for size in (0, 1, 2) for cut in combinations(range(len(bonds)), size) for m in parts(cut)}
        assert set(kernels.fragments(weights, bonds)) == want
    assert kernels.subformula_masses("C400H400N400O400") == [] and kernels.subformula_masses("Xx2") == []


@pytest.mark.parametrize("classify", [False, True])
def test_exported_trees_score_like_the_model(spark, tmp_path, classify):
    rng = np.random.default_rng(9)
    x = rng.random((400, 3))
    y = (x[:, 0] > x[:, 1]).astype(float) if classify else 3 * x[:, 0] + x[:, 2]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    model = models.boosted(df, ["a", "b", "c"], "y", classify=classify, iterations=4)
    models.export(model, ["a", "b", "c"], str(tmp_path / "model"), df)
    got = df.withColumn("s", models.imported(spark, str(tmp_path / "model"))).collect()
    gap = [abs((r["s"] > 0.5) - r["y"]) if classify else abs(r["s"] - r["y"]) for r in got]
    assert np.mean(gap) < 0.4
    with pytest.raises(ValueError):
        models.export(model, ["a", "c", "b"], str(tmp_path / "other"), df.select(F.col("a"), (F.col("b") + 5).alias("c"), F.col("c").alias("b")).union(df.select("a", "b", "c")), tolerance=-1.0)


def test_mlp_probe_tells_what_no_line_can(spark):
    rng = np.random.default_rng(10)
    x = rng.uniform(-1, 1, (400, 2))
    df = spark.createDataFrame([([float(a), float(b)], float(a * b > 0)) for a, b in x], "x array<double>, y double")
    got = models.mlp_probe(df, "x", "y", 2, 2, hidden=12, iterations=200)(df).collect()
    assert np.mean([r["guess"] == r["y"] for r in got]) > 0.9


def test_half_precision_against_numpy(spark):
    rng = np.random.default_rng(11)
    x = [0.0, -0.0, 1.0, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 65504.0, 65519.0, 65520.0, -1e9, 2049.0, 2051.0, *(rng.normal(size=500) * 10.0 ** rng.integers(-8, 5, 500))]
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").select("i", scalars.half(F.col("v")).alias("h")).collect()
    with np.errstate(over="ignore"):
        assert all(r["h"] == float(np.float16(x[r["i"]])) for r in got)


def test_hashed_crop_and_out_of_fold(spark, tables):
    """The crop's start is the hash's remainder and its values follow; each fold's guesses come from the other folds' ridge."""
    from hashlib import md5

    from corvane import plans

    from .conftest import SMALL

    rows = {r["vec_id"]: r["embedding"] for r in tables.embeddings.collect()}
    for r in plans.QUERIES["win19_hashed_crop"](spark, SMALL).collect():
        start = int(md5(f"crop:{r['vec_id']}".encode()).hexdigest()[:8], 16) % (len(rows[r["vec_id"]]) - 16 + 1)
        assert r["start"] == start and r["crop"] == rows[r["vec_id"]][start : start + 16]
    orders = [(o["o_orderkey"], int(md5(f"fold:{o['o_custkey']}".encode()).hexdigest()[:8], 16) % 3, o["o_custkey"] % 100, o["o_totalprice"]) for o in tables.orders.collect()]
    got = {r["o_orderkey"]: r for r in plans.QUERIES["evl07_out_of_fold"](spark, SMALL).collect()}
    for fold in range(3):
        train = np.array([[1.0, x, y] for _, f, x, y in orders if f != fold])
        w = np.linalg.solve(train[:, :2].T @ train[:, :2] + np.eye(2), train[:, :2].T @ train[:, 2])
        assert all(got[k]["fold"] == f and got[k]["guess"] == pytest.approx(w[0] + w[1] * x, rel=1e-6) for k, f, x, _ in orders if f == fold)
    assert len(got) == len(orders)


def test_shared_bins_are_those_of_all_pairs(spark):
    """Peaks joined by window and bin give what each pair of records in a window gives by itself."""
    import random

    from corvane.operators import peaks as pk, rangejoin

    rng = random.Random(12)
    mz = {k: rng.choice([100.0, 500.0]) * (1 + rng.random() / 200) for k in range(60)}
    rows = [(k, rng.randrange(8), float(rng.randrange(0, 5))) for k in range(60) for _ in range(rng.randrange(6))]
    peaks = spark.createDataFrame(rows, "rid long, bin long, w double").repartition(4)
    records = spark.createDataFrame([*mz.items()], "rid long, mz double")
    asks = records.where("rid % 5 = 0").toDF("q", "q_mz")
    sides = rangejoin.ppm_sides(asks, "q_mz", records, "mz", 2000)
    array = pk.met(rangejoin.ppm_join(asks, "q_mz", records, "mz", 2000).select("q", "rid"), pk.normalised(pk.records(peaks, "rid", "bin", "w")), "rid", "q", "rid")
    found = pk.shared(*sides, pk.flat_cosine(peaks, "rid", "bin", "w"), "rid", "q", "rid")
    plain = lambda df, *c: {(r.q, r.rid): tuple(round(r[x], 9) for x in c) for r in df.collect()}
    assert plain(pk.shared_cosine(found, ["q", "rid"]), "sim") == plain(pk.cosine(array), "sim") != {}
    assert plain(pk.shared_reverse(found, ["q", "rid"]), "plain", "reverse", "hybrid") == plain(pk.reverse_cosine(array), "plain", "reverse", "hybrid")
    weighed = pk.met(rangejoin.ppm_join(asks, "q_mz", records, "mz", 2000).select("q", "rid"), pk.entropy_weights(pk.records(peaks, "rid", "bin", "w")), "rid", "q", "rid")
    flat = pk.shared(*sides, pk.flat_entropy(peaks, "rid", "bin", "w"), "rid", "q", "rid")
    assert plain(pk.shared_entropy(flat, ["q", "rid"]), "sim") == plain(pk.entropy_similarity(weighed), "sim")
