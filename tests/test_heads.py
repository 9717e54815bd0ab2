"""Heads from sums by fold against direct solutions; support vector regression against its optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import heads, svr


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) + [0, 1, 2, 3, 4]
    y = np.stack([x @ [1, -2, 0, 0.5, 3], np.sin(x[:, 0])], axis=1) + rng.normal(0, 0.1, (300, 2))
    return x, y, rng.integers(0, 4, 300), rng.choice(["window", "clip"], 300), rng.random(300)


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, fold, kind, w = data
    rows = [(k, x[k].tolist(), y[k].tolist(), int(fold[k]), str(kind[k]), float(w[k])) for k in range(300)]
    rows += [(900, None, [1.0, 1.0], 0, "clip", 1.0), (901, [1.0] * 5, [1.0, None], 0, "clip", 1.0), (902, [1.0], [1.0, 1.0], 0, "clip", 1.0), (903, [1.0] * 5, [1.0, 1.0], 0, "clip", None)]
    return spark.createDataFrame(rows, "id int, x array<double>, y array<double>, fold int, kind string, w double").repartition(5).persist()


def direct(x, y, w, alpha):
    """Weighted ridge with an unpenalised intercept by its normal equations."""
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = alpha * np.eye(a.shape[1])
    penalty[-1, -1] = 0
    got = np.linalg.solve(a.T @ (a * w[:, None]) + penalty, a.T @ (y * w[:, None]))
    return got[:-1], got[-1]


def test_one_pass_serves_folds_penalties_and_mixes(table, data):
    x, y, fold, kind, w = data
    sums = heads.fold_sums(table, ["fold", "kind"], "x", "y", 5, 2, "w")
    assert set(sums) == {(f, k) for f in range(4) for k in ("window", "clip")}
    for mix in ({"window": 1.0, "clip": 1.0}, {"window": 1.0, "clip": 0.3}, {"clip": 2.0}):
        rest = heads.without_each(heads.mixed(sums, mix), [0, 1, 2, 3])
        for f in range(4):
            on = fold != f
            own = w[on] * np.array([mix.get(k, 0.0) for k in kind[on]])
            for alpha in (0.1, 10.0):
                for got, want in zip(rest[f].ridge(alpha), direct(x[on], y[on], own, alpha)):
                    assert np.allclose(got, want, atol=1e-8)


def test_scores_by_fold(table, data):
    x, _, fold, _, _ = data
    sums = heads.fold_sums(table, ["fold"], "x", "y", 5, 2)
    fitted = {f: s.ridge(1.0) for f, s in heads.without_each(sums, [0, 1, 2]).items()}
    got = {r.id: r.scores for r in heads.scored(table, "x", "fold", fitted).where("id < 300 or id = 900").collect()}
    for k in range(300):
        if fold[k] == 3:
            assert got[k] is None
        else:
            c, b = fitted[fold[k]]
            assert np.allclose(got[k], x[k] @ c + b)
    assert got[900] is None
    assert heads.fold_sums(table.limit(0), ["fold"], "x", "y", 5, 2) == {}
    empty = heads.Sums.unpacked(np.zeros(25 + 10 + 5 + 2 + 1), 5, 2).ridge(1.0)
    assert not empty[0].any() and not empty[1].any()


@pytest.mark.parametrize("n, nu, c", [(60, 0.5, 1.0), (200, 0.7, 1.0), (150, 0.2, 10.0), (1, 0.5, 1.0), (2, 1.0, 1.0)])
def test_optimality_conditions(n, nu, c):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.2, n)
    kernel = svr.rbf(x, x, 0.4)
    weights, bias, epsilon = svr.solve(kernel, y, nu, c, 1e-3)
    assert abs(weights.sum()) < 1e-8 and np.abs(weights).max() <= c + 1e-9 and np.abs(weights).sum() <= c * nu * n + 1e-6
    if n < 10:
        return
    off = y - (kernel @ weights + bias)
    inside, free, top = np.abs(weights) < 1e-9, (np.abs(weights) > 1e-6) & (np.abs(weights) < c - 1e-6), np.abs(weights) > c - 1e-6
    assert epsilon > 0 and np.abs(off[inside]).max(initial=0) <= epsilon + 2e-3
    assert np.allclose(off[free], np.sign(weights[free]) * epsilon, atol=2e-3)
    assert (np.sign(weights[top]) * off[top] >= epsilon - 2e-3).all()
    assert (np.abs(off) > epsilon + 2e-3).mean() <= nu <= (~inside).mean() + 1e-9


def test_support_vectors_over_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    rows = [(k, x[k].tolist(), float(np.sin(2 * x[k, 0]) + 0.5 * x[k, 1])) for k in range(400)] + [(500, None, 1.0), (501, [1.0, float("nan")], 1.0), (502, [0.1, 0.1], None)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y double").repartition(3)
    model = svr.fit(df.where(F.col("id") % 2 == 0), "id", "x", "y", c=10.0, nu=0.3)
    got = {r.id: r.guess for r in svr.predicted(df, "x", model).collect()}
    held = [abs(got[k] - rows[k][2]) for k in range(1, 400, 2)]
    assert np.mean(held) < 0.1 and got[500] is None and got[502] is not None
    few = svr.fit(df, "id", "x", "y", most=50)
    assert 0 < len(few.vectors) <= 50
    assert {r.guess for r in svr.predicted(df.where("id < 5"), "x", svr.fit(df.limit(0), "id", "x", "y")).collect()} == {0.0}
