"""One long series over many slots and stretches: results are those of a walk along it."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import metrics, ranking, topk


@pytest.fixture(autouse=True)
def small_slots(monkeypatch):
    monkeypatch.setattr(ranking, "PER_SLOT", 37)
    monkeypatch.setattr(ranking, "STRETCH", 13)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    times = sorted(rng.choice([1, 2, 1000]) * rng.randrange(10**6) for _ in range(600))
    return [("a", t, k, rng.choice([None, rng.random() * 10, rng.random()]), rng.choice("xyz")) for k, t in enumerate(times)] + [("b", 5, 700, 1.0, "x"), ("b", 4, 701, 2.0, "x"), ("c", 1, 702, None, None)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "series string, t long, id long, v double, kind string").repartition(6).persist()


def in_order(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("k", [1, 6, 13])
def test_rolling(table, rows, k):
    got = {r.id: (r.top, r.mid) for r in ranking.rolled(table, ["series"], ["t", "id"], "v", k, {"top": "max", "mid": "mean"}).collect()}
    assert len(got) == len(rows)
    for series in in_order(rows).values():
        for n, r in enumerate(series):
            near = [x[3] for x in series[max(0, n - k) : n + k + 1] if x[3] is not None]
            top, mid = got[r[2]]
            assert top == max(near, default=None) and (mid is None if not near else mid == pytest.approx(sum(near) / len(near)))


def test_neighbours(table, rows):
    got = {r.id: (r.before, r.after, r.far, r.first) for r in ranking.with_neighbours(table, ["series"], ["t", "id"], {"before": ("kind", -1), "after": ("v", 1), "far": ("id", -5)}).collect()}
    for series in in_order(rows).values():
        for n, r in enumerate(series):
            assert got[r[2]] == (series[n - 1][4] if n else None, series[n + 1][3] if n + 1 < len(series) else None, series[n - 5][2] if n >= 5 else None, n == 0)


def test_places_and_sums(table, rows):
    placed = {r.id: r.p for r in ranking.placed(table, ["series"], ["t", "id"], "p").collect()}
    assert placed == {r[2]: n for series in in_order(rows).values() for n, r in enumerate(series)}
    sums = {r.id: r.s for r in ranking.running_before(table.where("v is not null"), ["series"], "id", "v", "s").collect()}
    total = 0.0
    for r in rows[:600]:
        if r[3] is not None:
            assert sums[r[2]] == pytest.approx(total)
            total += r[3]


def test_evenly_spaced(table, rows):
    got = {r.id for r in topk.evenly_spaced(table, ["series"], "id", 6).collect()}
    assert got == {round(k * 599 / 5) for k in range(6)} | {700, 701, 702}


def test_weighted_quantiles_and_medians(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), float(rng.choice([1, 2, 3, 50, 1e9])), rng.randrange(1, 5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    got = {r.k: (r.lo, r.mid) for r in ranking.quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5}, "n").collect()}
    for k in "ab":
        own = sorted(v for a, v, n in rows if a == k for _ in range(n))
        at = lambda q: own[int(q * (len(own) - 1))] + (own[min(int(q * (len(own) - 1)) + 1, len(own) - 1)] - own[int(q * (len(own) - 1))]) * (q * (len(own) - 1) % 1)
        assert got[k] == pytest.approx((at(0.1), at(0.5)))
    medians = {r.k: r["median"] for r in metrics.leave_one_out_median(df, "k", "v").collect()}
    want = df.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()
    assert medians == {"a": next(r.m for r in want if r.k == "b"), "b": next(r.m for r in want if r.k == "a")}
