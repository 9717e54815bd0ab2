"""Reports on a ranker's table against plain loops, the export's check, and hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ranker, reports

FEATURES = ["a", "b"]
FEW = ranker.Settings(trees=6, depth=2, bins=8, rate=0.3)


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(5)
    rows = []
    for q in range(60):
        n = int(draw.integers(2, 9))
        a, b = draw.integers(0, 6, n), draw.normal(size=n)
        best = int(np.argmax(a + 0.1 * b)) if q % 7 else -1  # some queries have no answer
        rows += [(q, k, float(a[k]), float(b[k]) if k else None, int(k == best)) for k in range(n)]
    df = spark.createDataFrame(rows, "q int, k int, a double, b double, y int").cache()
    queries = spark.createDataFrame([(q, q % 2) for q in range(62)], "q int, odd int")  # two of them have no rows
    return rows, df, queries


def rr(rows, q, score, most=25):
    own = sorted((r for r in rows if r[0] == q), key=lambda r: (score(r) is None, -(score(r) or 0), r[1]))
    place = next((n for n, r in enumerate(own, 1) if r[4]), None)
    return (1 / place if place and place <= most else 0.0), place


def test_standing(table):
    rows, df, queries = table
    got = {r["odd"]: r for r in reports.standing(df, queries, "q", "k", "b", "y", "odd", most=2).collect()}
    for odd in (0, 1):
        each = [rr(rows, q, lambda r: r[3], 2) for q in range(62) if q % 2 == odd]
        assert (got[odd]["queries"], got[odd]["near"], got[odd]["listed"]) == (31, sum(v > 0 for v, _ in each), sum(p is not None for _, p in each))
        assert got[odd]["mrr"] == pytest.approx(np.mean([v for v, _ in each]))


def test_feature_auc(table):
    rows, df, _ = table
    got = {r["feature"]: r for r in reports.feature_auc(df, "q", FEATURES, "y").collect()}
    for f, at in (("a", 2), ("b", 3)):
        each = []
        for q in range(60):
            own = [r for r in rows if r[0] == q and r[at] is not None]
            hits, rest = [r[at] for r in own if r[4]], [r[at] for r in own if not r[4]]
            if hits and rest:
                each.append(np.mean([(h > o) + (h == o) / 2 for h in hits for o in rest]))
        assert got[f]["queries"] == len(each) and got[f]["auc"] == pytest.approx(np.mean(each))


def test_cross_validation_and_gain(table):
    rows, df, queries = table
    oof = reports.cross_validated(df, "q", "k", FEATURES, "y", folds=2, settings=FEW).cache()
    assert oof.count() == len(rows) and oof.groupBy("q").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    got = {r["odd"]: r for r in reports.gain(oof, queries, "q", "k", "b", "score", "y", "odd").collect()}
    learned = {(r["q"], r["k"]): r["score"] for r in oof.collect()}
    for odd in (0, 1):
        a = np.array([rr(rows, q, lambda r: r[3])[0] for q in range(62) if q % 2 == odd])
        b = np.array([rr(rows, q, lambda r: learned[r[0], r[1]])[0] for q in range(62) if q % 2 == odd])
        r = got[odd]
        assert [r["base"], r["learned"], r["difference"], r["error"]] == pytest.approx([a.mean(), b.mean(), (b - a).mean(), (b - a).std(ddof=1) / 31**0.5])
        assert r["learned"] > r["base"]
    bounds = reports.gain_bounds(oof, queries, "q", "k", "b", "score", "y", replicates=200).first()
    assert 0 < bounds["low"] < bounds["mean"] < bounds["high"]


def test_the_export_is_checked(spark, table, tmp_path, monkeypatch):
    rows, df, _ = table
    model = reports.fit_and_export(df, "q", "k", FEATURES, "y", str(tmp_path / "m"), settings=FEW)
    names, flat = reports.load(spark, str(tmp_path / "m"))
    assert names == FEATURES
    want = np.array([r["s"] for r in df.orderBy("q", "k").select(model.score().alias("s")).collect()])
    x = np.array([[r[2], np.nan if r[3] is None else r[3]] for r in sorted(rows)])
    assert np.abs(ranker.flat_scores(flat, x) - want).max() < 1e-9
    real = reports.load
    monkeypatch.setattr(reports, "load", lambda *a: (real(*a)[0], [s | {"value": s["value"] + 1e-6} for s in real(*a)[1]]))
    with pytest.raises(ValueError, match="differ"):
        reports.fit_and_export(df, "q", "k", FEATURES, "y", str(tmp_path / "n"), settings=FEW)


def test_empty_tables(table):
    _, df, queries = table
    assert reports.feature_auc(df.where("false"), "q", FEATURES, "y").count() == 0
    assert {(r["mrr"], r["near"], r["listed"]) for r in reports.standing(df.where("false"), queries, "q", "k", "a", "y", "odd").collect()} == {(0.0, 0, 0)}
    assert reports.standing(df, queries.where("false"), "q", "k", "a", "y", "odd").count() == 0


def test_sweep(table):
    rows, df, queries = table
    settings = [{"a": a, "b": b} for a in (0.0, 1.0) for b in (0.5, -2.0)]
    got = {(r["a"], r["b"]): r for r in reports.swept(df, queries, "q", "k", "y", settings, most=3).collect()}
    assert len(got) == 4
    for s in settings:
        want = [rr(rows, q, lambda r: s["a"] * r[2] + s["b"] * (r[3] or 0.0), 3)[0] for q in range(62)]
        r = got[s["a"], s["b"]]
        assert r["queries"] == 62 and r["mrr"] == pytest.approx(np.mean(want))
    assert [r["mrr"] for r in reports.swept(df.where("false"), queries, "q", "k", "y", settings).collect()] == [0.0] * 4
    with pytest.raises(ValueError, match="same terms"):
        reports.swept(df, queries, "q", "k", "y", [{"a": 1.0}, {"b": 1.0}])


def test_gain_reads_the_rows_once(spark):
    rows = spark.range(60).selectExpr("id div 6 as q", "id as row", "cast(id % 7 as double) as base", "cast(id % 5 as double) as score", "cast(id % 6 = 2 as int) as y")
    queries = spark.range(11).selectExpr("id as q", "id % 2 as cohort")
    both = reports._both_ranks(rows, queries, "q", "row", "base", "score", "y", 3)
    for name, score in (("learned", "score"), ("base", "base")):
        want = {r["q"]: r["rr"] for r in reports.reciprocal_ranks(rows, queries, "q", "row", score, "y", 3).collect()}
        assert {r["q"]: r[name] for r in both.collect()} == want and len(want) == 11
    plan = reports.gain(rows, queries, "q", "row", "base", "score", "y", "cohort")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Range (") == 2  # the rows and the queries
