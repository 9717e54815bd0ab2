"""The pipeline stage by stage against plain Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe_codec, quality_rank, quality_rules, wordbpe
from corvane.llm.common import table

from .test_methods import BIG, components


def test_stages(spark):
    docs = table(spark, BIG, "documents")
    labels = table(spark, BIG, "labels")
    trees, ranker = quality_rules.fit(docs, labels), quality_rank.fit(docs, labels)
    held, outs = docs, []
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, BIG).persist()
        outs.append(held)
    assert all(o.columns == docs.columns for o in outs[:-1])
    rows = {r["doc_id"]: r for r in docs.collect()}
    first = {i for i, r in rows.items() if quality_rules.verdicts([r["text"]], trees)[0][-1]}
    assert {r["doc_id"] for r in outs[0].collect()} == first
    second = {i for i in first if quality_rank.scores([rows[i]["text"]], ranker)[0] >= quality_rank.CUT}
    assert {r["doc_id"] for r in outs[1].collect()} == second
    third = {i for i, (n, c) in components([(i, rows[i]["text"]) for i in sorted(second)], 5, 80).items() if c == i}
    assert sorted(r["doc_id"] for r in outs[2].collect()) == sorted(third)
    mixed = Counter(r["doc_id"] for r in outs[3].collect())
    assert set(mixed) <= third and max(mixed.values()) <= 3
    size = {i: len(rows[i]["text"].split()) for i in third}
    by = defaultdict(int)
    for i in third:
        by[rows[i]["source"]] += size[i]
    total = sum(by.values())
    assert abs(sum(size[i] * n for i, n in mixed.items()) - total) < 0.02 * total
    codec = bpe_codec.Codec(wordbpe.default_path())
    for r in outs[4].limit(50).collect():
        assert memoryview(codec.encode_batch([rows[r["doc_id"]]["text"]])[0]).cast("I").tolist() == r["ids"]
    assert Counter(r["doc_id"] for r in outs[4].select("doc_id").collect()) == mixed


GOOD = " ".join(f"word{k} and plain{k} prose" for k in range(40)) + "."
HARD = [
    (1, GOOD, "en", "a", 9),
    (1, GOOD, "en", "a", 9),
    (2, None, None, "b", None),
    (None, GOOD.replace("word", "other"), "en", None, 9),
    (None, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", "b", 4),
    (5, GOOD.replace("word", "long") + " " + " ".join(f"tail{k}x{k * 7919 % 104729}" for k in range(30_000)), "en", "b", 9),
    (6, GOOD, "en", "c", 9),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with nulls in any column, empty and very long texts, repeated rows and columns of clashing names."""
    where = str(tmp_path_factory.mktemp("hard"))
    docs = spark.createDataFrame(HARD, COLUMNS)
    clashing = {c: F.lit("x") for c in ("id", "n", "sid", "size", "score", "kept", "label", "target", "taken", "token", "row", "place", "copies", "number", "__times", "__row", "__place", "__source", "words")}
    docs.withColumns(clashing).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, 1), (6, None, None), (None, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_on_hard_rows(spark, folder):
    """Each stage on the hard rows themselves: a defined result, all columns kept."""
    docs = table(spark, folder, "documents")
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    labels = table(spark, folder, "labels").limit(0)  # without labels only the base rules judge
    kept = quality_rules.kept_documents(docs, quality_rules.fit(docs, labels))
    assert kept.columns == docs.columns and ids(kept) == [(False, 1), (False, 1), (False, 5), (False, 6), (True, 0)]
    assert ids(quality_rank.kept_documents(docs, quality_rank.fit(docs, labels))) == ids(docs)
    single = corpus_pipeline.keep_one_of_each(spark, docs, folder)
    assert single.columns == docs.columns and ids(single) == [(False, k) for k in (1, 2, 3, 4, 5)] + [(True, 0), (True, 0)]
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns and not {2, 3, 4} & {i for _, i in ids(mixed)}
    encoded = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.encode(spark, docs, folder).collect() if r["doc_id"] in (2, 3, 4, 5)}
    assert encoded[2] == encoded[3] == encoded[4] == 0 < encoded[5]


@pytest.mark.parametrize("rows", ["hard", "none"])
def test_run_on_hard_rows(spark, folder, tmp_path, rows):
    where = folder
    if rows == "none":
        where = str(tmp_path)
        table(spark, folder, "documents").limit(0).write.parquet(f"{where}/documents.parquet")
        table(spark, folder, "labels").limit(0).write.parquet(f"{where}/labels.parquet")
    got = corpus_pipeline.run(spark, where).collect()
    assert {r["doc_id"] for r in got} <= {1, 5, None} and (rows == "hard" or not got)
    assert all(len(r["ids"]) == r["n_tokens"] > 0 for r in got)


def test_run_is_the_stages(spark):
    small = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, small)
    assert set(got.columns) == {"doc_id", "ids", "n_tokens"} and got.count() > 0
