"""Every operator: nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing columns."""

import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import bm25, bpe_codec, jaccard_join, license_scan, mixing, quality_rank, quality_rules, token_counts, toxicity, training, warc

LONG = "word " * 60_000 + "Released under the MIT License."
ROWS = [
    (1, "the same text twice in a row here", "a"),
    (1, "the same text twice in a row here", "a"),
    (2, None, "b"),
    (None, "a text without an id", None),
    (None, None, None),
    (3, "", "a"),
    (4, " \n\t ", "b"),
    (5, LONG, "b"),
    (6, "naïve Ünïcode 漢字 😀 <|endoftext|> ok", "c"),
    (50, "the same text twice in a row here", "a"),
]
SCHEMA = "doc_id long, text string, source string"
LABELS = [(1, 1, 0), (1, 0, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (2, None, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    # Extra columns with the names that operators use themselves.
    return df.withColumns({c: F.lit("x") for c in ("id", "n", "sid", "size", "score", "kept", "label", "target", "taken", "token", "h", "rank", "__size", "payload_bytes", "words")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def models(docs, labels):
    return {
        "op1": lambda d: toxicity.score(d, toxicity.fit(docs, labels)),
        "op2": bpe_codec.round_trip,
        "op3": lambda d: quality_rank.score(d, quality_rank.fit(docs, labels)),
        "op4": mixing.mix,
        "op5": jaccard_join.jaccard_components,
        "op7": lambda d: quality_rules.apply_rules(d, quality_rules.fit(docs, labels)),
        "op9": token_counts.count_tokens,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op9"])
def test_a_row_for_each_row(spark, docs, labels, name):
    got = models(docs, labels)[name](docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, *_ in ROWS)


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op9"])
def test_empty_table(spark, docs, labels, name):
    assert models(docs, labels)[name](docs.limit(0)).collect() == []


def test_no_labels(docs, labels):
    none = labels.limit(0)
    assert all(0 <= r["p_toxic"] <= 1 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    assert all(r["predicted"] == 1 for r in quality_rank.score(docs, quality_rank.fit(docs, none)).collect())
    assert all(r["kept"] == (not r["base_failed"]) for r in quality_rules.apply_rules(docs, quality_rules.fit(docs, none)).collect())


def test_labelled_sample_is_bounded(spark):
    """One document for each sampled id, however many repeat it; held_out is never null."""
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(300)] + [(None, "x"), (0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)] * 2 + [(None, 1)], "doc_id long, quality int")
    rows = training.labelled(docs, labels, "quality", 2).collect()
    free = [i for i in range(3) if zlib.crc32(str(i).encode()) % 5]
    assert len(rows) == min(2, len(free)) and len({r["id"] for r in rows}) == len(rows)
    assert training.labelled(docs, labels, "quality", 1).count() == 1
    assert all(r["held_out"] is not None for r in quality_rank.score(docs, quality_rank.fit(docs, labels)).collect())


def test_decoding_edges(spark):
    got = bpe_codec.decode(spark.createDataFrame([(1, None), (2, []), (None, [0, 49407])], "doc_id long, ids array<int>")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: None, 2: "", None: "! <|endoftext|>"}


def test_empty_texts(docs):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs).collect() if r["doc_id"] in (2, 3, 4)}
    assert {k: (r["n_bytes"], r["n_tokens"]) for k, r in got.items()} == {2: (0, 0), 3: (0, 0), 4: (4, 0)}
    sets = {r["doc_id"]: r for r in jaccard_join.jaccard_components(docs).collect() if r["doc_id"] in (2, 3, 4)}
    assert all(r["n_shingles"] == 0 and r["component_id"] == k for k, r in sets.items())


def test_components_of_repeats(docs):
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()]
    assert got.count((1, 1)) == 2 and (50, 1) in got


def test_one_of_each(spark, docs):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 50 not in ids and {2, 3, 4, 5, 6} <= set(ids) and ids.count(None) == 2
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_mixed_documents(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert not {2, 3, 4} & {r["doc_id"] for r in mixed.collect()}


def test_license_edges(spark, docs):
    got = license_scan.scan(docs).collect()
    assert [(r["doc_id"], r["license"], r["exact"]) for r in got] == [(5, "MIT", True)]
    assert license_scan.scan(docs.limit(0)).count() == 0
    named = license_scan.scan(docs.withColumn("doc_id", F.concat(F.lit("d%"), "doc_id"))).collect()
    assert [r["doc_id"] for r in named] == ["d%5"]
    assert license_scan.scan(docs, templates={}).count() == 0


def test_search_edges(spark, docs):
    got = bm25.search(docs, docs.where("doc_id = 50 or doc_id in (2, 3) or doc_id is null")).collect()
    assert {r["query_id"] for r in got} == {50}
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])][:3] == [1, 1, 50]
    assert bm25.search(docs, docs.limit(0)).count() == 0
    assert bm25.search(docs.limit(0), docs).count() == 0


def test_warc_edges(spark, tmp_path):
    long = "<p>" + "x" * 300_000
    rows = [(3, "http://a\r\nX: y", long), (1, None, long), (2, "http://b", None), (None, "http://c", long), (4, "http://d", "short"), (5, "", "short"), (1, None, long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit(1))
    path = str(tmp_path / "warc")
    warc.write(pages, path)
    got = [(r["row_id"], r["record_type"], r["refers_to"], r["bytes"], r["uri"], r["payload"]) for r in warc.resolve(warc.read(spark, path)).collect()]
    body = bytearray(long.encode())
    assert sorted((g[0] or "", g[1], g[2]) for g in got) == [("", "revisit", "1"), ("1", "response", None), ("1", "response", None), ("2", "response", None), ("3", "revisit", "1"), ("4", "response", None), ("5", "response", None)]
    assert all(g[5] == body and g[3] == len(body) for g in got if g[0] in (None, "1", "3"))
    assert [g[4] for g in got if g[0] == "3"] == ["http://a\r\nX: y"]
    for names in (["a%b", "null", None, "a\r\nb", "Z", ""], ["7", "6", "5", "4", "3", None]):
        rows = [(i, f"http://x/{i}", long) for i in names] + [(i, "http://y", "short") for i in names]
        path = str(tmp_path / f"text{len(names[0])}")
        warc.write(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
        got = [(r["row_id"], r["record_type"], r["refers_to"], r["bytes"]) for r in warc.resolve(warc.read(spark, path)).collect()]
        least = min(i for i in names if i is not None)
        want = [(i, "response" if i == least else "revisit", None if i == least else least, len(body)) for i in names] + [(i, "response", None, 5) for i in names]
        order = lambda r: tuple((x is None, x or "") for x in r[:3]) + (r[3],)
        assert sorted(got, key=order) == sorted(want, key=order)
    empty = str(tmp_path / "none")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0
