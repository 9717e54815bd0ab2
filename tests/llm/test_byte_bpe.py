"""Byte-level BPE against the library, slices against the published pattern, decoding of whole texts and of passages."""

import hashlib
import random

import numpy as np
import pytest

from corvane.llm import byte_bpe

ODD = "'''  \n\t strevdlmSTaZ09é!?.\xa0　٣中\U0001f600́\0²Ⅷ"


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.default_path())


@pytest.fixture(scope="module")
def library(encoder):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def odd_texts(n, most=40, signs=ODD, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(most))) for _ in range(n)]


def ids_of(encoder, texts):
    ids, n, *_ = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


@pytest.mark.parametrize("signs", [ODD, "'  \nrvlestdmx1."])
def test_ids_are_the_librarys(encoder, library, signs):
    texts = odd_texts(4000, signs=signs)
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_every_kind_of_codepoint(encoder, library):
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    random.Random(2).shuffle(every)
    texts = ["".join(map(chr, every[k : k + 300])) for k in range(0, 60_000, 300)]
    assert ids_of(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_and_long_texts(encoder, library):
    texts = ["a" * 3000, " " * 2000, "'" * 999, "ab" * 5000, "the cat's hat " * 5000, None, ""]
    assert ids_of(encoder, texts) == [library.encode_ordinary(t or "") for t in texts]


def test_slices_do_not_depend_on_the_window(encoder):
    classes = encoder.classes[byte_bpe.codepoints("".join(odd_texts(200)) + "\0")]
    classes[-1] = byte_bpe.STOP
    whole = encoder.scanner.slices(classes)
    for window in (1, 2, 3, 7, 128, 129, 1000):
        assert (encoder.scanner.slices(classes, window) == whole).all()


def test_products_are_those_of_the_functions_one_by_one(encoder):
    scanner = encoder.scanner
    classes = np.random.default_rng(3).integers(0, 11, 1000)
    state, expected = byte_bpe.FRESH, []
    for k in classes:
        state, _ = byte_bpe.step(state, k)
        expected.append(state)
    assert scanner.result[scanner.prefixes(scanner.of_class[classes]), byte_bpe.FRESH].tolist() == expected


def test_a_small_memory_gives_the_same(library):
    small = byte_bpe.Encoder(byte_bpe.default_path(), remembered=50)
    for seed in range(5):
        texts = odd_texts(60, seed=seed)
        assert ids_of(small, texts) == [library.encode_ordinary(t) for t in texts]


def test_tables(spark, library):
    rows = [(1, "it's  so\n\nfine"), (2, None), (3, ""), (None, "x"), (1, "it's  so\n\nfine"), (4, "é" * 500)]
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, ids string, slice_at string")
    encoded = byte_bpe.encode(docs)
    assert encoded.columns == ["doc_id", "ids", "slice_at", "slice_ids"]
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in byte_bpe.decode(encoded).collect()), key=str)
    assert got == sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    for r in encoded.collect():
        assert sum(r.slice_ids) == len(r.ids) and len(r.slice_at) == len(r.slice_ids)
    assert byte_bpe.encode(docs.limit(0)).count() == 0


def test_foreign_ids_have_no_bytes(spark):
    rows = spark.createDataFrame([([0, None, 10**9, -4, 1],), (None,), ([],)], "ids array<int>")
    symbol = {r: s for s, r in byte_bpe.ranks_of(byte_bpe.default_path()).items()}
    assert [bytes(r.decoded) for r in byte_bpe.decode(rows).collect()] == [symbol[0] + symbol[1], b"", b""]


def test_passages_by_offsets(spark):
    text = "One day, it's raining  and\n\nwe'll 'see' 123 things."
    encoded = byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    edges = encoded.first().slice_at + [2000]  # the last slice counts as reaching on
    for first, end in ((0, 3), (4, 9), (0, len(text)), (20, 27), (len(text) - 1, 999), (999, 1000)):
        passage = byte_bpe.decode(byte_bpe.ids_between(encoded, first, end), "ids_between").first()
        assert bytes(passage.decoded).decode() == "".join(text[a:b] for a, b in zip(edges, edges[1:]) if a < end and b > first)


def test_query_digests(spark, library):
    import pyarrow.parquet as pq

    sf_dir = "/root/testdata/sf0.001"

    got = {r.doc_id: r for r in byte_bpe.query(spark, sf_dir).collect()}
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d["text"] or "").encode()).hexdigest()
