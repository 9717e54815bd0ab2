"""Both tokenizer operators against the tokenizers library."""

import random
from array import array

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import bpe_codec, token_counts, wordbpe

PATH = wordbpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)
COUNTER, CODEC = token_counts.Counter(PATH, 5000), bpe_codec.Codec(PATH, 5000)


def check(texts):
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    got = [array("I", raw).tolist() for raw in CODEC.encode_batch(texts)]
    assert got == want
    assert [COUNTER.count(t) for t in texts] == [len(w) for w in want]
    assert [CODEC.decode(g) for g in got] == [LIBRARY.decode(w, skip_special_tokens=False) for w in want]


def test_documents(spark, tables):
    texts = [r["text"] for r in tables.documents.where("text is not null").collect()]
    for at in range(0, len(texts), 64):
        check(texts[at : at + 64])


def test_hard_texts():
    check(["a\x1cb c\x1d \x85 d​e ᠎ f", "ΑΣ Σσς", "<|endoftext|>a<|startoftext|> <|x|> <|EndOfText|>", "'S 's't ''s I'LL they're", "a" * 5000, "İstanbul ǅ ﬁ é ȫ", "", " ", "x" * 300, "12345 ٣٤ ½ Ⅷ 漢字"])


def test_every_character_of_the_base_plane():
    signs = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(signs), 4096):
        check([f"a{c}B {c}1," for c in signs[at : at + 4096]])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_any_text(texts):
    check(texts)


def test_long_unbroken_word():
    """A word of 150,000 letters, whole: work grows with its length alone."""
    rng = random.Random(2)
    check(["".join(rng.choices("etaoinshrdlu", k=150_000)), "ab" * 60_000])


def test_merges_left_is_the_heap_method():
    rng = random.Random(5)
    for _ in range(500):
        word = "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 30)))
        assert token_counts.merges_left(CODEC.v.symbols(word), CODEC.v.ranks) == len(CODEC.merged(CODEC.v.symbols(word)))


def test_round_trip_through_tables(spark, tables):
    docs = tables.documents.limit(40)
    encoded = bpe_codec.encode(docs)
    texts = {r["doc_id"]: r["text"] for r in bpe_codec.decode(encoded).collect()}
    assert texts == {r["doc_id"]: CODEC.decode(r["ids"]) for r in encoded.collect()}


def test_decoding_skips_foreign_ids():
    codec = bpe_codec.Codec(wordbpe.default_path())
    library = Tokenizer.from_file(wordbpe.default_path())
    ids = library.encode("Hello wide world", add_special_tokens=False).ids
    assert codec.decode([10**6, *ids, 49_408, 77_777]) == library.decode([10**6, *ids, 49_408, 77_777], skip_special_tokens=False) == codec.decode(ids)
    assert codec.decode([None, *ids, -1]) == codec.decode(ids) and codec.decode([]) == ""
