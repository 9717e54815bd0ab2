"""Spelling variants against all pairs of words, counts against one run at a time, forms and roots against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts_of(rows, least_chars=5):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_chars:
                counts[w] += 1
    return counts


def expected(counts):
    out, form = {}, {}
    for w, n in counts.items():
        around = [x for x in counts if near(w, x)]
        best = min(around, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
        out[w] = [form[w], w, n, len(around), counts[best] if form[w] else None]
    for w in out:
        while form[out[w][1]]:
            out[w][1] = form[out[w][1]]
    return {w: tuple(x) for w, x in out.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_counts_against_one_run_at_a_time():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcXÉé×z") for _ in range(rng.choice([1, 3, 5, 7, 9, 40, 90])))
    rows = [(rng.randrange(10**12), " ".join(word() for _ in range(200))) for _ in range(60)] + [(None, "nobody knows it"), (5, None), (6, "")]
    runs, got = spelling.Runs(97, 5), Counter()
    for part in (rows[:20], rows[20:]):
        runs.add([r[0] for r in part], [r[1] for r in part])
    batch = runs.counted()
    for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
        got[w] += n
    assert got == counts_of(rows) and len(runs) == 0


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 100, 129):
        sequence = rng.permutation(n)
        tree = spelling.WaveletTree(sequence)
        rects = rng.integers(0, n + 1, (50, 4))
        which, value = tree.report(*rects.T)
        got = sorted(zip(which.tolist(), value.tolist()))
        assert got == sorted((k, v) for k, (a, b, c, d) in enumerate(rects.tolist()) for v in sequence[a:b].tolist() if c <= v < d)


@pytest.mark.parametrize("letters", ["ab", "abÀ", "abcdefgh"])
def test_near_words_against_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))): rng.randrange(1, 40) for _ in range(150)}
    counts |= {"a" * 60 + x + "b" * 20: n for x, n in (("", 9), ("a", 3), ("c", 20), ("cd", 2))}  # stretches wider than WIDTH
    words = spark.createDataFrame([*counts.items()], "word string, n long")
    assert found(spelling.variants(words)) == expected(counts)


def test_chains_end_at_their_roots(spark):
    word, n = "abcdefghij", 3
    counts = {word: n}
    for k in range(9):  # each word one letter from the last, twice as often
        word, n = word[:k] + "z" + word[k + 1 :], n * 2
        counts[word] = n
    got = found(spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got == expected(counts) and {r[1] for r in got.values()} == {word}


def test_ties_take_the_smallest_word(spark):
    counts = {"aaaaa": 2, "aaaab": 8, "aaaac": 8, "zaaaa": 8, "éaaaa": 8}
    got = found(spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got["aaaaa"] == ("aaaab", "aaaab", 2, 4, 8) and got["aaaab"][0] is None


def test_small_batches_and_memory_give_the_same(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 8))) for _ in range(120)]
    rows = [(k, " ".join(rng.choice(words).upper() for _ in range(80))) for k in range(40)]
    rows += rows[:3] + [(None, "Straße STRASSE straße straße"), (50, None), (51, ""), (52, "naïve " * 3000)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, word string").repartition(5)
    want = expected({w: n for w, n in counts_of(rows).items() if n >= 3})
    monkeypatch.setattr(spelling, "COUNTED", 50)
    monkeypatch.setattr(spelling, "TOGETHER", 20)
    assert found(spelling.variants(spelling.vocabulary(docs))) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(docs)).count() == 0
