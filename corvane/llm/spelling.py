"""Spelling variants: near words by two-dimensional range reporting in wavelet trees, then forms and their roots.

Words that start alike lie in one interval of the forward order, words that end alike in one of the
reverse order (that of the words read backwards). A word with one edit at a known place is a point in
the rectangle of two such intervals; a wavelet tree over the orders reports the points of a rectangle.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import nothing_held, table, texts_of, uncollected, written

RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many loses a letter (by its checksum).
DIVISOR = 97
#: Places of an edit that share a block of candidates: what lies before and after them is equal in the whole block.
WIDTH = 3
#: The most such stretches of places in one word; those of longer words are wider.
MOST_STRETCHES = 16
#: Distinct words that a task counts before it hands them on; rows of candidates that share a wavelet tree.
COUNTED, TOGETHER = 400_000, 150_000
#: Bytes of a run up to which checksums are taken for all runs at once.
SHORT = 64
_ONES = 0xFFFFFFFF
_LAST = "\U0010ffff"
_LOWER = {c: c + 32 for c in range(65, 91)}


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


class Runs:
    """Counts of words. A run is looked up once for each time it occurs; its checksum with its document's id is
    made of two parts, as crc32 is linear: what the id's state becomes after as many bytes, and what the run adds."""

    find = staticmethod(re.compile(RUN).findall)

    def __init__(self, divisor: int, least_chars: int):
        self.divisor, self.least, self.table = divisor, least_chars, _crc_table()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.words: list[str] = []
        self.counts, self.crcs, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.changed: Counter[str] = Counter()

    def __len__(self) -> int:
        return len(self.words) + len(self.changed)

    def add(self, ids: list, texts: list[str | None]) -> None:
        runs, per_text = [], []
        for t in texts:
            own = self.find(t) if t else []
            runs += own
            per_text.append(len(own))
        if not runs:
            return
        place = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        if len(missing := np.flatnonzero(place < 0)):
            self._learn(dict.fromkeys(runs[k] for k in missing.tolist()))
            place[missing] = [self.known[runs[k]] for k in missing.tolist()]
        starts = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
        states = np.empty((SHORT + 1, len(ids)), np.uint32)
        states[0] = np.array(starts, np.uint32) ^ np.uint32(_ONES)
        for k in range(SHORT):
            states[k + 1] = self.table[states[k] & 255] ^ (states[k] >> np.uint32(8))
        of = np.repeat(np.arange(len(ids)), per_text)
        sizes = self.sizes[place]
        h = states[np.minimum(sizes, SHORT), of] ^ self.crcs[place]
        for k in np.flatnonzero(sizes > SHORT).tolist():
            h[k] = zlib.crc32(self.words[place[k]].encode(), starts[of[k]])
        hit = h % self.divisor == 0
        self.counts += np.bincount(place[~hit], minlength=len(self.counts))
        for p, x in zip(place[hit].tolist(), h[hit].tolist(), strict=True):
            w = self.words[p]
            at = x % len(w)
            self.changed[w[:at] + w[at + 1 :]] += 1

    def _learn(self, new: dict[str, None]) -> None:
        words = [w.lower() if w.isascii() else w.translate(_LOWER) for w in new]
        coded = [w.encode() for w in words]
        self.known.update(zip(new, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.words += words
        self.crcs = np.concatenate((self.crcs, np.array([zlib.crc32(b, _ONES) for b in coded], np.uint32)))
        self.sizes = np.concatenate((self.sizes, [len(b) for b in coded]))
        self.counts = np.concatenate((self.counts, np.zeros(len(words), np.int64)))

    def counted(self) -> pa.RecordBatch:
        """word, n of what has been counted, words of fewer code points than asked for left out; a word may come twice. Nothing stays."""
        n = self.counts.tolist()
        pairs = [(w, n[k]) for k, w in enumerate(self.words) if n[k] and len(w) >= self.least]
        pairs += [x for x in self.changed.items() if len(x[0]) >= self.least]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([k for _, k in pairs], pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_count: int = 3, divisor: int = DIVISOR) -> DataFrame:
    """word, n: lower-cased (A-Z only) runs of letters of every whole text, some with a letter less, as their checksums say.

    A task counts its own texts' words first; their sums are then shuffled by word. A null or empty
    text has none. A null id stands as the empty string before the colon. Repeated rows count again.
    Other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        nothing_held()
        runs = Runs(divisor, least_chars)
        for batch in batches:
            for at, texts in texts_of(batch):
                with uncollected():
                    runs.add(batch.column(0).slice(at, len(texts)).to_pylist(), texts)
                if len(runs) > COUNTED:
                    yield runs.counted()
        yield runs.counted()

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def candidates(words: DataFrame) -> DataFrame:
    """block, size, first, end, word, n, whole: the words under what is left of them outside each stretch of places of an edit.

    A word stands with those of its own length (whole: they differ in one place of first <= place < end)
    and with those longer by one (not whole: it lacks their letter there), so that words one edit apart
    meet in the block of the edit's place. A block of stretches of WIDTH places can't outgrow what WIDTH
    letters can spell, whatever the corpus; words over WIDTH * MOST_STRETCHES letters have wider ones.
    """
    own = F.length("word")

    def rows(size: Column, whole: bool) -> Column:
        stretches = F.least(F.lit(MOST_STRETCHES), F.ceil(size / F.lit(WIDTH))).cast("int")

        def row(k: Column) -> Column:
            first, end = (F.floor(x * size / stretches).cast("int") for x in (k, k + 1))
            after = F.substring(F.col("word"), end + (1 if whole else 0), size)
            block = F.xxhash64(size, k, F.substring(F.col("word"), F.lit(1), first), after)
            return F.struct(block.alias("block"), size.alias("size"), first.alias("first"), end.alias("end"), F.lit(whole).alias("whole"))

        return F.transform(F.sequence(F.lit(0), stretches - 1), row)

    both = F.concat(rows(own, True), rows(own + 1, False))
    return words.select("word", "n", F.explode(both).alias("c")).select("c.*", "word", "n")


class WaveletTree:
    """A sequence of distinct numbers below its length: for each bit from the highest, how many zeros stand before each place,
    the numbers being dealt anew, zeros first, after each bit."""

    def __init__(self, sequence: np.ndarray):
        self.bits = max(1, int(len(sequence) - 1).bit_length())
        self.zeros = []
        for bit in reversed(range(self.bits)):
            ones = (sequence >> bit) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - ones))))
            sequence = np.concatenate((sequence[ones == 0], sequence[ones == 1]))

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, number) for all numbers low <= number < high at places left <= place < right; all rectangles go down together."""
        which, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b, half = zeros[left], zeros[right], 1 << bit
            sides = []
            for l, r, v in ((a, b, value), (zeros[-1] + left - a, zeros[-1] + right - b, value + half)):
                on = np.flatnonzero((l < r) & (v < high[which]) & (v + half > low[which]))
                sides.append((l[on], r[on], v[on], which[on]))
            left, right, value, which = (np.concatenate(x) for x in zip(*sides, strict=True))
        return which, value


def near_pairs(groups: list[tuple[int, int, int, list[str], list[str]]]) -> list[tuple[str, str]]:
    """Pairs of near words of blocks: (size, first, end, whole words, words that lack a letter) each.

    Words of one length come as (word, near word), once from either side; of others the shorter one is
    the first, and pairs come once: where a letter is repeated, at the first place that it could have gone from.
    """
    forward, backward, sequence, asked, rects = [], [], [], [], []
    for size, first, end, whole, lacking in groups:
        base, ahead = len(forward), sorted(whole)
        behind = sorted(w[::-1] for w in whole)
        place = {w: k for k, w in enumerate(behind)}
        forward += ahead
        backward += behind
        sequence += [base + place[w[::-1]] for w in ahead]
        n = len(ahead)
        for words, skipped in ((ahead if n > 1 else (), 1), (lacking, 0)):
            for w in words:
                back, lo, hi = w[::-1], 0, n
                for p in range(first, end):
                    lo = bisect_left(ahead, w[:p], lo, hi)
                    hi = bisect_left(ahead, w[:p] + _LAST, lo, hi)
                    if hi - lo <= skipped:
                        break  # no word, or w alone, starts like this
                    tail = back[: size - 1 - p]
                    low = bisect_left(behind, tail)
                    high = bisect_left(behind, tail + _LAST, low)
                    if high - low > skipped:
                        asked.append((w, p, skipped))
                        rects.append((base + lo, base + hi, base + low, base + high))
    if not rects:
        return []
    which, found = WaveletTree(np.array(sequence, np.int64)).report(*np.array(rects, np.int64).T)
    pairs = []
    for k, v in zip(which.tolist(), found.tolist(), strict=True):
        (w, p, same_length), x = asked[k], backward[v][::-1]
        if (w != x) if same_length else (p == 0 or x[p - 1] != x[p]):
            pairs.append((w, x))
    return pairs


def _summed(blocks: list[dict], counts: dict[str, int]) -> pa.RecordBatch:
    """word, near (how many near words), less_n (minus the count of the one of largest count) and best (its text, the smallest) over some blocks."""
    groups = [(*at, whole, lacking) for parts in blocks for at, (whole, lacking) in parts.items() if whole and len(whole) + len(lacking) > 1]
    near: dict[str, list] = {}

    def note(w: str, x: str) -> None:
        mine = near.get(w)
        rank = (-counts[x], x)
        if mine is None:
            near[w] = [1, rank]
        else:
            mine[0] += 1
            mine[1] = min(mine[1], rank)

    with uncollected():
        for w, x in near_pairs(groups):
            note(w, x)
            if len(w) != len(x):
                note(x, w)
    columns = ([*near], pa.string()), ([m[0] for m in near.values()], pa.int64()), ([m[1][0] for m in near.values()], pa.int64()), ([m[1][1] for m in near.values()], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["word", "near", "less_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best, best_n: how many words one edit away each word has, and the one of them with the largest n (ties: the smallest).

    Candidates are dealt by block and sorted; a task takes blocks until it has TOGETHER rows, lays
    all their words into one wavelet tree, and adds up what it finds, so that no pair leaves it.
    """

    def run(batches):
        nothing_held()
        groups, counts, rows, last = [], {}, 0, None
        for batch in batches:
            for block, size, first, end, whole, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != last:
                    if rows >= TOGETHER:
                        yield _summed(groups, counts)
                        groups, counts, rows = [], {}, 0
                    last = block
                    parts: dict = {}
                    groups.append(parts)
                # a block is a hash: what shares it by chance is told apart here
                parts.setdefault((size, first, end), ([], []))[0 if whole else 1].append(word)
                counts[word] = n
                rows += 1
        yield _summed(groups, counts)

    dealt = candidates(words).repartition("block").sortWithinPartitions("block").select("block", "size", "first", "end", "whole", "word", "n")
    found = dealt.mapInArrow(run, "word string, near long, less_n long, best string")
    found = found.select("word", F.lit(None).cast("long").alias("n"), "near", F.struct("less_n", "best").alias("top"))
    none = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less_n: bigint, best: string>").alias("top"))
    every = none.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("top").alias("top"))
    return every.select("word", "n", "n_near", F.col("top.best").alias("best"), (-F.col("top.less_n")).alias("best_n"))


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the distinct words of a table (word, n); n is at least 1.

    The form is the near word of the largest n, if that is at least ratio times the word's own, else
    null; the root is where following forms ends. n grows by the ratio with each step, so chains are
    short, and following two steps at a time, then four, and so on ends after a few rounds, each a
    join of the words that have a form. Every table between is written to the shared folder.
    """
    words = words.select("word", "n")
    has = F.col("best_n") >= ratio * F.col("n")
    near = near_words(words).select("word", F.when(has, F.col("best")).alias("form"), "n", "n_near", F.when(has, F.col("best_n")).alias("form_n"))
    near = written(near, "near-words")
    most = near.agg(F.max("n")).first()[0] or 1
    longest = 1 + int(math.log(most, ratio))
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    for k in range(max(1, longest).bit_length()):
        links = written(_twice(links), f"spelling-roots-{k}")
    return near.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _twice(links: DataFrame) -> DataFrame:
    onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
    return links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(vocabulary(table(spark, sf_dir, "documents")), "vocabulary"))


_SQL = """
with recursive poly as (select list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b::bigint)) as t),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents where text is not null),
own as (select doc_id, w, count(*) as c, hex(encode(doc_id || ':' || w)) as x from runs group by doc_id, w),
sums as (select w, c, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::bigint), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295), 4294967295) as h from own, poly),
cut as (select case when h % 97 = 0 then w[1 : (h % length(w))::bigint] || w[(h % length(w))::bigint + 2 :] else w end as word, c from sums),
words as (select word, sum(c)::bigint as n from cut where length(word) >= 5 group by word having sum(c) >= 3),
gaps as (select word, n, unnest(range(1, length(word) + 1)) as p from words),
keys as (select distinct word, n, p, word[1 : p - 1] as a, word[p + 1 :] as b from gaps),
same as (select l.word, r.word as near, r.n as m from keys l join keys r on l.p = r.p and l.a = r.a and l.b = r.b and l.word <> r.word),
less as (select distinct k.word, k.n, w.word as near, w.n as m from keys k join words w on w.word = k.a || k.b),
pairs as (select word, near, m from same union all select word, near, m from less union all select near, word, n from less),
best as (select word, count(*) as n_near, max(m) as m from pairs group by word),
top as (select b.word, b.n_near, b.m, min(encode(p.near)) as near from best b join pairs p on p.word = b.word and p.m = b.m group by all),
formed as (select w.word, w.n, coalesce(t.n_near, 0) as n_near, case when t.m >= 2 * w.n then decode(t.near) end as form, case when t.m >= 2 * w.n then t.m end as form_n from words w left join top t using (word)),
follow as (select word, word as root from formed union all select f.word, g.form from follow f join formed g on g.word = f.root where g.form is not null),
roots as (select f.word, f.root from follow f join formed g on g.word = f.root where g.form is null)
select word, form, root, n, n_near, form_n from formed join roots using (word)
"""

QUERIES = {"op13_spelling_variants": query}
SQL: dict[str, str] = {"op13_spelling_variants": _SQL}
