"""Byte-level BPE: slices by scans of transition functions over codepoint classes, cached pair merging, decoding by offsets.

No regular expression finds a boundary. Every codepoint has a class, every class a function from the
states of a small automaton to its states, and such functions compose associatively: prefix products
taken block by block give all states of a batch of texts at once, and with them the slices.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import chain, islice, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import held, nothing_held, table, texts_of, uncollected

#: Distinct slices that a worker remembers, besides those of the texts at hand.
REMEMBERED = 300_000
#: Characters that are scanned together; a longer text is scanned in pieces of this length, the state carried along.
WINDOW = 1 << 21
#: Functions that are composed one after the other in a block; blocks go side by side.
BLOCK = 128
#: Bytes of a short piece; above all ranks.
SHORT, NEVER = 40, 1 << 40

# Classes of codepoints. LETTER_E to LETTER_1 are the letters that may follow an apostrophe.
LETTER, LETTER_1, LETTER_RV, LETTER_E, LETTER_L, NUMBER, SIGN, APOSTROPHE, SPACE, WHITE, STOP = range(11)
# States: what stands before the next character. SPACE_1 and WHITE_1: one white character so far; SPACE_2 and WHITE_2: more.
FRESH, LETTERS, NUMBERS, SIGNS, QUOTE, QUOTE_RV, QUOTE_L, SPACE_1, WHITE_1, SPACE_2, WHITE_2 = range(11)
#: A slice starts at this character; one starts at the character before it.
HERE, BEFORE = 1, 2


def step(state: int, kind: int) -> tuple[int, int]:
    """The next state, and where slices start, known now that this character has been seen."""
    starts = 0
    if state in (QUOTE_RV, QUOTE_L):
        if (state, kind) in ((QUOTE_RV, LETTER_E), (QUOTE_L, LETTER_L)):
            return FRESH, 0
        state, starts = LETTERS, BEFORE  # the apostrophe stood for itself
    if kind == STOP:
        return FRESH, starts
    if kind in (SPACE, WHITE):
        if state in (SPACE_1, WHITE_1, SPACE_2, WHITE_2):
            return (SPACE_2 if kind == SPACE else WHITE_2), starts
        return (SPACE_1 if kind == SPACE else WHITE_1), starts | HERE
    if state in (SPACE_2, WHITE_2):  # the last white character is left to what follows
        state, starts = (SPACE_1 if state == SPACE_2 else WHITE_1), starts | BEFORE
    if kind == NUMBER:
        return NUMBERS, starts | (0 if state in (NUMBERS, SPACE_1) else HERE)
    if kind in (SIGN, APOSTROPHE):
        if state in (SIGNS, QUOTE, SPACE_1):
            return SIGNS, starts
        return (QUOTE if kind == APOSTROPHE else SIGNS), starts | HERE
    if state == QUOTE and kind in (LETTER_1, LETTER_RV, LETTER_L):
        return {LETTER_1: FRESH, LETTER_RV: QUOTE_RV, LETTER_L: QUOTE_L}[kind], starts
    return LETTERS, starts | (0 if state in (LETTERS, SPACE_1) else HERE)


class Scanner:
    """The automaton's functions, closed under composition, as tables that numpy looks things up in."""

    def __init__(self):
        kinds, states = range(11), range(11)
        self.starts = np.array([[step(s, k)[1] for k in kinds] for s in states], np.uint8)
        letters = [tuple(step(s, k)[0] for s in states) for k in kinds]
        every = [tuple(states)]
        found = {every[0]: 0}
        for f in every:  # grows as it is walked
            for g in letters:
                if (both := tuple(g[x] for x in f)) not in found:
                    found[both] = len(every)
                    every.append(both)
        self.size = len(every)
        #: Element of each class; result of each element in each state; product of two elements (first one, then the other).
        self.of_class = np.array([found[f] for f in letters], np.uint16)
        self.result = np.array(every, np.uint8)
        self.product = np.array([[found[tuple(g[x] for x in f)] for g in every] for f in every], np.uint16).ravel()

    def prefixes(self, elements: np.ndarray) -> np.ndarray:
        """Products of the first 1, 2, ... elements: inside blocks side by side, then over the blocks' products, by the same means."""
        n = len(elements)
        width = min(BLOCK, n)
        padded = np.zeros(-(-n // max(width, 1)) * width, np.uint16)
        padded[:n] = elements
        blocks = np.ascontiguousarray(padded.reshape(-1, width).T) if n else padded.reshape(0, 0)
        for k in range(1, width):
            blocks[k] = self.product[blocks[k - 1].astype(np.int32) * self.size + blocks[k]]
        if n > width:
            before = np.zeros(blocks.shape[1], np.int32)
            before[1:] = self.prefixes(blocks[-1])[:-1]
            blocks = self.product[before * self.size + blocks]
        return blocks.T.ravel()[:n]

    def slices(self, classes: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Places where a slice starts. The array ends with STOP, as does each text in it."""
        cut = np.zeros(len(classes), bool)
        state = FRESH
        for at in range(0, len(classes), window):
            part = classes[at : at + window]
            states = self.result[self.prefixes(self.of_class[part]), state]
            marks = self.starts[np.concatenate(([state], states[:-1])).astype(np.uint8), part]
            cut[at : at + len(part)] |= (marks & HERE).astype(bool)
            late = np.flatnonzero(marks & BEFORE) + at - 1
            cut[late] = True
            state = int(states[-1])
        return np.flatnonzero(cut)


def class_table() -> np.ndarray:
    """The class of each codepoint. Which are letters, numbers and white space is asked of the tokenizer library, so that its Unicode version holds."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    kinds = np.full(0x110000, SIGN, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        own = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        kinds[codepoints(bytes(own.encode_ordinary(every)).decode())] = kind
    for kind, signs in ((LETTER_1, "stmd"), (LETTER_RV, "rv"), (LETTER_E, "e"), (LETTER_L, "l"), (APOSTROPHE, "'"), (SPACE, " ")):
        kinds[codepoints(signs)] = kind
    return kinds


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: neighbours of the lowest rank are joined, the leftmost first, until none is left to join.

    Short pieces keep the ranks of neighbours in a list. In long ones ends[i] is where the symbol that
    starts at i ends, 0 once it is part of another; an entry of the heap says (rank, start, end) of two
    neighbours, and where they no longer are, it is passed over.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        at, pairs = [*range(n + 1)], [ranks.get(piece[i : i + 2], NEVER) for i in range(n - 1)]
        while pairs and (low := min(pairs)) < NEVER:
            k = pairs.index(low)
            del at[k + 1], pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(piece[at[k] : at[k + 2]], NEVER)
            if k:
                pairs[k - 1] = ranks.get(piece[at[k - 1] : at[k + 1]], NEVER)
        return [ranks[piece[a:b]] for a, b in pairwise(at)]
    ends, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heappush(heap, (r, p, end))
    return [ranks[piece[i:end]] for i, end in enumerate(ends) if end]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def ranks_of(path: str) -> dict[bytes, int]:
    from base64 import b64decode

    with open(path, "rb") as f:
        return {b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.ranks = ranks_of(path)
        self.classes, self.scanner = class_table(), Scanner()
        self.most = remembered
        self._forget()

    def _forget(self) -> None:
        #: Slice -> its place, under which `spans` says where its ids lie in `ids`: first one and number.
        self.places: dict[str, int] = {}
        self.spans, self.ids = np.empty((2, 0), np.int64), np.empty(0, np.int32)

    def bundles(self, texts: list[str]):
        """Neighbouring texts of WINDOW characters together, or one longer text."""
        some, size = [], 0
        for t in texts:
            if some and size + len(t) > WINDOW:
                yield some
                some, size = [], 0
            some.append(t)
            size += len(t)
        if some:
            yield some

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the character offsets where its slices start."""
        classes = self.classes[codepoints("\0".join(texts) + "\0")]
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        classes[stops] = STOP
        at = self.scanner.slices(classes)
        begins = np.concatenate(([0], stops[:-1] + 1))
        edges = np.searchsorted(at, np.concatenate((begins, [len(classes)])))
        return [at[a:b] - t for a, b, t in zip(edges[:-1], edges[1:], begins, strict=True)]

    def encode(self, texts: list[str | None]):
        """Flat ids of all texts and how many each has; flat slice offsets, each slice's number of ids, and how many slices each text has."""
        texts = [t or "" for t in texts]
        ids, at, per_slice, n_slices, n_ids = [], [], [], [], []
        for bundle in self.bundles(texts):
            starts = self.starts(bundle)
            parts: list[str] = []
            for text, own in zip(bundle, starts, strict=True):
                edges = own.tolist()
                parts += [text[a:b] for a, b in zip(edges, [*edges[1:], len(text)], strict=True)] if edges else []
            places = self._places(parts)
            first, count = self.spans[:, places]
            ends = np.cumsum(count)
            into = np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
            ids.append(self.ids[into])
            at += starts
            per_slice.append(count)
            n_slices += map(len, starts)
            upto = np.concatenate(([0], ends))[np.cumsum([0, *map(len, starts)])]
            n_ids += np.diff(upto).tolist()
        flat = lambda x: np.concatenate(x).astype(np.int32) if x else np.empty(0, np.int32)
        return flat(ids), n_ids, flat(at), flat(per_slice), n_slices

    def _places(self, parts: list[str]) -> np.ndarray:
        places = self._known(parts)
        missing = np.flatnonzero(places < 0)
        if not len(missing):
            return places
        new = list(dict.fromkeys(parts[k] for k in missing.tolist()))
        if len(self.places) + len(new) > self.most and self.places:
            self._halve()
            places = self._known(parts)
            missing = np.flatnonzero(places < 0)
            new = list(dict.fromkeys(parts[k] for k in missing.tolist()))
        ranks = self.ranks
        got = [merged(p.encode(), ranks) for p in new]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        first = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(got), np.int32, int(counts.sum()))))
        self.spans = np.concatenate((self.spans, [first, counts]), axis=1)
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
        places[missing] = self._known([parts[k] for k in missing.tolist()])
        return places

    def _known(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.places.get, parts, repeat(-1)), np.int64, len(parts))

    def _halve(self) -> None:
        """Keeps the slices that came first, the common ones mostly."""
        n = min(self.most // 2, len(self.places))
        self.places = dict(islice(self.places.items(), n))
        self.spans = self.spans[:, :n].copy()
        self.ids = self.ids[: int(self.spans[:, -1].sum()) if n else 0].copy()


class Decoder:
    """Bytes of ids by one gather from all symbols laid end to end; ids that the vocabulary lacks have no bytes."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        symbols = [b""] * (max(ranks.values(), default=-1) + 2)
        for s, r in ranks.items():
            symbols[r] = s
        self.size = np.array([len(s) for s in symbols], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(symbols), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those of each id end."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, len(self.size) - 1)
        size = self.size[ids]
        ends = np.cumsum(size)
        into = np.repeat(self.first[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.bytes[into], ends


def _lists(flat: np.ndarray, counts: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat))


def _bytes_of(own: Decoder, ids: np.ndarray, counts) -> pa.Array:
    """The bytes of each list of ids, the lists being laid end to end."""
    data, ends = own.decode(ids)
    edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, decoded: str | None = None) -> DataFrame:
    """Every whole text as ids: id, ids array<int>, slice_at array<int>, slice_ids array<int>.

    slice_at has the character offset of each slice (each stretch that is merged by itself), slice_ids
    how many ids it has. A null or empty text has none of either. Special strings are ordinary text.
    Null ids, repeated rows and ties pass through: a row out for each row in. Other columns are not
    read, so their names don't matter; an empty table gives an empty one. Long texts are scanned in
    pieces, their slices are the same as if they weren't. tokenizer is the rank file's path on the
    executors; None stands for the installed public file. decoded: the name of a further column, with
    the bytes that the ids decode to, made in the same task.
    """
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    numbers = ArrayType(IntegerType(), True)
    out = StructType([StructField("__id", slim.schema["__id"].dataType), *(StructField(n, numbers) for n in ("ids", "slice_at", "slice_ids")), *([StructField(decoded, BinaryType())] if decoded else [])])

    def run(batches):
        path = tokenizer or default_path()
        own, back = held(f"byte codec {path}", lambda: (Encoder(path), Decoder(path)))
        for batch in batches:
            for k, texts in texts_of(batch):
                with uncollected():
                    ids, n_ids, at, per_slice, n_slices = own.encode(texts)
                arrays = [batch.column(0).slice(k, len(texts)), _lists(ids, n_ids), _lists(at, n_slices), _lists(per_slice, n_slices)]
                if decoded:
                    arrays.append(_bytes_of(back, ids, n_ids))
                yield pa.RecordBatch.from_arrays(arrays, out.names)

    return slim.mapInArrow(run, out).withColumnRenamed("__id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", to: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """encoded with the bytes of its ids in a binary column, whose name must be new.

    Null and empty arrays decode to nothing; nulls in an array and ids that the vocabulary lacks have no bytes.
    """
    at, before = encoded.columns.index(ids_col), encoded.schema
    out = StructType([*before.fields, StructField(to, BinaryType())])

    def run(batches):
        nothing_held()
        own = Decoder(tokenizer or default_path())
        for batch in batches:
            lists = batch.column(at)
            counts = np.array(lists.value_lengths().fill_null(0))
            column = _bytes_of(own, np.asarray(lists.flatten().fill_null(-1)), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], out.names)

    return encoded.mapInArrow(run, out)


def ids_between(encoded: DataFrame, first: int, end: int, to: str = "ids_between") -> DataFrame:
    """encoded with the ids of the slices that overlap the characters first (from 0) up to end: what decode needs for a passage.

    Slices are found by the offsets that encode retained; the passage's ids may reach beyond it to whole slices,
    and the last slice counts as reaching on past the text's end.
    """
    ends = F.transform("slice_at", lambda x, k: F.coalesce(F.try_element_at("slice_at", k + 2), F.lit(2**31 - 1)))
    hits = F.transform(F.arrays_zip(F.col("slice_at").alias("a"), ends.alias("b"), F.col("slice_ids").alias("n")), lambda s: (s["a"] < end) & (s["b"] > first))
    total = lambda c, keep: F.aggregate(F.arrays_zip(F.col(c).alias("n"), hits.alias("h")), F.lit(0), lambda acc, s: acc + F.when(keep(s["h"]), s["n"]).otherwise(0))
    skipped = F.aggregate(F.slice("slice_ids", 1, F.greatest(F.array_position(hits, True).cast("int") - 1, F.lit(0))), F.lit(0), lambda acc, n: acc + n)
    return encoded.withColumn(to, F.slice("ids", skipped + 1, total("slice_ids", lambda h: h)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode(table(spark, sf_dir, "documents"), decoded="decoded")
    digests = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256), F.sha2(F.col("decoded"), 256)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digests[0].alias("ids_sha256"), digests[1].alias("decoded_sha256"))


QUERIES = {"op12_byte_bpe": query}
SQL: dict[str, str] = {}
