"""BPE encoding by a depth-first walk over a trie of distinct words, and decoding.

In byte-pair encoding every prefix of an encoding is the encoding of its own text, so a prefix's
encoding is known from its last token alone: before that token stands the encoding of the shorter
prefix. A token may follow another exactly when merging the symbols of the two gives back the two.
The walk keeps the last token of each prefix on the current path; words that share a prefix share
the work for it.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbpe
from .common import held, per_text, table

#: Distinct chunks, and pairs of tokens, that a worker remembers.
REMEMBERED = 400_000
PAIRS = 400_000


class Codec:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.v = wordbpe.vocabulary(path)
        self.seen = wordbpe.Memory(remembered)
        self.pieces = wordbpe.Memory(remembered // 2)
        self.pairs = wordbpe.Memory(PAIRS)
        self.raw = {i: array("I", [i]).tobytes() for i in self.v.strings}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging, lowest rank first and leftmost among equals; used on one or two tokens' symbols."""
        parts, ranks = list(symbols), self.v.ranks
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: str, token: str, pair: int) -> bool:
        """Whether token stands after left (nothing: "") in the encoding of their joined text; remembered as pair."""
        self.pairs.room(1)
        body, end = token.removesuffix(wordbpe.END), token.endswith(wordbpe.END)
        symbols = [*left, *(self.v.symbols(body) if end else body)]
        fits = self.pairs[pair] = self.merged(symbols) == ([left, token] if left else [token])
        return fits

    def encode_words(self, words) -> dict[str, bytes]:
        """Each word's ids as bytes; prefixes that words share are worked out once.

        Sorted words enter the trie in its depth-first order: a word's path begins with what it shares
        with the word before, and only the path at hand is kept. A node's state is the last token
        (and its id) of the encoding of the node's prefix.
        """
        out: dict[str, bytes] = {}
        get, known, may_follow, raw = self.v.ids.get, self.pairs.get, self.may_follow, self.raw
        longest, end = self.v.longest, wordbpe.END
        path = ""
        ends, last = [""], [0]
        for word in sorted(words):
            n = len(word)
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del ends[shared + 1 :], last[shared + 1 :]
            path = word
            for stop in range(len(ends), n):
                for at in range(stop - longest if stop > longest else 0, stop):
                    token = word[at:stop]
                    i = get(token)
                    if i is not None:
                        pair = last[at] << 33 | i
                        if not at:
                            pair |= 1 << 32
                        fits = known(pair)
                        if fits is None:
                            fits = may_follow(ends[at], token, pair)
                        if fits:
                            ends.append(token)
                            last.append(i)
                            break
                else:
                    raise ValueError(f"no token ends {word[:stop]!r}")
            for at in range(n - longest if n > longest else 0, n):
                token = word[at:] + end
                i = get(token)
                if i is not None:
                    pair = last[at] << 33 | i
                    if not at:
                        pair |= 1 << 32
                    fits = known(pair)
                    if fits is None:
                        fits = may_follow(ends[at], token, pair)
                    if fits:
                        break
            else:
                raise ValueError(f"no token ends {word!r}")
            found = [raw[i]]
            while at:
                found.append(raw[last[at]])
                at -= len(ends[at])
            found.reverse()
            out[word] = b"".join(found)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks that aren't remembered: their new pieces go through a trie."""
        special, known, cut, seen = self.v.special, self.pieces, self.v.pieces, self.seen
        pieces = {c: cut(c) for c in chunks if c not in special}
        words = {p for ps in pieces.values() for p in ps}
        new = [p for p in words if p not in known]
        if known.room(len(new)):
            new = [p for p in words if p not in known]
        known.update(self.encode_words(new))
        for c, own in pieces.items():
            seen[c] = known[own[0]] if len(own) == 1 else b"".join([known[p] for p in own])
        for c in chunks & special.keys():
            seen[c] = self.raw[special[c]]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit unsigned integers in the machine's order."""
        cut = [self.v.chunks(t) if t else [] for t in texts]
        every = set().union(*cut)
        seen = self.seen
        if new := {c for c in every if c not in seen}:
            if seen.room(len(new)):
                new = {c for c in every if c not in seen}
            self.learn(new)
        return [b"".join(map(seen.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids) -> str:
        """The tokens' strings with a space between them, special ones included: the vocabulary names no decoder. Nulls and ids that it lacks are skipped."""
        return " ".join(s for i in ids if (s := self.v.strings.get(i)) is not None)


def _make(tokenizer: str | None) -> Codec:
    """The worker's codec: what it remembers serves all its tasks."""
    path = tokenizer or wordbpe.default_path()
    return held(f"codec {path}", lambda: Codec(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Every whole text's token ids: id, ids array<int>, n_tokens long.

    A null or empty text has no ids (an empty array). A row out for each row in: null ids, repeated
    rows and ties pass through; other columns are not read. tokenizer is the vocabulary file's
    path on the executors; None stands for the installed public file.
    """

    def make():
        codec = _make(tokenizer)

        def work(texts):
            out = []
            for raw in codec.encode_batch(texts):
                ids = array("I", raw)
                out.append((ids.tolist(), len(ids)))
            return out

        return work

    return per_text(docs, id_col, text_col, "ids array<int>, n_tokens long", make, keeps=True)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Each row's ids as text: id, text. Null ids give a null text, no ids an empty one."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    slim = encoded.select(F.col(id_col).alias("__id"), F.col(ids_col).cast("array<int>").alias("__ids"))

    def run(batches):
        codec = _make(tokenizer)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__id", "text"])

    return slim.mapInArrow(run, StructType([slim.schema["__id"], StructField("text", StringType())])).withColumnRenamed("__id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text and keeps digests: id, n_tokens, ids_sha256 (of the ids as
    little-endian 32-bit integers), decoded_sha256 (of the decoded text in UTF-8). Rows as in encode()."""

    def make():
        import sys

        codec = _make(tokenizer)

        def work(texts):
            out = []
            for raw in codec.encode_batch(texts):
                ids = array("I", raw)
                decoded = codec.decode(ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            return out

        return work

    return per_text(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, keeps=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op2_bpe_codec": query}
SQL: dict[str, str] = {}
