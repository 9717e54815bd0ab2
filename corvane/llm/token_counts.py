"""Token counts by byte-pair merging over a heap and a linked list, without identifiers."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordbpe
from .common import held, per_text, table

#: Distinct chunks that a worker remembers.
REMEMBERED = 600_000


def merges_left(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that remain after all merges: the initial number minus the merges made.

    Live symbols form a doubly linked list; the heap holds (rank, position, right neighbour's symbol)
    of mergeable neighbours. An entry that no longer matches its position's pair is stale.
    """
    n = len(symbols)
    if n < 2:
        return n
    text: list[str | None] = list(symbols)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        rank, i = heappop(heap)
        left = text[i]
        j = after[i]
        if left is None or j < 0 or ranks.get((left, text[j])) != rank:
            continue
        merges += 1
        joined = left + text[j]
        text[i], text[j] = joined, None
        k = after[j]
        after[i] = k
        if k >= 0:
            before[k] = i
            if (r := ranks.get((joined, text[k]))) is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get((text[h], joined))) is not None:
            heappush(heap, (r, h))
    return n - merges


class Counter:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.v = wordbpe.vocabulary(path)
        self.seen = wordbpe.Memory(remembered)
        self.words = wordbpe.Memory(remembered // 2)

    def chunk(self, chunk: str) -> int:
        if chunk in self.v.special:
            return 1
        total = 0
        words = self.words
        for piece in self.v.pieces(chunk):
            n = words.get(piece)
            if n is None:
                words.room(1)
                n = words[piece] = merges_left(self.v.symbols(piece), self.v.ranks)
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        chunks = self.v.chunks(text)
        seen = self.seen
        if new := {c for c in chunks if c not in seen}:
            if seen.room(len(new)):
                new = {c for c in chunks if c not in seen}
            for c in new:
                seen[c] = self.chunk(c)
        return sum(map(seen.__getitem__, chunks))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Null ids, repeated rows and ties pass through:
    a row out for each row in. Other columns are not read, so their names don't matter. tokenizer
    is the vocabulary file's path on the executors; None stands for the installed public file.
    """

    def make():
        path = tokenizer or wordbpe.default_path()
        own = held(f"counter {path}", lambda: Counter(path))  # serves all the worker's tasks
        return lambda texts: [(len(t.encode()) if t else 0, n := own.count(t), n > limit) for t in texts]

    return per_text(docs, id_col, text_col, "n_bytes long, n_tokens long, over_limit boolean", make, keeps=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).select(F.col("doc_id"), "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op9_token_counts": query}
SQL: dict[str, str] = {}
