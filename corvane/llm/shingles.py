"""Word shingles of whole texts as 64-bit tokens, worked out for many texts at once in numpy.

The upper six bits of a token are smaller for longer shingles, the others are a hash. Long shingles
are rare ones, so tokens in ascending order stand with the rare ones first, without any counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed on its own.
SLICE_BYTES = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply): spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix((_LOWER.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """_P ** k and its inverse modulo 2 ** 64, for k below what was asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=_U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, SLICE_BYTES)
            up, down = np.full(n, _P, dtype=_U), np.full(n, pow(_P, -1, 1 << 64), dtype=_U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        return self.up, self.down


_powers = _Powers()


def token(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tokens of shingles with these hashes and bytes of words."""
    return ((63 - np.minimum(size, 63)).astype(_U) << _U(58)) | (hashes >> _U(6))


def word_hashes(raw: np.ndarray, starts: np.ndarray, between: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and bytes of all words (A-Z lower-cased) in raw, and each text's number of words.

    starts: where texts begin, then the end. between: which bytes stand between words.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), np.zeros(len(starts) - 1, dtype=np.int64)
    blank = between[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    begins = ~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1])
    ends = ~blank & (np.concatenate([blank[1:], [True]]) | edge[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _powers.of(n)
    total = np.cumsum(_VALUE[raw] * up[:n], dtype=_U)
    before = np.where(first > 0, total[first - 1], _U(0))
    words = mix((total[last] - before) * down[first] + (last - first + 1).astype(_U))
    return words, last - first + 1, np.diff(np.searchsorted(first, starts))


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, starts) of consecutive texts, about SLICE_BYTES at once; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = [len(s.as_buffer()) if s.is_valid else 0 for s in texts]
    at = 0
    while at < len(sizes):
        stop, held = at, 0
        while stop < len(sizes) and (stop == at or held + sizes[stop] <= SLICE_BYTES):
            held += sizes[stop]
            stop += 1
        raw = np.frombuffer(b"".join(s.as_buffer().to_pybytes() for s in texts[at:stop] if s.is_valid), dtype=np.uint8)
        yield raw, np.concatenate([[0], np.cumsum(sizes[at:stop])]).astype(np.int64)
        at = stop


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle tokens of each text; none without a word, one of all words below `words` words."""
    factors = [_U(pow(_P, 2 * k + 3, 1 << 64) & _MASK) for k in range(words)]
    for raw, starts in slices(texts):
        hashes, lengths, counts = word_hashes(raw, starts)
        rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=_U)
        for k in range(words):
            rolled += hashes[k : k + len(rolled)] * factors[k]
        reach = np.concatenate([[0], np.cumsum(lengths)])
        rolled = token(mix(rolled), reach[words:] - reach[:-words] if len(rolled) else np.zeros(0, dtype=np.int64))
        i = 0
        for c in counts.tolist():
            if c >= words:
                yield np.unique(rolled[i : i + c - words + 1])
            elif c:
                own = np.array([sum(int(h) * int(f) for h, f in zip(hashes[i : i + c], factors, strict=False)) + c & _MASK], dtype=_U)
                yield token(mix(own), lengths[i : i + c].sum(keepdims=True))
            else:
                yield np.zeros(0, dtype=_U)
            i += c
