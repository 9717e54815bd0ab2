"""Surface statistics of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

from operator import eq

import numpy as np

from .common import WHITE

SYMBOLS = b"#*$%&|<>"
_MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))

#: The statistics that features() gives, in order.
FEATURES = ("log_words", "word_length", "symbol_share", "mark_share", "upper_share", "digit_share", "dup_line_share", "repeat_share", "same_next_share", "distinct_share", "bare_share", "shout_share", "long_word_share", "words_per_line")


def _without(raw: bytes, those: bytes) -> int:
    return len(raw) - len(raw.translate(None, those))


def repeat_words(words: list) -> int:
    """Words that lie in a three-word window which occurs twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    hit = bytearray(len(words))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[j : j + 3] = b"\x01\x01\x01"
            hit[i : i + 3] = b"\x01\x01\x01"
    return sum(hit)


def base(text: str | None) -> tuple[int, int, int, int, int, list, bytes, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then the words, the bytes and the lines with a word."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes are split at ASCII white space alone
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    chars = len(text) - sum(map(text.count, WHITE))
    return len(words), chars, _without(raw, SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), words, raw, len(lines)


def features(found: tuple) -> list[float]:
    """Shares between 0 and 1, the logarithm of the length, and lengths, from what base() found."""
    n, chars, symbols, dups, repeats, words, raw, lines = found
    w, c = max(n, 1), max(len(raw), 1)
    return [
        float(np.log1p(n)),
        chars / w,
        symbols / c,
        _without(raw, _MARKS) / c,
        _without(raw, _UPPER) / max(1, _without(raw, _UPPER + _LOWER)),
        _without(raw, _DIGITS) / c,
        dups / max(1, lines),
        repeats / w,
        sum(map(eq, words, words[1:])) / w,
        len(set(words)) / w,
        sum(1 for x in words if len(x) == 1 and not x.isalnum()) / w,
        raw.count(b"!!") / w,
        sum(1 for x in words if len(x) > 20) / w,
        n / max(1, lines),
    ]
