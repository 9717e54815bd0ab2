"""The lower-casing word BPE vocabulary: its file, its normalisation, its pieces.

Merging itself is left to the two operators that use this module, each by its own method.
White space separates what is merged, so a text is split into chunks first and every distinct
chunk is worked out once for as long as a worker remembers it.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import islice

from .common import FORGET

END = "</w>"
#: str.split() also splits at these, the tokenizer does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The pattern that splits texts, for characters up to U+00FF, which have one normal form and are lower-cased one by one.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\s\x1c-\x1fa-zªµºß-öø-ÿ0-9²³¹¼-¾]+|[\x1c-\x1f]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: pair of symbols -> rank of their merge
        self.ranks: dict[tuple[str, str], int] = {m: r for r, m in enumerate(merges)}
        self.longest = max(len(s.removesuffix(END)) for s in self.ids)
        #: The sign that stands for each byte in the vocabulary.
        self.byte_signs = {b: self.splitter.pre_tokenize_str(c)[0][0][k] for c, k, b in _bytes_in_text()}
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def chunks(self, text: str) -> list[str]:
        """The text's stretches without white space, special strings on their own."""
        if "<" in text and self._special.search(text):
            out, at = [], 0
            for m in self._special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if any(c in text for c in _SEPARATORS):
            return [x for x in _WHITE.split(text) if x]
        return text.split()

    def pieces(self, chunk: str) -> list[str]:
        """What merges work on: byte characters of each stretch of letters, digit or other signs, without the end mark."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1] in ",." and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
            if chunk.isprintable():
                return _LATIN.findall(chunk.lower())
        elif chunk.isalpha() and max(chunk) <= "\xff":
            return [chunk.lower().encode().decode("latin-1").translate(self.byte_signs)]
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    @staticmethod
    def symbols(piece: str) -> list[str]:
        return [*piece[:-1], piece[-1] + END]


def _bytes_in_text():
    """(character, place among its bytes, byte) for the bytes that letters from U+0080 to U+00FF are made of."""
    for c in map(chr, range(0xA1, 0x100)):
        for k, b in enumerate(c.encode()):
            yield c, k, b


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


FORGET.append(vocabulary.cache_clear)


class Memory(dict):
    """What a worker remembers, at most `most` entries. When it is full the older half stays: common words come early."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def room(self, n: int) -> bool:
        """Makes room for n entries; whether any had to go."""
        if len(self) + n <= self.most:
            return False
        kept = list(islice(self.items(), max(0, min(self.most // 2, self.most - n))))
        self.clear()
        self.update(kept)
        return True
