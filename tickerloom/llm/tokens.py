"""Encoding of texts with a public byte-level BPE vocabulary, through a cache of encoded words."""

from __future__ import annotations

import os
import re

import numpy as np

from .common import ragged

#: Words a worker keeps; beyond it only those met more than once stay.
CACHE_WORDS = 800_000
#: Words and characters of words that a worker keeps where other operators share its executor's memory.
SMALL_CACHE = (200_000, 8_000_000)
END_ID = 0
# White space of the vocabulary's splitting rule, and its one special token.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPECIAL = "<|endoftext|>"
LETTERS, MARKS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", ".,;:!?|*#%$&<>()"
#: Parts of a text that the rule never joins: a plain word, plain marks, else a whole run without white space, each with one
#: leading space at most; white space runs leave their last character to what follows.
PIECES = re.compile(
    f" ?[{LETTERS}]+(?=[{SPACE}{MARKS}]|\\Z)| ?[{MARKS}]+(?=[{SPACE}{LETTERS}]|\\Z)"
    f"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
).findall
#: The id of a line feed, which stands between words that are encoded in one call.
LINE_FEED_ID = 198


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Codes(dict):
    """Numbers words in order of arrival."""

    def __init__(self):
        self.new = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of whole texts; the library encodes each distinct word once."""

    def __init__(self, path: str, words: int = CACHE_WORDS, characters: int | None = None):
        self.words, self.characters = words, characters
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.codes = _Codes()
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(0, np.int64)
        self.held = 0

    def _trim(self) -> None:
        """Keep the words met more than once, unless they alone fill the cache."""
        old, starts, sizes, flat = self.codes, self.starts, self.sizes, self.flat
        kept = np.flatnonzero(self.hits[: len(old)] > 1)
        kept = kept if len(kept) <= self.words // 2 else kept[:0]
        again = set(kept.tolist())
        words = [w for w, i in old.items() if i in again]
        held = sum(map(len, words))
        if self.characters is not None and held > self.characters // 2:
            kept, words, held = kept[:0], [], 0
        self.clear()
        self.held = held
        self.codes.update(zip(words, range(len(words))))
        self.flat = np.append(flat[ragged(starts[kept], sizes[kept])], np.zeros(1 << 16, np.int32))
        self.used = len(self.flat) - (1 << 16)
        self.starts, self.sizes = np.cumsum(sizes[kept]) - sizes[kept], sizes[kept]
        self.starts, self.sizes = (np.append(a, np.zeros(1 << 14, np.int64)) for a in (self.starts, self.sizes))
        self.hits = np.zeros(len(words), np.int64)

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        if not new:
            return
        self.held += sum(map(len, new))
        plain = np.fromiter((not w.isspace() and "\n" not in w and SPECIAL not in w for w in new), bool, len(new))
        ids = [None] * len(new)
        if plain.any():
            where = np.flatnonzero(plain)
            lines = ["\n".join([new[i] for i in where[k : k + 4096]]) for k in range(0, len(where), 4096)]
            whole = np.concatenate([np.append(np.asarray(self.library.encode(x, add_special_tokens=False).ids, np.int32), LINE_FEED_ID)
                                    for x in lines])
            cuts = np.flatnonzero(whole == LINE_FEED_ID)
            for i, part in zip(where, np.split(whole, cuts + 1)):
                ids[i] = part[:-1]
        for i in np.flatnonzero(~plain):
            ids[i] = np.asarray(self.library.encode(new[i], add_special_tokens=False).ids, np.int32)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total, first, last = int(sizes.sum()), len(self.codes) - len(new), len(self.codes)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.sizes[first:last] = sizes
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, texts: list[str | None], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (each closed by ``end``) and how many each has. A null text is empty."""
        if len(self.codes) > self.words or self.characters is not None and self.held > self.characters:
            self._trim()
        number, counts, codes = self.codes.__getitem__, [], []
        for text in texts:
            before = len(codes)
            if text:
                pieces = [text] if SPECIAL in text else PIECES(text)
                codes += map(number, pieces)
            counts.append(len(codes) - before)
        self._learn()
        at = np.asarray(codes, np.int64)
        seen = np.bincount(at, minlength=len(self.hits))
        seen[: len(self.hits)] += self.hits
        self.hits = seen
        sizes = self.sizes[at]
        ids = self.flat[ragged(self.starts[at], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        lengths = np.diff(ends, prepend=0)
        if end is not None:
            ids = np.insert(ids, ends, end)
            lengths = lengths + 1
        return ids, lengths


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, words: int = CACHE_WORDS, characters: int | None = None) -> Encoder:
    """This worker's encoder of a vocabulary file, with a cache of so many words and characters of words at most."""
    key = path, words, characters
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
