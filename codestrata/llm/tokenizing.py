"""Tokenizing whole texts with a tokenizer file, word by word, with a bounded memory of words.

The tokenizer's pre-tokenizer drops white space and never joins across it, so a text's ids are the
ids of its white-space separated words, one after another. It lower-cases, and parts letters from
punctuation, so a word that is new only by its case or by marks after a letter needs no
encoding. A new stem of ASCII letters goes to the tokenizer's model at once; other new stems are
encoded many at a time, parted again by the ids that end a word.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a worker in each of two generations, and the longest of them in bytes: some 80 MB at most.
REMEMBERED, LONGEST = 250_000, 64
#: Bytes of text that are tokenized together.
TOGETHER = 3 << 20
#: Stems encoded at a time.
STEMS = 20_000
MARKS = string.punctuation.encode()


def parts(word: bytes) -> tuple[bytes, bytes]:
    """A word's stem and the marks after it, if any. Special tokens match before lower-casing."""
    if b"<|" in word:
        return word, b""
    stem = word.rstrip(MARKS)
    if stem[-1:].isalpha():
        return stem.lower(), word[len(stem) :]
    return word.lower(), b""


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers.

    When the young generation of words is full it becomes the old one, and old words that are met
    again move to the new young one: frequent words stay. Of new words only the stems are encoded.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.model = self.tokenizer.model
        self.plain = all(self._plain(w) == self._whole(w) for w in (b"a", b"word", b"unforeseeably", b"qzxjvkq"))
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        split = [t.encode().split() for t in texts]
        words = set(chain.from_iterable(split))
        new = []
        for word in words.difference(self.young):
            if word in self.old:
                self.young[word] = self.old[word]
            else:
                new.append(word)
        self._learn(new)
        out = [b"".join(map(self.young.__getitem__, own)) for own in split]
        for word in new:
            if len(word) > LONGEST:
                del self.young[word]
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        return out

    def _learn(self, words: list[bytes]) -> None:
        parted = list(map(parts, words))
        stems = set(chain.from_iterable(parted))
        ids = {s: table[s] for table in (self.old, self.young) for s in stems.intersection(table)} | {b"": b""}
        stems = list(stems - ids.keys())
        for at in range(0, len(stems), STEMS):
            some = stems[at : at + STEMS]
            ids.update(zip(some, self._encoded(some)))
        for word, (stem, mark) in zip(words, parted):
            self.young[word] = ids[stem] + ids[mark]

    def _plain(self, stem: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(stem.decode())]).tobytes()

    def _whole(self, stem: bytes) -> bytes:
        return array("I", self.tokenizer.encode(stem.decode(), add_special_tokens=False).ids).tobytes()

    def _encoded(self, stems: list[bytes]) -> list[bytes]:
        """Ids of lower-case stems; those that are letters throughout are encoded together."""
        found = {s: self._plain(s) for s in stems if s.isalpha()} if self.plain else {}
        letters = [s for s in stems if s not in found and s.decode().isalpha()]
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(letters).decode()], add_special_tokens=False)[0].ids, np.dtype("<u4"))
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(letters):
                raw = ids.tobytes()
                found.update((s, raw[4 * a : 4 * b]) for s, a, b in zip(letters, [0, *stops], stops))
        return [found[s] if s in found else self._whole(s) for s in stems]


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    """One per worker process and file."""
    if path not in _LOADED or _LOADED[path].remembered != remembered:
        _LOADED[path] = WordIds(path, remembered)
    return _LOADED[path]


def together(column: pa.Array, most: int = TOGETHER) -> Iterator[list[str]]:
    """The texts of a column, null as empty, in groups of some megabytes or of one longer text: only a group is in
    Python at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
        end = max(end, at + 1)
        yield [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end
