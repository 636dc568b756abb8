"""Byte-level BPE by rank files: texts to ids and back, as column expressions.

Every match of the pattern is a pre-token. Two tiers find its ids. A minimal perfect hash of the vocabulary answers
for those that are tokens as they stand: one place in a table for each key, and the key found there is compared. The
others are merged from their bytes: a heap holds the ranks of neighbouring pairs, a list links the bytes that are left,
and the lowest rank, of equals the leftmost, is merged first.

Only the vocabulary is sent to tasks. It is read on the driver, once, and its size is checked.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .tokenizing import together

#: The largest vocabulary that is broadcast: tokens, and their bytes together.
MOST_TOKENS, MOST_BYTES = 1 << 20, 64 << 20
#: Pre-tokens remembered by a worker in each of two generations, the longest of them in characters, and those taken from a text at a time.
REMEMBERED, LONGEST, PIECES = 150_000, 48, 200_000
#: Keys for each displacement of the perfect hash.
KEYS_PER_BUCKET = 4
_NOWHERE = -1


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a rank file: on each line a token in base 64 and its rank. Ranks are 0 to n - 1."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines))))
    tokens = [token for _, token in ranked]
    if [rank for rank, _ in ranked] != list(range(len(tokens))) or len(set(tokens)) != len(tokens):
        raise ValueError("ranks have to be 0 to n - 1, of different tokens")
    if len(tokens) > MOST_TOKENS or sum(map(len, tokens)) > MOST_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every task")
    return tokens


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, moved: np.ndarray, n: int) -> np.ndarray:
    """Where hashes land in a table of n places under their displacements."""
    x = hashes ^ (moved.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """n keys on n places. Keys are dealt to buckets, and each bucket has the displacement that takes all its keys to free
    places; large buckets choose first. A bucket of one key names its place itself: -1 - place."""

    moved: np.ndarray
    key_at: np.ndarray

    @classmethod
    def of(cls, keys: list[bytes]) -> PerfectHash:
        n = len(keys)
        hashes = _hashes(keys)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys have one hash")
        buckets = -(-n // KEYS_PER_BUCKET)
        of_key = (hashes >> np.uint64(20)) % np.uint64(max(buckets, 1))
        order = np.argsort(of_key, kind="stable")
        starts = np.searchsorted(of_key[order], np.arange(buckets + 1, dtype=np.uint64))
        moved, key_at, sizes = np.zeros(buckets, np.int64), np.full(n, _NOWHERE), np.diff(starts)
        tries = np.arange(64)
        for b in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes > 1)]:
            own, first = order[starts[b] : starts[b + 1]], 0
            while True:
                spots = _places(hashes[own][None, :], (first + tries)[:, None], n)
                in_order = np.sort(spots, axis=1)
                fits = (key_at[spots] == _NOWHERE).all(axis=1) & (in_order[:, 1:] != in_order[:, :-1]).all(axis=1)
                if fits.any():
                    break
                first += len(tries)
            moved[b] = first + int(fits.argmax())
            key_at[spots[fits.argmax()]] = own
        alone = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(key_at == _NOWHERE)
        moved[alone], key_at[free] = -1 - free, order[starts[alone]]
        return cls(moved, key_at)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each key the only number of a stored key that it can be."""
        n = len(self.key_at)
        hashes = _hashes(keys)
        moved = self.moved[((hashes >> np.uint64(20)) % np.uint64(len(self.moved))).astype(np.int64)]
        return self.key_at[np.where(moved < 0, -1 - moved, _places(hashes, np.maximum(moved, 0), n))]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, in one worker."""

    def __init__(self, tokens: list[bytes], found: PerfectHash, pattern: str, remembered: int = REMEMBERED):
        self.tokens, self.found, self.remembered = tokens, found, remembered
        self.pattern = regex.compile(pattern)
        if self.pattern.groups:
            raise ValueError("the pattern has to be without groups of its own")
        self.single = [_NOWHERE] * 256
        for rank, token in enumerate(tokens):
            if len(token) == 1:
                self.single[token[0]] = rank
        rank_of = {token: rank for rank, token in enumerate(tokens)}
        #: For each left token, the rank of what it makes with a right one.
        self.pairs: list[dict[int, int]] = [{} for _ in tokens]
        for rank, token in enumerate(tokens):
            for cut in range(1, len(token)):
                if (left := rank_of.get(token[:cut])) is not None and (right := rank_of.get(token[cut:])) is not None:
                    self.pairs[left][right] = rank
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: merges by lowest rank, then from the left."""
        ids = [self.single[b] for b in piece]
        if _NOWHERE in ids:
            raise ValueError("the vocabulary lacks a byte of the text")
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(rank, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := pairs[a].get(b)) is not None]
        heapify(waiting)
        while waiting:
            rank, i = heappop(waiting)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs[ids[i]].get(ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, _NOWHERE
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (right := pairs[rank].get(ids[k])) is not None:
                    heappush(waiting, (right, i))
            if h >= 0 and (left := pairs[ids[h]].get(rank)) is not None:
                heappush(waiting, (left, h))
        return [x for x in ids if x >= 0]

    def _learn(self, pieces: list[str]) -> None:
        keys = [p.encode() for p in pieces]
        for piece, key, rank in zip(pieces, keys, self.found.candidates(keys).tolist()):
            ids = (rank,) if self.tokens[rank] == key else self.merged(key)
            self.young[piece] = b"".join(x.to_bytes(4, "little") for x in ids)

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        new = []
        for piece in set(chain.from_iterable(split)).difference(self.young):
            if piece in self.old:
                self.young[piece] = self.old[piece]
            else:
                new.append(piece)
        if new:
            self._learn(new)
        out = [b"".join(map(self.young.__getitem__, own)) for own in split]
        for piece in new:
            if len(piece) > LONGEST:
                del self.young[piece]
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of a group of texts; a text with very many pre-tokens is taken part by part."""
        if len(texts) > 1:
            return self._joined(list(map(self.pattern.findall, texts)))
        matches = (m.group() for m in self.pattern.finditer(texts[0]))
        return [b"".join(self._joined([part])[0] for part in iter(lambda: list(islice(matches, PIECES)), []))]


_LOADED: dict[tuple, Encoder] = {}


class ByteBPE:
    """A vocabulary at hand in every task.

    ``encode`` gives the ids (array<int>) of a text, the same as the tiktoken library with this pattern and these ranks and
    without special tokens; null and empty texts have none. ``decode`` gives the bytes (binary) that ids stand for; null stays
    null, and an id that the vocabulary does not have is an error. Both are expressions over one column: other columns,
    repeated rows and ties do not matter, and an empty table stays empty.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens = read_ranks(path)
        shared = spark.sparkContext.broadcast((tokens, PerfectHash.of(tokens)))  # bounded by MOST_TOKENS and MOST_BYTES

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if (path, pattern) not in _LOADED:
                _LOADED[path, pattern] = Encoder(*shared.value, pattern)
            encoder = _LOADED[path, pattern]
            for column in batches:
                ids = [x for texts in together(column) for x in encoder.texts(texts)]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = shared.value[0]
            for column in batches:
                values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                if len(values) and not 0 <= values.min() <= values.max() < len(known):
                    raise ValueError("an id is not in the vocabulary")
                null = column.is_null().to_pylist()
                yield pa.array([None if gone else b"".join(map(known.__getitem__, values[a:b].tolist())) for a, b, gone in zip(at, at[1:], null)], pa.binary())

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)
