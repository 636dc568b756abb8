"""Substring dedup: remove every word covered by a window of words that also starts earlier.

Documents are dealt into blocks of a few megabytes by a hash of the row. Three steps go over the
blocks, with two exchanges of small packed arrays between them:

1. Each block sketches its windows: per sketch row, the cells that its windows fall on and whether
   more than one does. Sketches are sparse and cut by cell range, so that merging them is spread over
   as many tasks as there are ranges, and the width follows the number of windows: the estimates
   are as sharp on 100 TB as on 1 GB. The merged count-min sketch never underestimates, so a window
   is repeated only if all its cells have counts above one; each block gets back one bit per cell.
2. Of windows estimated repeated, and only of these, each block sends the digest (96 bits) with the
   document of its first occurrence. Groups of equal digests are exact counts; the block that holds the
   earliest occurrence learns so, again by one bit per digest.
3. Each block removes what its later occurrences cover.

Blocks send a window once, however often it occurs in them, so a passage that a third of all documents
share is one entry per block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col
from .packed import pack, pack_bits, pack_sorted, unpack, unpack_bits, unpack_sorted

#: Bytes of text in a block: blocks grow with the root of the corpus, so that block-range pairs grow no faster than it.
LEAST_BLOCK, MOST_BLOCK, PER_PAIR = 4 << 20, 64 << 20, 16 << 10
#: Cells of each sketch row for each byte of text (a word and its gap are some 6 bytes).
CELLS_PER_BYTE = 2
DEPTH = 2
NO_ID = np.iinfo(np.int64).min
REMEMBERED = 300_000
#: Windows whose products are added up at a time.
AT_A_TIME = 1 << 14


class Digests(dict):
    """word -> its 128-bit digest."""

    def __missing__(self, word: bytes) -> bytes:
        d = xxhash.xxh3_128_digest(word)
        if len(self) < REMEMBERED:
            self[word] = d
        return d


class Block:
    """The documents of a block in the order in which windows count as earlier, and their windows."""

    def __init__(self, rows: pa.Table, window: int):
        ids = rows.column("id").combine_chunks().fill_null(NO_ID).to_numpy()
        tie = rows.column("tie").to_numpy()
        self.order = np.lexsort((tie, ids))
        self.ids, self.tie = ids[self.order], tie[self.order]
        texts = rows.column("text").combine_chunks()
        self.words = [(texts[i].as_py() or "").encode().split() for i in self.order]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        digests = Digests()
        both = np.frombuffer(b"".join(b"".join(map(digests.__getitem__, w)) for w in self.words), np.dtype("<u8")).reshape(-1, 2)
        per = np.maximum(0, self.sizes - window + 1)
        self.doc = np.repeat(np.arange(len(per)), per)
        self.at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + self.starts[self.doc] if per.sum() else np.zeros(0, np.int64)
        self.hashes = []
        for c in (0, 1):
            factors = np.random.default_rng(c + 1).integers(0, 2**63, window, np.uint64) * np.uint64(2) + np.uint64(1)
            total = window_sums(np.ascontiguousarray(both[:, c]), factors)[self.at]
            total ^= total >> np.uint64(32)
            self.hashes.append(total * np.uint64(0x9E3779B97F4A7C15))

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted different cells of a sketch row, and whether more than one window falls on each."""
        cells = np.sort(self.hashes[row] >> np.uint64(64 - bits))
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])[: len(cells)])
        return cells[first], np.diff(first, append=len(cells)) > 1

    def digests(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen windows: sorted different digests (64 and 32 bits), the first window of each
        among the chosen, and each chosen window's place among the digests."""
        high, low = self.hashes[0][of], self.hashes[1][of] >> np.uint64(32)
        order = np.lexsort((low, high))  # stable: equal digests stay in order of occurrence
        high, low = high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return high[new], low[new], order[new], place


def window_sums(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """At each place where all factors have a value: the sum of the products, some places at a time, so that they stay in cache."""
    out = np.zeros(max(0, len(values) - len(factors) + 1), np.uint64)
    for start in range(0, len(out), AT_A_TIME):
        part = out[start : start + AT_A_TIME]
        for k, factor in enumerate(factors):
            part += values[start + k : start + k + len(part)] * factor
    return out


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted known ones. Most are not, and a table of their leading bits tells so; the rest are looked up."""
    if not len(known):
        return np.zeros(len(values), bool)
    base, span = known[0], int(known[-1] - known[0])
    shift = np.uint64(max(0, span.bit_length() - max(10, (8 * len(known)).bit_length())))
    table = np.zeros((span >> int(shift)) + 1, bool)
    table[(known - base) >> shift] = True
    slot = (values - base) >> shift  # a smaller value comes around to a large one
    likely = np.flatnonzero(slot < np.uint64(len(table)))
    likely = likely[table[slot[likely]]]
    place = np.minimum(np.searchsorted(known, values[likely]), len(known) - 1)
    found = np.zeros(len(values), bool)
    found[likely] = known[place] == values[likely]
    return found


def _cut(values: np.ndarray, ranges: int) -> list[slice]:
    """Slices of sorted 64-bit values by equal ranges."""
    edges = np.searchsorted(values, np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64))
    return [slice(a, b) for a, b in zip([0, *edges], [*edges, len(values)])]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


SKETCH = pa.schema([("range", pa.int64()), ("depth", pa.int32()), ("block", pa.int64()), ("cells", pa.binary()), ("more", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("depth", pa.int32()), ("range", pa.int64()), ("flags", pa.binary())])
FIRSTS = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("doc", pa.binary()), ("ids", pa.binary()), ("ties", pa.binary())])
SKETCH_SQL, ANSWER_SQL = "range long, depth int, block long, cells binary, more binary", "block long, depth int, range long, flags binary"
FIRSTS_SQL = "range long, block long, high binary, low binary, doc binary, ids binary, ties binary"
RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])
RESULT_SQL = "id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string"


def _flags(answers: pa.Table, depth: int) -> np.ndarray:
    """The flags of all ranges of a depth, in order of range."""
    own = sorted((r["range"], r["flags"]) for r in answers.to_pylist() if r["depth"] == depth)
    return np.concatenate([np.zeros(0, bool), *(unpack_bits(f) for _, f in own)])


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, removed (runs [start, end) of words), kept_text.

    Words are what white space (0x20, 0x09-0x0D) separates. A window of ``window`` consecutive words whose
    sequence also starts earlier (smaller id, or same document and earlier start) loses all its words;
    windows are judged on the input. Kept words are joined by one space. Null and empty texts, and texts
    shorter than a window, keep everything. Ids are integers; a null id counts as smaller than any other.
    Rows of equal id are told apart by a hash of their text, and repeated rows follow one another: the
    first keeps what the others lose. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    size = min(MOST_BLOCK, max(LEAST_BLOCK, math.isqrt(total * PER_PAIR)))
    blocks = max(1, -(-total // size))
    bits = min(63, max(10, (CELLS_PER_BYTE * total).bit_length()))

    tie = F.xxhash64(text)
    dealt = docs.select(F.pmod(F.xxhash64(col(id_col), text), F.lit(blocks)).alias("block"), col(id_col).cast("long").alias("id"), tie.alias("tie"), text.alias("text"))

    def sketch(key: tuple, rows: pa.Table) -> pa.Table:
        block, out = Block(rows, window), []
        for d in range(DEPTH):
            cells, more = block.cells(d, bits)
            for r, part in enumerate(_cut(cells << np.uint64(64 - bits), blocks)):
                if part.start < part.stop:
                    out.append((r, d, key[0].as_py(), pack_sorted(cells[part]), pack_bits(more[part])))
        return _table(SKETCH, out)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.to_pylist()
        cells, more = [unpack_sorted(r["cells"]) for r in own], [unpack_bits(r["more"]) for r in own]
        values = np.concatenate(cells)
        own_cells = np.sort(values)
        shared = own_cells[1:][own_cells[1:] == own_cells[:-1]]
        repeated = among(values, np.unique(np.concatenate([shared, values[np.concatenate(more)]])))
        ends = np.cumsum([len(c) for c in cells])
        return _table(ANSWER, [(r["block"], r["depth"], r["range"], pack_bits(f)) for r, f in zip(own, np.split(repeated, ends[:-1]))])

    def suspects(block: Block, answers: pa.Table) -> np.ndarray:
        found = np.arange(len(block.at))
        for d in range(DEPTH):
            cells, _ = block.cells(d, bits)
            found = found[among(block.hashes[d][found] >> np.uint64(64 - bits), cells[_flags(answers, d)])]
        return found

    def first_seen(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block, out = Block(rows, window), []
        of = suspects(block, answers)
        high, low, first, _ = block.digests(of)
        doc = block.doc[of[first]]
        for r, part in enumerate(_cut(high, blocks)):
            if part.start < part.stop:
                docs_here, at = np.unique(doc[part], return_inverse=True)
                out.append((r, key[0].as_py(), pack_sorted(high[part]), pack(low[part]), pack(at), *(pack(x[docs_here].view(np.uint64)) for x in (block.ids, block.tie))))
        return _table(FIRSTS, out)

    def earliest(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.to_pylist()
        high, low, doc = (([f(r[c]) for r in own]) for c, f in (("high", unpack_sorted), ("low", unpack), ("doc", unpack)))
        ids, ties = (np.concatenate([unpack(r[c]).view(np.int64)[d.astype(np.int64)] for r, d in zip(own, doc)]) for c in ("ids", "ties"))
        ends = np.cumsum([len(h) for h in high])
        high, low = np.concatenate(high), np.concatenate(low)
        order = np.lexsort((ties, ids, low, high))
        first = np.ones(len(order), bool)
        first[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        won = np.empty(len(order), bool)
        won[order] = first
        return _table(ANSWER, [(r["block"], DEPTH, r["range"], pack_bits(f)) for r, f in zip(own, np.split(won, ends[:-1]))])

    def cleaned(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows, window)
        of = suspects(block, answers)
        _, _, first, place = block.digests(of)
        stays = np.zeros(len(of), bool)
        stays[first] = _flags(answers, DEPTH)
        gone = block.at[of[~stays]]
        n = int(block.sizes.sum())
        removed = np.cumsum(np.bincount(gone, minlength=n + 1) - np.bincount(gone + window, minlength=n + 1))[:n] > 0
        out = []
        for i, words in enumerate(block.words):
            lost = removed[block.starts[i] : block.starts[i] + len(words)]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
            runs, kept, at = [], [], 0
            for a, b in edges.reshape(-1, 2).tolist():
                runs.append({"start": a, "end": b})
                kept += words[at:a]
                at = b
            kept += words[at:]
            ident = int(block.ids[i])
            out.append((None if ident == NO_ID else ident, len(words), int(lost.sum()), runs, b" ".join(kept).decode()))
        return _table(RESULT, out)

    grouped = dealt.groupBy("block")
    answers = grouped.applyInArrow(sketch, SKETCH_SQL).groupBy("range", "depth").applyInArrow(merge, ANSWER_SQL)
    firsts = grouped.cogroup(answers.groupBy("block")).applyInArrow(first_seen, FIRSTS_SQL)
    verdicts = firsts.groupBy("range").applyInArrow(earliest, ANSWER_SQL)
    result = grouped.cogroup(answers.unionByName(verdicts).groupBy("block")).applyInArrow(cleaned, RESULT_SQL)
    return result.withColumnRenamed("id", id_col)
