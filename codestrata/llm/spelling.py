"""Spelling variants: words one edit apart, and the frequent form that each rare one goes back to.

Words that differ by one inserted, deleted or replaced letter still do after their letters are reduced to a few
symbols, or become equal. So every word gives the keys of all reduced words within one edit of its own, and words of
the reduced vocabulary with such a key are candidates; the words themselves decide. A key is the reduced word read
as a number (modulo 2^64, with its length), so a neighbour's key follows from sums over prefixes and suffixes, and a key
takes eight bytes however long the word is. Words with equal keys by chance are told apart like other candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, given_back, written

#: Fixed value of the text contract: letters of a run.
RUN = "[A-Za-zÀ-ÿ]+"
#: Keys are made so many at a time, and longer words than this are left out of the rows of keys and looked up afterwards.
TOGETHER, LONG = 1 << 18, 64
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words_of(docs: DataFrame, one_in: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: lower-cased (A-Z) runs of letters of all texts and how often they occur, with deletions planted by rule.

    h is the unsigned crc32 of ``<id>:<run>``; where ``one_in`` divides it, the run loses its letter number h modulo its
    length. Null texts have no runs, a null id counts as empty. A run may vanish: the empty word is counted like others.
    """
    run = F.explode(F.regexp_extract_all(ascii_lower(col(text_col)), F.lit(RUN), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), run)
    h, size = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.length("run")
    at = (F.col("h") % size).cast("int")
    word = F.when(F.col("h") % one_in == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _reduced(words: list[str], symbols: int) -> np.ndarray:
    """Symbols 1 to ``symbols`` of words of one length, a row for each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    return (points % symbols + 1).astype(np.uint64)


def _sums(digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base; values of all prefixes, and of all suffixes."""
    n, size = digits.shape
    power = np.ones(size + 2, np.uint64)
    power[1:] = np.cumprod(np.full(size + 1, BASE), dtype=np.uint64)
    # Digit i has weight power[i], so prefixes need no shift; a suffix is moved by multiplying.
    prefix, weighted = np.zeros((n, size + 1), np.uint64), digits * power[:size]
    np.cumsum(weighted, axis=1, out=prefix[:, 1:])
    return power, prefix, prefix[:, -1:] - prefix


def _with_length(value: np.ndarray, size: int) -> np.ndarray:
    x = value ^ (np.uint64(size) << np.uint64(56))
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def own_keys(words: list[str], symbols: int) -> np.ndarray:
    """Keys of the reduced forms of words of one length."""
    _, prefix, _ = _sums(_reduced(words, symbols))
    return _with_length(prefix[:, -1], prefix.shape[1] - 1)


def neighbour_keys(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, keys) of all reduced words within one edit of the words' own; words of one length."""
    digits = _reduced(words, symbols)
    size, letters = digits.shape[1], np.arange(1, symbols + 1, dtype=np.uint64)
    power, prefix, suffix = _sums(digits)
    # A short word's keys come together, each once; a long one's come part by part.
    step = size + 1 if size <= LONG else max(1, TOGETHER // (len(words) * (2 * symbols + 1)))
    for first in range(0, size + 1, step):
        at = np.arange(first, min(first + step, size + 1))
        inside = at[at < size]
        removed = _with_length(prefix[:, inside] + suffix[:, inside + 1] * _INVERSE, size - 1)
        replaced = _with_length((prefix[:, inside] + suffix[:, inside + 1])[:, :, None] + (power[inside][:, None] * letters)[None], size)
        added = _with_length((prefix[:, at] + suffix[:, at] * BASE)[:, :, None] + (power[at][:, None] * letters)[None], size + 1)
        keys = np.sort(np.concatenate([removed, replaced.reshape(len(words), -1), added.reshape(len(words), -1)], axis=1), axis=1)
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        yield np.nonzero(new)[0], keys[new]


def _keyed(words: DataFrame, symbols: int, near: bool) -> DataFrame:
    """id, word, key: the keys of the words' neighbourhoods, or of themselves. Short words come without an id, long ones without
    their letters: each key's row is to be small."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                block = max(1, TOGETHER // ((int(size) + 1) * (2 * symbols + 1)))
                for a in range(0, len(own), block):
                    some = own[a : a + block]
                    of = [texts[k] for k in some]
                    for at, keys in neighbour_keys(of, symbols) if near else [(np.arange(len(of)), own_keys(of, symbols))]:
                        taken, short = batch.take(pa.array(some[at])), size <= LONG
                        word = taken.column("word") if short else pa.nulls(len(at), pa.string())
                        ids = pa.nulls(len(at), pa.int64()) if short else taken.column("id")
                        yield pa.RecordBatch.from_arrays([ids, word, pa.array(keys.view(np.int64))], names=["id", "word", "key"])
        given_back()

    return words.select("id", "word").mapInArrow(rows, "id long, word string, key long")


def near_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """word, near: every two different words one edit apart, both ways. words: id, word, the words distinct."""
    left, right = _keyed(words, symbols, True), _keyed(words, symbols, False).select(F.col("id").alias("near_id"), F.col("word").alias("near"), "key")
    met = left.join(right, "key").drop("key")
    one = F.levenshtein(F.col("word"), F.col("near"), 1) == 1
    short = met.filter("word IS NOT NULL AND near IS NOT NULL").filter(one).select("word", "near")
    # Long words fetch their letters once they have met. Their keys come in parts, so a pair may meet twice.
    long = met.filter("word IS NULL OR near IS NULL").distinct()
    for c, text in (("id", "word"), ("near_id", "near")):
        long = long.join(words.select(F.col("id").alias(c), F.col("word").alias("letters")), c, "left").withColumn(text, F.coalesce(text, "letters")).drop("letters")
    return short.unionByName(long.filter(one).select("word", "near"))


def group_variants(words: DataFrame, least_length: int = 6, least_n: int = 5, times: int = 5, symbols: int | None = None) -> DataFrame:
    """words: word, n -> word, n, n_near, form, form_n, root, for words of at least ``least_length`` letters and ``least_n`` occurrences.

    Two words are near if they differ by one inserted, deleted or replaced letter (code point). A word's form is its near word of
    the largest n (ties: the first in code-point order) if that is at least ``times`` (above 1) the word's own n, else null; its root is what
    following forms ends at. Counts of a word given twice are added up; null words take no part. ``symbols``: letters are reduced to so
    many; by default they grow with the eighth root of the vocabulary. The result does not depend on it. An empty table
    gives an empty result; further columns are ignored.
    """
    counted = words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")).filter((F.length("word") >= least_length) & (F.col("n") >= least_n))
    kept = written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    size, most = kept.agg(F.count(F.lit(1)), F.max("n")).first()
    pairs = near_pairs(kept, symbols or max(4, math.ceil(size ** (1 / 8)))).join(kept.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.max_by(F.struct("near", "near_n"), F.struct("near_n", F.col("order"))).alias("b")
    found = pairs.withColumn("order", _descending(F.col("near"))).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    better = F.col("b.near_n") >= times * F.col("n")
    formed = written(
        kept.select("word", "n").join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("b.near")).alias("form"), F.when(better, F.col("b.near_n")).alias("form_n"))
    )
    # A form has times the count, so a chain has at most that many steps; each turn doubles what has been followed.
    steps = max(1, math.ceil(math.log((most or 1) / least_n, times)) + 1 if (most or 0) > least_n else 1)
    to = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = written(to.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return formed.join(to, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _descending(word: Column) -> Column:
    """A key whose order is the reverse of the words' code-point order: the largest key is the first word."""
    # Bytes of UTF-8 are in code-point order; each is turned around, and an end above all of them makes prefixes last.
    turned = F.translate(F.hex(word.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.concat(turned, F.lit("G"))
