"""SimHash near-duplicates confirmed by similarity: texts whose sets of word shingles have a Jaccard similarity of at
least a bound.

A text has several fingerprints, each from its own hashing of the same shingles. They are cut into blocks of ``width``
bits, and each block shards the texts by its value. Two sets of similarity s have an overlap (cosine) of 2s / (1 + s)
or more, so a bit of theirs differs with probability acos(2s / (1 + s)) / pi or less; from this follow how many blocks
it takes until such a pair shares one with probability ``recall``, and the radius within which their
fingerprints are. The width grows with the logarithm of the number of texts: shards keep their size. A shard's BK-tree
finds the members within the radius, and a pair is linked if the similarity of its sets reaches the bound.

No pair that is not a link leaves a task, as a group of N copies has N * N of them. A shard returns its members within the
radius as stars; the components of all stars are bodies of candidates, in which every pair that may be a link lies. Texts
of a body come together once, with their sets, and return a forest of the links among them. Shards and bodies of
more than ``CHUNK`` members (bodies of more than ``CHUNK_BYTES``, too) are first tried against one of them, their centre; then each
chunk of members meets each chunk of those that the centre has not taken. So the components are those of all
candidate pairs, and a hot group is neither gathered nor paired.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, given_back, written
from .components import components
from .near_dedup import BITS, BKTree

#: Shingles that are fingerprinted together.
TOGETHER = 100_000
#: Rows of a table that may be broadcast, some 10 MB.
BROADCAST_ROWS = 200_000
#: Texts of a shard on average, members of a tree at most, and members of a bucket in it.
SHARD, CHUNK, LEAF = 64, 2048, 64
#: Bytes of the sets in a chunk.
CHUNK_BYTES = 4 << 20
#: Of so many texts, one is counted to see which shards have more than a chunk.
COUNTED = 16
#: Fingerprints of which the distance is taken.
COMPARED = 2
#: Byte -> its eight bits as the bytes of a number, so that 255 of them add up without a carry.
LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)


@dataclass(frozen=True)
class Blocks:
    """How texts are fingerprinted and sharded."""

    width: int  # bits of a block
    keys: int  # blocks of a text
    prints: int  # fingerprints that hold them
    radius: int  # over the compared fingerprints

    @classmethod
    def of(cls, texts: int, least: float, recall: float) -> Blocks:
        differ = math.acos(2 * least / (1 + least)) / math.pi
        width = min(BITS // 2, max(8, math.ceil(math.log2(max(1, texts) / SHARD))))
        keys = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** width)) if differ > 0 else 1
        prints = -(-keys // (BITS // width))
        bits = BITS * min(COMPARED, prints)
        return cls(width, keys, prints, math.ceil(bits * differ + 3 * math.sqrt(bits * differ * (1 - differ))))

    @property
    def compared(self) -> int:
        return min(COMPARED, self.prints)


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles; a shorter text is one shingle, a wordless one too."""
    words = (text or "").encode().lower().split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.dtype("<u8")))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of hashes: the bits that are set in over half of them."""
    chunks = -(-sizes // 255)
    first = np.cumsum(chunks) - chunks
    starts = np.repeat(np.cumsum(sizes) - sizes, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(first, chunks))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(LANES[octets[:, i]], starts) for i in range(8)], axis=1)
    ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, BITS), first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(sets: list[np.ndarray], prints: int, seed: int = 42) -> np.ndarray:
    """The fingerprints of each set, one row a set."""
    rng = np.random.default_rng(seed)
    flips, factors, mixers = (rng.integers(0, 2**64, prints, dtype=np.uint64) | np.uint64(1) for _ in range(3))
    hashes, sizes = np.concatenate(sets), np.array(list(map(len, sets)))
    out = np.empty((len(sets), prints), np.uint64)
    for k in range(prints):
        x = (hashes ^ flips[k]) * factors[k]
        x = (x ^ x >> np.uint64(32)) * mixers[k]
        out[:, k] = majority(x ^ x >> np.uint64(29), sizes)
    return out


def near_pairs(prints: np.ndarray, stored: np.ndarray, seeking: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of seeking and stored members within the radius, some at a time."""
    trees, seekers = np.flatnonzero(stored), np.flatnonzero(seeking)
    if not len(trees) or not len(seekers):
        return
    for member, who in BKTree(prints[trees], LEAF).search(prints[seekers], radius):
        if len(who):
            yield seekers[who], trees[member]


def near_roots(prints: np.ndarray, stored: np.ndarray, seeking: np.ndarray, radius: int) -> np.ndarray:
    """The position of the first member that each member of a shard reaches over pairs within the radius."""
    parent = np.arange(len(prints))
    for a, b in near_pairs(prints, stored, seeking, radius):
        while (apart := parent[a] != parent[b]).any():
            x, y = parent[a[apart]], parent[b[apart]]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(parent, above := parent[parent]):
                parent = above
    return parent


def forest(prints: np.ndarray, sets: list[np.ndarray], stored: np.ndarray, seeking: np.ndarray, radius: int, least: float) -> list[tuple[int, int]]:
    """Links of seeking and stored members, as many as connect all whose sets reach the similarity."""
    root, sizes, links = np.arange(len(sets)), np.array(list(map(len, sets))), []
    for a, b in near_pairs(prints, stored, seeking, radius):
        likely = (a != b) & (np.minimum(sizes[a], sizes[b]) >= np.maximum(sizes[a], sizes[b]) * least - 0.5)
        order = np.argsort(a[likely], kind="stable")
        a, b = a[likely][order], b[likely][order]
        for own in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else ():
            at, others = a[own[0]], b[own]
            others = others[root[others] != root[at]]
            if not len(others):
                continue
            grams = np.concatenate([sets[o] for o in others])
            place = np.minimum(np.searchsorted(sets[at], grams), sizes[at] - 1)
            common = np.add.reduceat(sets[at][place] == grams, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            for o in others[common / (sizes[at] + sizes[others] - common) >= least]:
                if root[o] != root[at]:
                    root[root == root[o]] = root[at]
                    links.append((at, o))
    return links


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast where it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def distance(left: list[str], right: list[str]) -> Column:
    """Bits in which fingerprints differ."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(left[1:], right[1:])), F.bit_count(F.col(left[0]).bitwiseXOR(F.col(right[0]))))


def similar_duplicates(
    docs: DataFrame, least: float = 0.8, shingle: int = 5, recall: float = 0.99, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: id, component_id, kept, and struct ``carried``.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of ``least`` or more; A-Z count
    as a-z. Pairs at the very bound are found with probability ``recall``, others with more. ``component_id`` is the smallest id reachable over links, the own included; null ids count only where a
    component has no other. Null and wordless texts are equal to each other. ``kept`` marks one row of
    each component: the one with its smallest id, and of several such rows (repeated ids) one. An empty
    table gives an empty result. Other columns are ignored unless carried, inside ``carried``.
    """
    whole = text_col in carry  # then the text goes along once, among what is carried
    carried = F.struct(*[col(c).alias(c) for c in carry]) if carry else F.struct(F.lit(True).alias("none"))
    plan = Blocks.of(docs.count(), least, recall)
    compared = [f"p{k}" for k in range(plan.compared)]

    @F.arrow_udf("array<long>")
    def prints_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            found, waiting, size = [np.empty((0, plan.prints), np.uint64)], [], 0
            for t in text:
                waiting.append(shingle_set(t.as_py(), shingle, seed))
                size += len(waiting[-1])
                if size >= TOGETHER:
                    found.append(fingerprints(waiting, plan.prints, seed))
                    waiting, size = [], 0
            if waiting:
                found.append(fingerprints(waiting, plan.prints, seed))
            values = np.concatenate(found)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * plan.prints, pa.int32()), pa.array(values.reshape(-1).view(np.int64)))
        given_back()

    @F.arrow_udf("binary")
    def grams_of(text: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_py(), shingle, seed).tobytes() for t in text], pa.binary())

    @F.arrow_udf("boolean")
    def reaches(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([similarity(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) >= least for x, y in zip(left, right)], pa.bool_())

    def groups_of(groups: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """Of each group: rows, fingerprints, who is in the trees, who seeks, and all columns."""
        members, ends = groups.values, groups.offsets.to_numpy()
        row = members.field("row").to_numpy(zero_copy_only=False)
        prints = np.stack([members.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in compared], axis=1)
        stored, seeking = (members.field(c).to_numpy(zero_copy_only=False) for c in ("stored", "seeking"))
        for low, high in zip(ends, ends[1:]):
            yield row[low:high], prints[low:high], stored[low:high], seeking[low:high], members.slice(low, high - low)

    def as_lists(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (zip(*found) if found else ((), ()))], names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(a) for a, _ in found)]), pa.int32()), pairs)

    @F.arrow_udf("array<struct<a: long, b: long>>")
    def stars_of(shards: pa.Array) -> pa.Array:
        found = []
        for row, prints, stored, seeking, _ in groups_of(shards):
            root = near_roots(prints, stored, seeking, plan.radius)
            moved = root != np.arange(len(root))
            found.append((row[moved], row[root[moved]]))
        return as_lists(found)

    @F.arrow_udf("array<struct<a: long, b: long>>")
    def links_of(bodies: pa.Array) -> pa.Array:
        found = []
        for row, prints, stored, seeking, members in groups_of(bodies):
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in members.field("grams")]
            links = np.array(forest(prints, sets, stored, seeking, plan.radius, least), np.int64).reshape(-1, 2)
            found.append((row[links[:, 0]], row[links[:, 1]]))
        return as_lists(found)

    def gathered(rows: DataFrame, by: list[str], *more: str) -> DataFrame:
        """A row for each group, dealt before it is gathered: what is gathered twice is larger than its rows."""
        shard = F.collect_list(F.struct("row", "stored", "seeking", *compared, *more)).alias("shard")
        return rows.repartition(*by).groupBy(*by).agg(shard).filter(F.size("shard") > 1)

    def in_chunks(rows: DataFrame, key: str) -> DataFrame:
        """Rows (key, taken, n_chunks, n_stored, ...): each chunk of members meets each chunk of those that the centre has not taken."""
        chunk = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
        each = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        place = lambda i, j, stored: F.struct(i.alias("i"), j.alias("j"), F.lit(stored).alias("stored"), F.lit(not stored).alias("seeking"))
        seeks = F.transform(each("tree_chunks"), lambda j: place(chunk("seek_chunks"), j, False))
        stays = F.when(F.col("taken"), F.array().cast("array<struct<i: int, j: int, stored: boolean, seeking: boolean>>")).otherwise(F.transform(each("seek_chunks"), lambda i: place(i, chunk("tree_chunks"), True)))
        return rows.withColumn("at", F.explode(F.concat(seeks, stays))).select(key, "at.*", "row", *compared, *[c for c in rows.columns if c == "grams"])

    def as_links(groups: DataFrame, pairs: Callable) -> DataFrame:
        return groups.select(F.explode(pairs("shard")).alias("pair")).select("pair.a", "pair.b")

    text = col(text_col).cast("string")
    body = F.lit("") if whole else text
    rows = written(docs.select(col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), carried.alias("carried"), body.alias("body"), prints_of(text).alias("prints")))
    per, mask = BITS // plan.width, (1 << plan.width) - 1
    blocks = [F.shiftrightunsigned(F.col("prints")[k // per], k % per * plan.width).bitwiseAND(F.lit(mask)) for k in range(plan.keys)]
    keys = rows.select("row", *[F.col("prints")[k].alias(c) for k, c in enumerate(compared)], F.posexplode(F.array(*blocks)).alias("block", "value"))
    keys = keys.select(F.shiftleft(F.col("block").cast("long"), plan.width).bitwiseOR(F.col("value")).alias("key"), "row", *compared)

    both = [F.lit(True).alias("stored"), F.lit(True).alias("seeking")]
    counted = keys.filter(F.pmod(F.xxhash64("row"), F.lit(COUNTED)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = written(counted.filter(F.col("n") * COUNTED > CHUNK).select("key"))
    if hot.isEmpty():
        stars = as_links(gathered(keys.select("key", "row", *both, *compared), ["key"]), stars_of)
    else:
        centre = F.min(F.struct(F.xxhash64("row", "key").alias("order"), "row", *compared)).alias("c")
        centres = _small(written(keys.join(_small(hot), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), centre)))
        sides = keys.join(centres, "key").withColumn("taken", distance(compared, [f"c.{c}" for c in compared]) <= plan.radius)
        sides = written(sides.select("key", "row", *compared, "n", "taken", F.col("c.row").alias("centre")))
        trees = sides.groupBy("key").agg(F.count(F.when(~F.col("taken"), 1)).alias("n_stored"), F.first("n").alias("n"))
        trees = trees.select("key", *[F.ceil(F.col(c) / CHUNK).cast("int").alias(k) for c, k in (("n", "seek_chunks"), ("n_stored", "tree_chunks"))])
        cold = keys.join(_small(hot), "key", "left_anti").select("key", "row", *both, *compared)
        dealt = in_chunks(sides.join(_small(written(trees)), "key"), "key")
        stars = as_links(gathered(cold, ["key"]), stars_of).unionByName(as_links(gathered(dealt, ["key", "i", "j"]), stars_of))
        stars = stars.unionByName(sides.filter("taken").select(F.col("row").alias("a"), F.col("centre").alias("b")))

    body = components(stars)
    body = written(body.unionByName(body.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "row"))
    text = rows["carried"][text_col].cast("string") if whole else rows["body"]
    sets = written(rows.join(_small(body), "row").select("row", "root", *[F.col("prints")[k].alias(c) for k, c in enumerate(compared)], grams_of(text).alias("grams"), F.octet_length(text).alias("size")))
    sizes = written(sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    large = written(sizes.filter((F.col("n") > CHUNK) | (F.col("bytes") > CHUNK_BYTES)).select("root"))
    if large.isEmpty():
        links = as_links(gathered(sets.select("root", "row", *both, *compared, "grams"), ["root"], "grams"), links_of)
    else:
        inside = sets.join(_small(large), "root").select("root", "row", *compared, "grams", F.octet_length("grams").alias("size"))
        centres = written(inside.filter("row = root").select("root", F.col("grams").alias("centre")))
        sides = written(inside.join(centres, "root").withColumn("taken", reaches("grams", "centre")).drop("centre"))
        chunks = lambda n, size: F.ceil(F.greatest(n / CHUNK, size / CHUNK_BYTES)).cast("int")
        out = ~F.col("taken")
        trees = sides.groupBy("root").agg(
            chunks(F.count(F.lit(1)), F.sum("size")).alias("seek_chunks"), chunks(F.count(F.when(out, 1)), F.coalesce(F.sum(F.when(out, F.col("size"))), F.lit(0))).alias("tree_chunks")
        )
        small = sets.join(_small(large), "root", "left_anti").select("root", "row", *both, *compared, "grams")
        dealt = in_chunks(sides.join(_small(written(trees)), "root"), "root")
        links = as_links(gathered(small, ["root"], "grams"), links_of).unionByName(as_links(gathered(dealt, ["root", "i", "j"], "grams"), links_of))
        links = links.unionByName(sides.filter("taken").select(F.col("row").alias("a"), F.col("root").alias("b")))
    roots = components(links)

    own = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "row"))
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    rooted = written(rows.join(_small(own), "row").select("row", "root", first.alias("first")))
    heads = written(rooted.groupBy("root").agg(F.min("first").alias("head")))
    heads = written(rooted.join(heads, "root").select("row", "head"))
    found = rows.join(_small(heads), "row", "left")
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("component_id"),
        F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("kept"),
        "carried",
    )
