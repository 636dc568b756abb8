"""SimHash near-duplicates: fingerprints linked within a Hamming radius through BK-trees.

The 64 bits are cut into ``radius + 4`` blocks. Two fingerprints within the radius agree on all but
``radius`` of the blocks, so for some choice of the other blocks they agree on every bit: each
choice shards the fingerprints by those bits, and every linked pair meets in a shard. A shard fixes
42 bits or more, hence holds at most 2**22 different fingerprints, however hot it is. Each shard has
a BK-tree, whose children are keyed by their Hamming distance to the parent, and its members search
it following only edges within the radius. The trees are not broadcast to all tasks: together they
grow with the corpus, so each is built where the only fingerprints that may match it are.

A shard returns its local components as stars, never its pairs; the stars are joined globally.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, written
from .components import components, in_few_files

BITS = 64
#: Shingles hashed at a time.
CHUNK = 100_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as an unsigned integer; 0 if it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.dtype("<u8"), n)
    ones = sum(np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, n, CHUNK))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


class BKTree:
    """Over different fingerprints of one or more words; a node's children are keyed by their distance to it. A node
    with fewer than ``leaf`` others below it keeps them in a bucket, which prunes as well as so few nodes would."""

    def __init__(self, prints: np.ndarray, leaf: int = 1):
        self.prints = prints.reshape(len(prints), -1)
        self.children: dict[int, dict[int, int]] = {}
        self.bucket: dict[int, np.ndarray] = {}
        waiting = [np.arange(len(prints))] if len(prints) else []
        while waiting:
            own = waiting.pop()
            root, rest = own[0], own[1:]
            self.children[root] = edges = {}
            if len(rest) < leaf:
                self.bucket[root] = rest
                continue
            far = self._far(self.prints[rest], root)
            for distance in np.unique(far):
                subtree = rest[far == distance]
                edges[int(distance)] = subtree[0]
                waiting.append(subtree)

    def _far(self, seekers: np.ndarray, node: int) -> np.ndarray:
        return np.bitwise_count(seekers ^ self.prints[node]).sum(axis=-1, dtype=np.int64)

    def search(self, seekers: np.ndarray, radius: int):
        """(members, seekers within the radius of them) node by node: all seekers go down the tree together."""
        seekers = seekers.reshape(len(seekers), -1)
        waiting = [(0, np.arange(len(seekers)))] if self.children else []
        while waiting:
            node, who = waiting.pop()
            far = self._far(seekers[who], node)
            found = who[far <= radius]
            yield np.full(len(found), node), found
            bucket = self.bucket.get(node, ())
            if len(bucket):
                at, place = np.nonzero(np.bitwise_count(seekers[who][:, None] ^ self.prints[bucket]).sum(axis=-1, dtype=np.int64) <= radius)
                yield bucket[place], who[at]
            for distance, child in self.children[node].items():
                near = who[np.abs(far - distance) <= radius]
                if len(near):
                    waiting.append((child, near))


def local_roots(prints: np.ndarray, radius: int) -> np.ndarray:
    """The position of the first member that each member of a shard reaches within the shard."""
    if len(prints) == 2:
        return np.array([0, 0 if int(prints[0] ^ prints[1]).bit_count() <= radius else 1])
    parent = np.arange(len(prints))
    for _, found in BKTree(prints).search(prints, radius):
        if not len(found):
            continue
        roots = parent[found]
        while not np.array_equal(roots, above := parent[roots]):
            roots = above
        parent[roots] = parent[found] = roots.min()
    while not np.array_equal(parent, above := parent[parent]):
        parent = above
    return parent


def block_masks(radius: int) -> list[int]:
    """The bits that each choice of agreeing blocks fixes, as signed 64-bit integers."""
    blocks = radius + 4
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    part = [(1 << high) - (1 << low) for low, high in zip(bounds, bounds[1:])]
    masks = [sum(chosen) for chosen in combinations(part, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def simhash_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Different fingerprints (fingerprint long) -> links (a, b) that connect all within the radius."""

    @F.arrow_udf("array<struct<a: long, b: long>>")
    def stars(shards: pa.Array) -> pa.Array:
        values, ends = shards.values.to_numpy(zero_copy_only=False).view(np.uint64), shards.offsets.to_numpy(zero_copy_only=False)
        a, b, sizes = [], [], [0]
        for low, high in zip(ends, ends[1:]):
            own = np.sort(values[low:high])
            root = local_roots(own, radius)
            linked = root != np.arange(len(own))
            a.append(own[linked])
            b.append(own[root[linked]])
            sizes.append(sizes[-1] + len(a[-1]))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64)) for x in (a, b)], names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)

    masks = block_masks(radius)
    keys = F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "value")
    # A group is one shard: at most 2**22 numbers, by the bits it fixes.
    shards = prints.select("fingerprint", keys).groupBy("mask", "value").agg(F.collect_list("fingerprint").alias("shard")).filter(F.size("shard") > 1)
    return shards.select(F.explode(stars("shard")).alias("link")).select("link.*")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, fingerprint (long), component_id, kept, and struct ``carried``.

    ``component_id`` is the smallest id reachable over links of ``radius`` or fewer differing bits, the own
    included; null ids count only where a component has no other. Null and wordless texts have
    fingerprint 0 and link like any other. ``kept`` marks one row of each component: the one with its
    smallest id, and of several such rows (repeated ids) one. An empty table gives an empty result.
    Other columns are ignored unless carried, inside ``carried``.
    """
    carried = F.struct(*[col(c).alias(c) for c in carry]) if carry else F.struct(F.lit(True).alias("none"))

    @F.arrow_udf("long")
    def prints_of(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle, seed) for t in text.to_pylist()], np.uint64).view(np.int64))

    rows = written(docs.select(col(id_col).alias("id"), prints_of(col(text_col).cast("string")).alias("fingerprint"), F.monotonically_increasing_id().alias("row"), carried.alias("carried")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    prints = written(rows.groupBy("fingerprint").agg(first.alias("first")))
    roots = components(simhash_links(prints.select("fingerprint"), radius))
    rooted = prints.join(roots, prints["fingerprint"] == roots["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    different = prints.count()
    firsts = in_few_files(rooted.groupBy("root").agg(F.min("first").alias("head")), different)
    heads = in_few_files(rooted.join(firsts, "root").select("fingerprint", "head"), different)
    return rows.join(heads, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", F.col("head.id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("kept"), "carried")
