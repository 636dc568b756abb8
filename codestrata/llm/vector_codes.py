"""Vectors as short codes: each part of a vector by the number of its nearest codebook entry.

Codebooks are learned by Lloyd's rounds in which members stay where they are. A row is one part of one vector; its owner
is (position, entry, salt), and rows lie in buckets by owner. An owner adds up the members it holds, so a round sends
only sums, at most one for each entry from each bucket. Codebooks are small and sent to all tasks; a row whose
nearest entry is still its own stays in its bucket, and only rows that change entry are shuffled, to their new owner.
A popular entry has many owners: the salt keeps an owner's members few even if all parts choose one entry.

All numbers are whole, so sums do not depend on order and reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, col, written

#: Members that an owner holds if all parts of a position choose one entry.
MEMBERS = 8192
#: Components fit in a long.
MOST = float(1 << 62)


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, carry: list[Column] = ()) -> DataFrame:
    """id, v (floor(scale * x) of each component), carried: the vectors without null or non-finite components."""
    v, finite = col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    fits = lambda x: F.abs(x.cast("double") * scale) < MOST
    whole = F.transform(v, lambda x: F.when(fits(x), F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component does not fit in a long")).cast("long")))
    return vectors.filter(v.isNotNull() & F.forall(v, finite)).select(col(id_col).alias("id"), whole.alias("v"), (F.struct(*carry) if carry else F.lit(None)).alias("carried"))


def _parts(v: Column, parts: int, width: int) -> Column:
    """The parts of a vector, which counts as filled up with 0."""
    full = F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(parts * width) - F.size(v))))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.slice(full, k * width + 1, width))


def _nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point and its squared distance; of equals the first. Whole numbers beyond what floats hold
    exactly are counted as Python integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    exact = 4 * most * most * points.shape[1] < 1 << 53
    p, e = (points.astype(np.float64), entries.astype(np.float64)) if exact else (points.astype(object), entries.astype(object))
    apart = (e * e).sum(axis=1)[None, :] - 2 * (p @ e.T)
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(p)), best] + (p * p).sum(axis=1)


@dataclass(frozen=True)
class Codebooks:
    """entries: whole numbers by part, entry and place within the part. scale: what components were multiplied by."""

    entries: np.ndarray
    scale: int

    @property
    def size(self) -> int:
        return self.entries.shape[1]

    def text(self) -> str:
        """All components in order, in decimal."""
        return ",".join(map(str, self.entries.ravel().tolist()))

    def nearest(self, position: Column, part: Column) -> Column:
        """The number of the entry that is nearest to a part."""
        entries = self.entries

        @F.arrow_udf("int")
        def of(positions: pa.Array, parts: pa.Array) -> pa.Array:
            at, out = positions.to_numpy(zero_copy_only=False), np.zeros(len(positions), np.int32)
            points = parts.flatten().to_numpy(zero_copy_only=False).reshape(len(out), -1)
            for k in np.unique(at):
                out[at == k] = _nearest(points[at == k], entries[k])[0]
            return pa.array(out)

        return of(position, part)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", carry: list[Column] = ()) -> DataFrame:
    """id, codes (array<int>, one for each part), error (squared distance to the entries, in scaled units), carried.

    Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as filled up with
    0, longer ones than the codebooks' are an error, as are components and errors beyond a long. Null ids, ties and repeated rows are rows
    like others; further columns come along only in ``carried``. One pass without a shuffle.
    """
    parts, _, width = books.entries.shape
    rows = whole_vectors(vectors, books.scale, id_col, vector_col, carry)

    @F.arrow_udf("struct<codes: array<int>, error: long>")
    def coded(v: pa.Array) -> pa.Array:
        sizes = np.diff(v.offsets.to_numpy())
        if sizes.max(initial=0) > parts * width:
            raise ValueError("a vector is longer than the codebooks")
        full = np.zeros((len(v), parts * width), np.int64)
        full[np.arange(parts * width) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
        found = [_nearest(full[:, k * width : (k + 1) * width], books.entries[k]) for k in range(parts)]
        codes = np.column_stack([best for best, _ in found]).astype(np.int32)
        error = [sum(map(int, own)) for own in zip(*(apart.tolist() for _, apart in found))]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * parts), pa.array(codes.ravel())), pa.array(error, pa.int64())], names=["codes", "error"])

    return rows.select("id", coded("v").alias("c"), "carried").select("id", "c.codes", "c.error", "carried")


def train(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256, members: int = MEMBERS, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks of ``size`` entries for each of ``parts`` equal consecutive parts of the vectors' scaled whole components.

    They start as the parts of the vectors with the ``size`` smallest ids (fewer vectors: so many entries; ties by the
    vectors themselves, null ids last). In each round every part goes to its nearest entry (squared Euclidean distance, ties to
    the lower number), and an entry becomes the mean of its parts, rounded down; unused entries stay. A width that
    the parts do not divide counts as filled up with 0, as do shorter vectors. An empty table gives no entries.
    """
    rows = written(whole_vectors(vectors, scale, id_col, vector_col).select("id", "v"))
    n, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = -(-longest // parts)
    if not n or not width:
        return Codebooks(np.zeros((parts, 0, width), np.int64), scale)
    cut = _parts(F.col("v"), parts, width)
    start = rows.orderBy(F.asc_nulls_last("id"), "v").limit(size).select(cut.alias("parts")).collect()  # ``size`` rows
    books = Codebooks(np.array([r["parts"] for r in start], np.int64).transpose(1, 0, 2), scale)

    salts, buckets = -(-n // members), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner = (F.col("position") * size + F.col("entry")).cast("long") * salts + F.pmod(F.xxhash64("row"), F.lit(salts))

    def settled(moving: DataFrame) -> DataFrame:
        """Rows brought to their owners; they are not shuffled again while they stay."""
        return bucketed(moving.withColumn("owner", owner).repartition(buckets, "owner"), "owner", buckets)

    each = rows.select(F.monotonically_increasing_id().alias("row"), F.posexplode(cut).alias("position", "part"))
    resident = [settled(each.withColumn("entry", books.nearest(F.col("position"), F.col("part"))))]
    for left in reversed(range(rounds)):
        members_of = _together(resident)
        sums = [F.sum(F.col("part")[k]).alias(f"s{k}") for k in range(width)]
        of_owner = members_of.groupBy("owner", "position", "entry").agg(F.count(F.lit(1)).alias("n"), *sums)
        totals = of_owner.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)])
        entries = books.entries.copy()
        for r in totals.collect():  # at most parts * size rows
            entries[r["position"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
        books = Codebooks(entries, scale)
        if left:
            placed = [t.withColumn("now", books.nearest(F.col("position"), F.col("part"))) for t in resident]
            moving = _together(placed).filter("now <> entry").select("row", "position", "part", F.col("now").alias("entry"))
            resident = [t.filter("now = entry").drop("now") for t in placed] + [settled(moving)]
    return books


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out
