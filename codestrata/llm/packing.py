"""Packing documents into fixed-length sequences by large-item matching and best fit.

Pieces of one length are alike, so the packing is decided on the histogram of lengths: at most
``capacity`` rows, whatever the input. Pieces above a third of the capacity are matched greedily,
the longest with the longest that fits beside it, two to a sequence at most; the others go, longest
first, into the smallest gap that holds them, and open new sequences only where no gap does. The
plan says, for each run of pieces of one length, in which run of sequences and at which offset they
stand. It is looked up by (length, rank); ranks come from each task's own count and a prefix sum
over tasks, so no step sorts or gathers the pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, given_back, written
from .tokenizing import REMEMBERED, together, word_ids

#: Rows of (task, length) counts that may be broadcast, some 50 MB; above it they are joined by shuffle.
BROADCAST_ROWS = 400_000
END = np.array([1], "<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, remembered: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids (little-endian 32-bit), and part and place: the task that made
    the piece and how many of the same length it had made before."""

    def pieces(batches):
        words, made, part = word_ids(tokenizer, remembered), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            done = 0
            for group in together(batch.column(1)):
                out = defaultdict(list)
                for row, ids in enumerate(words.texts(group), done):
                    ids += END
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        for name, value in (("row", row), ("piece", piece), ("start", at // 4), ("length", length), ("place", made[length]), ("ids", own)):
                            out[name].append(value)
                        made[length] += 1
                done += len(group)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "place")), pa.array([part] * len(out["row"]), pa.int64()), pa.array(out["ids"], pa.binary())],
                    names=["id", "piece", "start", "length", "place", "part", "ids"],
                )
        given_back()

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(pieces, f"id {kind}, piece int, start long, length long, place long, part long, ids binary")


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): runs of equal pieces in runs of sequences.

    Its size depends on the capacity alone: a sequence run changes its gap with every piece it takes,
    so each of at most ``capacity`` gaps and lengths takes part in a bounded number of steps.
    """
    left, used, plan = dict(histogram), Counter(), []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        plan.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            partner = next((b for b in reversed(large) if b <= min(a, capacity - a) and left[b] > (a == b)), None)
            n = left[a] if partner is None else left[a] // 2 if partner == a else min(left[a], left[partner])
            put(a, n, sequences, 0)
            if partner is not None:
                put(partner, n, sequences, a)
            leave(capacity - a - (partner or 0), sequences, n)
            sequences += n

    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(sizes, s)
            if i < len(sizes):
                gap = sizes[i]
                first, n = gaps[gap].pop()
                taken = min(n, left[s])
                put(s, taken, first, capacity - gap)
                leave(gap - s, first, taken)
                if taken < n:
                    gaps[gap].append((first + taken, n - taken))
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.remove(gap)
                continue
            each = min(capacity // s, left[s])
            n = left[s] // each
            for k in range(each):
                put(s, n, sequences, k * s)
            leave(capacity - each * s, sequences, n)
            sequences += n
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, remembered: int = REMEMBERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file, the same on every node. A document is its ids and
    then id 1; only documents longer than the capacity are cut, into pieces of the capacity and
    a last one. Null text counts as empty: the piece is id 1 alone. Repeated rows are documents
    of their own. A null id stays null. Ties between pieces of one length do not matter: they are
    alike. An empty table gives an empty result. Other columns are ignored. ``remembered`` words a worker spare CPU for
    memory and change nothing else.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, remembered, id_col, text_col))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = written(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(plan_sequences(histogram, capacity)) or [(0, 0, 0, 0, 0)]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(plan, np.int64))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows = shared.value
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted((rows[:, 0] << 48) + rows[:, 1], (length << 48) + rank, "right") - 1
        return pa.StructArray.from_arrays([pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], names=["sequence_id", "offset"])

    earlier = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), "earlier")
    if counts.count() <= BROADCAST_ROWS:
        earlier = F.broadcast(earlier)
    ranked = pieces.join(earlier, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    spot = placed(F.col("length"), F.col("earlier") + F.col("place")).alias("spot")
    return ranked.select("id", "piece", "start", "length", "ids", spot).select(F.col("id").alias(id_col), "piece", "start", "length", "ids", "spot.sequence_id", "spot.offset")
