"""Exact top-k by inner product over a pivot-distance index.

Vectors are made integer and given one more component, so that all have the largest norm M; a query
has 0 there. Then |q - v|^2 = |q|^2 + M^2 - 2 q.v, and the highest inner products are the nearest
neighbours. Every vector is keyed by its nearest pivot and its distance to it; the index is ordered
by that key and ranges of it are dealt to tasks. A query stands at its own distance from each pivot:
the search opens the annulus of stored distances around it first and goes on outwards on both sides,
until the triangle inequality says that nothing further out can enter its top k. A first pass over
the annulus around home gives every query a bound to start with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, written

LOWEST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Vectors in one annulus.
ANNULUS = 256


def integer_vectors(vectors: DataFrame, is_query: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array of floor(scale * x)), row and is_query of each vector that takes part."""
    v, finite = col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    fits = lambda x: F.abs(x.cast("double") * scale) < float(1 << 62)
    whole = F.transform(v, lambda x: F.when(fits(x), F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component does not fit in a long")).cast("long")))
    return vectors.filter(col(id_col).isNotNull() & v.isNotNull() & F.forall(v, finite)).select(
        col(id_col).cast("long").alias("id"), whole.alias("v"), F.monotonically_increasing_id().alias("row"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )


def _whole(v: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled with 0."""
    values, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(v), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values[ends[0] : ends[-1]]
    return out


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    """As ``_whole``, in floats: for distances, which may be rounded."""
    return _whole(v, width).astype(np.float64)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products. The arrays hold floats where all products are exact in them, else Python integers."""
    found = queries @ vectors.T
    if found.dtype == object and found.size and not -(1 << 63) < found.min() <= found.max() < 1 << 63:
        raise OverflowError("a score does not fit in a long")
    return found.astype(np.int64)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before it."""
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


class Best:
    """The k best (score, smallest id, smallest row) of each query so far."""

    def __init__(self, k: int, rows: np.ndarray, bounds: np.ndarray):
        n = len(rows)
        self.own, self.bounds = rows, bounds
        self.score, self.id, self.row = np.full((n, k), LOWEST), np.full((n, k), LAST), np.full((n, k), LAST)

    def least(self, q: np.ndarray) -> np.ndarray:
        """A score that any newcomer must reach."""
        return np.maximum(self.score[q, -1], self.bounds[q])

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        score = np.where((self.own[q][:, None] == rows) | (score < self.least(q)[:, None]), LOWEST, score)
        some = (score > LOWEST).any(axis=1)
        q, score = q[some], score[some]
        if len(q):
            k, n = self.score.shape[1], len(q)
            all_of = [np.concatenate([old[q], new], axis=1) for old, new in ((self.score, score), (self.id, np.where(score > LOWEST, ids, LAST)), (self.row, np.where(score > LOWEST, rows, LAST)))]
            order = np.lexsort((all_of[2], all_of[1], ~all_of[0]), axis=-1)[:, :k]
            for held, x in zip((self.score, self.id, self.row), all_of):
                held[q] = x[np.arange(n)[:, None], order]


def search(best: Best, queries: np.ndarray, away: np.ndarray, norms: np.ndarray, most: float, stored: tuple, wanted: np.ndarray, steps: int | None = None) -> None:
    """Let the wanted queries search the stored vectors of one pivot, which are sorted by their distance
    to it; ``away`` is each query's distance to it. ``steps`` bounds the annuli opened."""
    vectors, distance, ids, rows = stored
    starts = np.arange(0, len(ids), ANNULUS)
    inner, outer = distance[starts], distance[np.minimum(starts + ANNULUS, len(ids)) - 1]
    slack = 1e-6 * most + 1e-9
    q = wanted
    up = np.searchsorted(outer, away[q])
    down = up - 1
    while len(q) and steps != 0:
        to_down = np.where(down >= 0, away[q] - outer[np.maximum(down, 0)], np.inf)
        to_up = np.where(up < len(starts), np.maximum(0, inner[np.minimum(up, len(starts) - 1)] - away[q]), np.inf)
        gap, at = np.minimum(to_down, to_up), np.where(to_down < to_up, down, up)
        least = best.least(q)
        reach = np.where(least == LOWEST, np.inf, np.sqrt(np.maximum(0, norms[q] + most**2 - 2 * least.astype(np.float64))))
        on = np.isfinite(gap) & (gap <= reach + slack)  # the triangle inequality: |q - v| >= gap
        q, at, up, down = q[on], at[on], up[on], down[on]
        for a in np.unique(at):
            here, part = q[at == a], slice(starts[a], starts[a] + ANNULUS)
            best.offer(here, _scores(queries[here], vectors[part]), ids[part], rows[part])
        went_up = at == up
        up, down = up + went_up, down - ~went_up
        steps = None if steps is None else steps - 1


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = 64, sample: int = 2000, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that is a query: query_id, rank, vec_id, score of its k best other rows.

    Score is the inner product of floor(scale * x), exactly; one that does not fit in a long is an error. Ties go to the smaller id. A
    query's own row is no candidate, but a repeated row of the same id is. Null ids, null vectors and
    vectors with null or non-finite components take no part. Vectors of fewer components than the
    longest count as filled up with 0. Fewer than k candidates: all of them. Pivots come from a sample of
    ``sample`` vectors; any choice gives the same result. Queries are searched in blocks of ``block``, which
    bounds what is sent to every task. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(integer_vectors(vectors, is_query, scale, id_col, vector_col))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    width, square = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(squares), F.lit(0.0))).first()
    most = float(np.sqrt(square))
    number = np.float64 if square < 1 << 52 else object  # no score is above the largest square
    picked = rows.select("v").orderBy(F.xxhash64("id", "row")).limit(sample).toArrow().column(0).combine_chunks()
    if not len(picked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(0, square - (v**2).sum(axis=1)))])

    centres = choose_pivots(lifted(_matrix(picked, width)), pivots)

    @F.arrow_udf("struct<pivot: int, distance: double>")
    def keyed(v: pa.Array) -> pa.Array:
        far = np.sqrt(np.maximum(0, 2 * square - 2 * lifted(_matrix(v, width)) @ centres.T))
        nearest = far.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(v)), nearest])], names=["pivot", "distance"])

    order = ["pivot", "distance", "id", "row"]
    index = written(rows.select("id", "v", "row", "is_query", keyed("v").alias("key")).select("id", "v", "row", "is_query", "key.*").repartitionByRange(*order).sortWithinPartitions(*order))

    def over(shared, home_only: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q_rows, q_whole, bounds = shared.value
            q, q_own = q_whole.astype(np.float64), q_whole.astype(number)
            norms, best = (q**2).sum(axis=1), Best(k, q_rows, bounds)
            away = np.sqrt(np.maximum(0, norms[:, None] + square - 2 * q @ centres[:, :-1].T))
            home = away.argmin(axis=1)
            for batch in batches:
                ids, own_rows, pivot, distance = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row", "pivot", "distance"))
                matrix = _whole(batch.column("v"), width).astype(number)
                for p in np.unique(pivot):
                    part = pivot == p
                    wanted = np.flatnonzero(home == p) if home_only else np.arange(len(q))
                    search(best, q_own, away[:, p], norms, most, (matrix[part], distance[part], ids[part], own_rows[part]), wanted, 1 if home_only else None)
            at, place = np.nonzero(best.score > LOWEST)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[at], q_rows[at], best.id[at, place], best.row[at, place], best.score[at, place])], names=["query_id", "query_row", "vec_id", "row", "score"])

        return index.select("id", "v", "row", "pivot", "distance").mapInArrow(task, "query_id long, query_row long, vec_id long, row long, score long")

    ranked = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    queries, found, after = index.filter("is_query").select("row", "id", "v"), [], -1
    while True:
        own = queries.filter(F.col("row") > after).orderBy("row").limit(block).toArrow().combine_chunks()
        if not own.num_rows:
            break
        q_rows, q_ids = (own.column(c).to_numpy() for c in ("row", "id"))
        q, after = _whole(own.column("v").combine_chunks(), width), int(q_rows[-1])
        start = spark.sparkContext.broadcast((q_ids, q_rows, q, np.full(len(q), LOWEST)))
        bounds = dict.fromkeys(q_rows.tolist(), LOWEST)
        for r in over(start, True).withColumn("rank", ranked).filter(F.col("rank") <= k).groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") == k).collect():
            bounds[r["query_row"]] = r["score"]
        bounded = spark.sparkContext.broadcast((q_ids, q_rows, q, np.array([bounds[r] for r in q_rows.tolist()], np.int64)))
        found.append(over(bounded, False).withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
