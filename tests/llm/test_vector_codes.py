import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import vector_codes
from codestrata.llm.vector_codes import Codebooks, encode, train


def by_hand(rows, parts, size, rounds, scale):
    """rows: (id, vector) without gaps in vectors of one width."""
    rows = sorted((i, [int(np.floor(scale * x)) for x in v]) for i, v in rows)
    width = len(rows[0][1]) // parts
    cut = [[tuple(v[k * width : (k + 1) * width]) for k in range(parts)] for _, v in rows]
    books = [[own[k] for own in cut[:size]] for k in range(parts)]

    def near(p, book):
        return min((sum((a - b) ** 2 for a, b in zip(p, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            at = [near(own[k], books[k])[1] for own in cut]
            for e in range(len(books[k])):
                mine = [own[k] for own, n in zip(cut, at) if n == e]
                if mine:
                    books[k][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    return books, {i: ([near(own[k], books[k])[1] for k in range(parts)], sum(near(own[k], books[k])[0] for k in range(parts))) for (i, _), own in zip(rows, cut)}


@pytest.mark.parametrize("members", [3, 1 << 20])
@pytest.mark.parametrize("large", [1.0, 3e9])
def test_rounds_and_codes_as_by_hand(spark, members, large):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(8) * large).tolist()) for i in range(120)] + [(1000 + i, [large] * 8) for i in range(60)]  # a third alike
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    books = train(df, parts=4, size=6, rounds=3, members=members)
    want, coded = by_hand(rows, 4, 6, 3, 256)
    assert books.entries.tolist() == [[list(e) for e in b] for b in want]
    if large == 1.0:
        assert {r["id"]: (r["codes"], r["error"]) for r in encode(df, books).collect()} == coded


def test_members_that_stay_are_not_shuffled_again(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    moved, settle = [], vector_codes.bucketed
    try:
        vector_codes.bucketed = lambda rows, by, buckets: (lambda t: (moved.append(t.count()), t)[1])(settle(rows, by, buckets))
        train(df, parts=2, size=8, rounds=3)
    finally:
        vector_codes.bucketed = settle
    assert moved[0] == 800 and len(moved) == 3 and all(0 < n < 400 for n in moved[1:])


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5], 1, "x"), (1, [0.5, -0.5], 1, "x"), (2, None, 1, "y"), (3, [None, 1.0], 2, "y"), (4, [nan, 1.0], None, "y"), (5, [inf, 0.0], None, "y"), (None, [1.0], None, None), (7, [], 2, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, codes int, error string")
    books = train(df, parts=2, size=64, rounds=2)
    assert books.entries.shape == (2, 4, 1)  # rows 1, 1, 7 and the one without an id
    got = encode(df, books, carry=[F.col("codes"), F.col("error").alias("e")]).collect()
    assert sorted((str(r["id"]), r["codes"], r["error"], r["carried"]["e"]) for r in got) == [("1", [0, 0], 0, "x"), ("1", [0, 0], 0, "x"), ("7", [2, 2], 0, "z"), ("None", [3, 2], 0, None)]
    assert encode(df.limit(0), books).collect() == [] and train(df.limit(0)).entries.size == 0
    with pytest.raises(Exception, match="fit in a long"):
        train(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="longer than the codebooks"):
        encode(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>"), books).collect()


def test_large_numbers_are_exact():
    books = Codebooks(np.array([[[0, 0], [1 << 40, 1]]]), 1)
    best, apart = vector_codes._nearest(np.array([[1 << 40, 3]]), books.entries[0])
    assert best.tolist() == [1] and list(apart) == [4]
