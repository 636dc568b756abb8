import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.llm.packed import pack, pack_bits, pack_sorted, unpack, unpack_bits, unpack_sorted
from codestrata.llm.substring_dedup import Block, among, remove_repeats, window_sums
from codestrata.llm.top_k import exact_top_k


def brute_top_k(rows, k=10):
    vectors = [(i, np.floor(np.asarray(v, np.float64) * 1024)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in vectors), default=0)
    vectors = [(i, np.pad(v, (0, width - len(v)))) for i, v in vectors]
    out = []
    for a, (i, q) in enumerate(vectors):
        if i % 100 == 0:
            best = sorted((-int(q @ v), j) for b, (j, v) in enumerate(vectors) if a != b)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 100 == 0, pivots=8, block=3).collect()))


def test_top_k_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(df) == brute_top_k([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_top_k_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(1, 60)]
    rows += [(0, [1.0, 0.0, 0.0, 0.0]), (100, [0.0] * 4), (200, [0.5, 0.5]), (300, None), (400, [1.0, None]), (500, [float("nan")] * 4), (600, [float("inf")] * 4), (None, [1.0] * 4), (700, [])]
    rows += [(k, [0.25, 0.5, 0.75, 1.0]) for k in range(61, 99)] + [(0, [1.0, 0.0, 0.0, 0.0])] * 2  # ties and repeated rows
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    assert found(df) == brute_top_k(rows)
    assert found(df.limit(0)) == [] and found(df.filter("vec_id = 0").limit(1)) == []


def brute_removed(rows, window):
    """rows in the order in which windows count as earlier."""
    seen, out = set(), []
    for k, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out.append((k, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=str)


def cleaned(df, window):
    rows = remove_repeats(df, window).collect()
    for r in rows:
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows), key=str)


def test_substrings_against_brute_force(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    for window in (20, 3):
        assert cleaned(documents, window) == brute_removed(rows, window)


def test_substrings_of_awkward_rows(awkward, nothing):
    rows = sorted(((r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()), key=lambda r: -1 if r[0] is None else r[0])
    assert cleaned(awkward, 3) == brute_removed(rows, 3)
    assert remove_repeats(nothing).collect() == []


def test_values_among_known_ones():
    rng = np.random.default_rng(3)
    for bits in (6, 20, 64):
        known = np.unique(rng.integers(0, 2**bits, 300, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64 - 1, 300, dtype=np.uint64, endpoint=True))
        values = np.concatenate([known[::3], known[1::3] + np.uint64(1), rng.integers(0, 2**min(bits + 1, 63), 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert np.array_equal(among(values, known), np.isin(values, known))
    assert not among(known, known[:0]).any() and not len(among(known[:0], known))


@pytest.mark.parametrize("length", [0, 19, 20, 40_000])
def test_window_sums(length):
    rng = np.random.default_rng(4)
    values, factors = rng.integers(0, 2**63, length, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
    wanted = [sum(int(v) * int(f) for v, f in zip(values[k : k + 20], factors)) % 2**64 for k in range(max(0, length - 19))]
    assert window_sums(values, factors).tolist() == wanted


def test_cells_take_less_time_than_their_order():
    """What a block did for its cells before: their order as well, once a sketch row and step."""
    rows = pa.table({"id": pa.array([1]), "tie": pa.array([1]), "text": [" ".join(map(str, np.random.default_rng(6).integers(0, 10**6, 400_000)))]})
    block = Block(rows, 20)
    x = block.hashes[0] >> np.uint64(34)

    def least(work):
        took = []
        for _ in range(3):
            began = time.thread_time()
            result = work()
            took.append(time.thread_time() - began)
        return min(took), result

    now, (cells, more) = least(lambda: block.cells(0, 30))
    before, (values, _, counts) = least(lambda: np.unique(x, return_inverse=True, return_counts=True))
    assert np.array_equal(cells, values) and np.array_equal(more, counts > 1)
    assert now < before


def test_packed_arrays_come_back():
    rng = np.random.default_rng(4)
    for x in (np.zeros(0, np.uint64), np.array([0, 0, 2**64 - 1], np.uint64), rng.integers(0, 2**63, 1000, np.uint64), np.arange(300, dtype=np.uint64)):
        assert (unpack(pack(x)) == x).all() and (unpack_sorted(pack_sorted(np.sort(x))) == np.sort(x)).all()
        assert (unpack_bits(pack_bits(x % np.uint64(2) == 1)) == (x % np.uint64(2) == 1)).all()


@pytest.mark.parametrize("large", [1e6, 1e9])
def test_scores_beyond_what_floats_hold(spark, large):
    rows = [(k, [large, k / 1024, -large / 3 * (k % 5)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {k: [int(np.floor(1024 * x)) for x in v] for k, v in rows}
    if large > 1e7:
        with pytest.raises(Exception, match="does not fit in a long"):
            exact_top_k(df, F.col("vec_id") % 10 == 0).collect()
        return
    got = {}
    for r in exact_top_k(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 60, 10):
        want = sorted(((sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q), key=lambda x: (-x[0], x[1]))[:10]
        assert got[q] == [(k, score) for score, k in want]
