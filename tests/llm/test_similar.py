import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm import similar
from codestrata.llm.similar import similar_duplicates, similarity


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(docs):
    """(id, text) -> (id, smallest id of its component), by trying all pairs."""
    sets, label = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                label[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return sorted(((k, least[find(i)]) for i, (k, _) in enumerate(docs)), key=str)


def edited():
    """Texts with edited copies on both sides of the bound, a chain of edits, and a passage that many share."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(10**6)}"
    texts, passage = [], [word() for _ in range(40)]
    for edits in range(1, 9):
        words = [word() for _ in range(200)]
        texts.append(words)
        for _ in range(3):
            copy = list(words)
            for at in rng.choice(200, edits, replace=False):
                copy[at] = word()
            texts.append(copy)
    chain = [word() for _ in range(150)]
    for _ in range(20):
        chain = list(chain)
        chain[rng.integers(150)] = word()
        texts.append(chain)
    texts += [passage + [word() for _ in range(n)] for n in range(1, 40)]
    return [(100 + k, " ".join(t)) for k, t in enumerate(texts)] + [(1, "A few words"), (2, "a  few WORDS"), (3, "a few"), (4, None), (5, " ")]


def rows_of(found):
    return sorted(((r["doc_id"], r["component_id"]) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame(edited(), "doc_id long, text string")


def test_edited_copies_against_all_pairs(copies):
    wanted = brute(edited())
    assert len({c for _, c in wanted}) < len(wanted) - 30
    assert rows_of(similar_duplicates(copies)) == wanted


def test_documents_against_all_pairs(documents):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert rows_of(similar_duplicates(documents)) == brute(docs)


def test_awkward_rows(awkward, nothing):
    found = similar_duplicates(awkward, carry=tuple(awkward.columns))
    assert rows_of(found) == brute([tuple(r) for r in awkward.select("doc_id", "text").collect()])
    kept = found.filter("kept").collect()
    assert len({r["component_id"] for r in kept}) == len(kept)
    assert similar_duplicates(nothing).collect() == []


def test_near_stage_removes_edited_copies(copies):
    rows = copies.select("doc_id", "text", F.lit("en").alias("lang"))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near(copies.sparkSession, rows, None).collect())
    assert kept == sorted({c for _, c in brute(edited())})


def below_the_bound(n):
    """Copies of one text with three edits each: two of them are alike, but by less than the bound."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(n):
        words = list(base)
        for at in 20 * rng.choice(10, 3, replace=False) + rng.integers(5, 15, 3):
            words[at] = f"edit{k}_{at}"
        texts.append((k, " ".join(words)))
    return texts


def test_a_group_below_the_bound_makes_no_pairs(spark, monkeypatch):
    sizes, written = [], similar.written

    def counting(df):
        table = written(df)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(similar, "written", counting)
    docs = below_the_bound(250)
    assert rows_of(similar_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert max(sizes) < 250 * 249 / 8


@pytest.mark.parametrize("chunk, size", [(4, 4 << 20), (2048, 3000), (3, 2000)])
def test_shards_and_bodies_of_many_chunks(spark, monkeypatch, chunk, size):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(similar, "CHUNK_BYTES", size)
    monkeypatch.setattr(similar, "COUNTED", 1)
    docs = edited() + [(k + 1000, t) for k, t in below_the_bound(25)] + edited()[:8]
    assert rows_of(similar_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_similarity():
    a, b = np.arange(10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert similarity(a, b) == 0.9 and similarity(a, a) == 1 and similarity(a, b + np.uint64(50)) == 0
