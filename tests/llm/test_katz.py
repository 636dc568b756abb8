import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codestrata.llm import katz
from codestrata.llm.katz import RELIABLE, backoff, good_turing, score_texts


def words_of(text):
    return (text or "").encode().lower().split()


def brute(docs):
    """Word for word: base score, known tokens and Katz score of each document."""
    split = [(k, words_of(t)) for k, t in docs]
    held = {k for k, _ in split if k is not None and zlib.crc32(str(k).encode()) % 7 == 2}
    train_docs = [w for k, w in split if k not in held]
    uni = Counter(x for w in train_docs for x in [*w, None])
    n, v = sum(uni.values()), len(uni)
    pair = Counter((a, b) for w in train_docs for a, b in zip([0, *w], [*w, None]))
    spectrum = Counter(pair.values())
    d = good_turing(np.array([spectrum[r] for r in range(RELIABLE + 2)]))
    p1 = {x: (c + 1) / (n + v + 1) for x, c in uni.items()}  # one class more: all unseen words
    p1_other = 1 / (n + v + 1)
    after = {}
    for (a, b), r in pair.items():
        after.setdefault(a, []).append((b, r))
    state = {}
    for a, own in after.items():
        c = sum(r for _, r in own)
        mass = sum(r * (d[r] if r <= RELIABLE else 1) for _, r in own)
        scale = 1 / c if mass / c <= 1 - 1e-9 else 1 / (c + 1)
        state[a] = scale, (1 - mass * scale) / (1 - sum(p1[b] for b, _ in own))
    out = {}
    for k, w in split:
        base = score = 0.0
        for a, b in zip([0, *w], [*w, None]):
            base += math.log10((uni[b] + 1) / (n + v + 1))
            scale, alpha = state.get(a, (1, 1))
            r = pair[(a, b)]
            score += math.log10(r * (d[r] if r <= RELIABLE else 1) * scale if r else alpha * p1.get(b, p1_other))
        out.setdefault(k, []).append((k in held, len(w) + 1, sum(uni[x] > 0 for x in [*w, None]), n, base, score))
    return out


def compare(df, docs):
    wanted, rows = brute(docs), df.collect()
    assert len(rows) == len(docs)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]))
    for k, own in wanted.items():
        for a, b in zip(sorted(own), sorted(got[k])):
            assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)


def test_against_brute_force(documents):
    some = documents.filter(F.octet_length("text") < 3000)
    compare(score_texts(some), [tuple(r) for r in some.select("doc_id", "text").collect()])


def test_awkward_rows(awkward, nothing):
    short = awkward.filter("doc_id IS NULL OR doc_id <> 7")
    compare(score_texts(short), [tuple(r) for r in short.select("doc_id", "text").collect()])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in score_texts(awkward).collect())
    assert score_texts(nothing).collect() == []


def test_no_training_text(spark):
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 7 == 2)
    (r,) = score_texts(spark.createDataFrame([(held, "never seen")], "doc_id long, text string")).collect()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"])


def test_many_shards_and_groups(documents, monkeypatch):
    monkeypatch.setattr(katz, "SHARD_ENTRIES", 500)
    monkeypatch.setattr(katz, "GROUP_TOKENS", 3_000)
    some = documents.filter(F.octet_length("text") < 1500)
    compare(score_texts(some), [tuple(r) for r in some.select("doc_id", "text").collect()])


def test_probabilities_of_a_history_sum_to_one():
    rng = np.random.default_rng(5)
    for discounts in (np.ones(RELIABLE + 1), np.array([1, 0.4, 0.6, 0.8, 0.9, 0.95])):
        types = rng.integers(1, 50, 300)
        for followers in (1, 7, 300):
            r = rng.integers(1, 12, followers)
            seen = rng.choice(300, followers, replace=False)
            whole = int(types.sum()) + 300 + 1
            (scale,), (alpha,) = backoff(np.array([r.sum()]), [np.array([(r == k).sum()]) for k in range(1, RELIABLE + 1)], np.array([(types[seen] + 1).sum()]), discounts, whole)
            share = alpha * np.append(types + 1, 1) / whole
            share[seen] = np.where(r <= RELIABLE, r * discounts[np.minimum(r, RELIABLE)], r) * scale
            assert (share > 0).all() and abs(share.sum() - 1) < 1e-12


def test_better_than_unigrams_on_held_out_text(documents):
    rows = score_texts(documents).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
