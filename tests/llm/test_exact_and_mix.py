import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from codestrata.llm.exact_dedup import exact_dedup
from codestrata.llm.mixing import mix_sources, mixed
from codestrata.llm.token_counts import TokenRollup

LOWER = {ord(c): ord(c) + 32 for c in map(chr, range(65, 91))}


def brute_classes(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[(t or "").translate(LOWER)].append(k)
    out = []
    for own in groups.values():
        known = [k for k in own if k is not None]
        keep = max(known) if known else None
        out += [(k, keep, len(own)) for k in own]
    return sorted(out, key=str)


def test_exact_dedup_against_brute_force(documents, awkward, nothing):
    for docs in (documents, awkward, awkward.union(awkward)):
        found = exact_dedup(docs, carry=["text"]).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=str) == brute_classes([(d["doc_id"], d["text"]) for d in docs.select("doc_id", "text").collect()])
        kept = defaultdict(int)
        for r in found:
            kept[(r["carried"]["text"] or "").translate(LOWER)] += r["kept"]
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        assert set(kept.values()) == {1}
    assert exact_dedup(nothing).collect() == []


def test_long_texts_that_differ_late(spark):
    base = "word " * 200_000
    rows = [(1, base), (2, base), (3, base[:-1] + "x"), (4, "v" + base[1:]), (5, base + "y")]
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    words, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = words - sum(fixed.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= cap * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_comes_near_its_targets(documents, awkward, nothing):
    for docs in (documents, awkward):
        texts = {}
        for d in docs.collect():
            texts.setdefault(d["source"], []).append(len((d["text"] or "").encode().split()))
        targets = brute_targets({s: sum(v) for s, v in texts.items()})
        rows = mix_sources(docs, carry=["source"]).collect()
        assert len(rows) == docs.count()
        taken = defaultdict(int)
        for r in rows:
            s = r["carried"]["source"]
            assert abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s]) and r["source_size"] == sum(texts[s])
            assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
            taken[s] += r["taken"]
        for s, t in targets.items():
            assert abs(taken[s] - t) <= 2 * max(texts[s])
        assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs, carry=["source"]).collect()))
    mix = mixed(documents)
    assert mix.columns == documents.columns
    assert mix.count() == sum(r["copies"] for r in mix_sources(documents).collect())
    assert mix_sources(nothing).collect() == [] and mixed(nothing).collect() == []


def test_rollup_commits_once(spark, tmp_path):
    rows = [("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", 7, None), ("insert", None, None, "v1", None, None), ("insert", "b", "de", "v2", 3, None)]
    schema = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long"
    rollup = TokenRollup(spark, str(tmp_path / "rollup"))
    first = spark.createDataFrame(rows, schema)
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    assert rollup.commit("b2", spark.createDataFrame([("delete", "b", "de", "v2", 3, None), ("revise", "a", "en", "v1", 4, 7)], schema).withColumn("docs", F.lit("clash")))
    assert rollup.commit("empty", first.limit(0))
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted([("a", "en", "v1", 2, 9), (None, None, "v1", 1, 0)], key=str)
    for wrong in ("upsert", None):
        try:
            rollup.commit("b3", spark.createDataFrame([(wrong, "a", "en", "v1", 1, 0)], schema))
        except Exception as e:
            assert "unknown op" in str(e)
        else:
            raise AssertionError("a batch with an unknown op was committed")
    assert not rollup.committed("b3")


def test_digest_of_the_query(spark, documents):
    from codestrata.llm.queries import op6_exact_dedup

    got = {r["doc_id"]: r["text_sha256"] for r in op6_exact_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d["doc_id"]: hashlib.sha256((d["text"] or "").translate(LOWER).encode()).hexdigest() for d in documents.collect()}


def test_both_ways_of_the_first_join(documents, monkeypatch):
    from codestrata.llm import exact_dedup as module

    wanted = sorted(map(str, exact_dedup(documents).collect()))
    monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    assert sorted(map(str, exact_dedup(documents).collect())) == wanted


def test_of_two_writers_of_a_batch_one_commits(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("insert", "a", "en", "v1", 5, None)], "op string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long")
    first, second = (TokenRollup(spark, str(tmp_path / "shared")) for _ in range(2))
    monkeypatch.setattr(second, "committed", lambda batch_id: False)  # it looked before the first had committed
    assert first.commit("b1", rows) and not second.commit("b1", rows)
    assert [tuple(r) for r in first.totals().collect()] == [("a", "en", "v1", 1, 5)]


def test_a_lost_writers_batch_can_be_committed_again(spark, tmp_path):
    rows = spark.createDataFrame([("insert", "a", "en", "v1", 5, None)], "op string, source string, lang string, tokenizer_version string, n_tokens long, old_n_tokens long")
    rollup = TokenRollup(spark, str(tmp_path / "lost"))
    assert rollup.totals().count() == 0
    (tmp_path / "lost" / "_commits").mkdir(parents=True)
    (tmp_path / "lost" / "_commits" / "b1").touch()
    assert rollup.totals().count() == 0 and rollup.commit("b1", rows) and not rollup.commit("b1", rows)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 5)]
