from collections import Counter

import corpus_pipeline
from codestrata.llm.language_id import identify_languages
from tests.llm.test_exact_and_mix import LOWER, brute_targets
from tests.llm.test_similar import brute as similar_components


def key(r):
    return tuple(map(str, r))


def test_every_stage_against_brute_force(spark, documents):
    from codestrata.llm.common import written

    tables = [documents]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], None)))
    docs, spoken, exact, near, mix, packed = [t.collect() for t in tables]
    assert all(t.columns == documents.columns for t in tables[:-1])

    labels = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_languages(documents).collect()}
    assert sorted(map(key, spoken)) == sorted(key(d) for d in docs if labels[d["doc_id"]][0] != "und" and labels[d["doc_id"]][1] >= corpus_pipeline.LEAST_SCORE)
    assert len(spoken) > 0.95 * len(docs)

    last = {}
    for d in spoken:
        t = d["text"].translate(LOWER)
        last[t] = max(last.get(t, d["doc_id"]), d["doc_id"])
    assert sorted(map(key, exact)) == sorted(key(d) for d in spoken if last[d["text"].translate(LOWER)] == d["doc_id"])

    heads = {c for _, c in similar_components([(d["doc_id"], d["text"]) for d in exact])}
    assert sorted(map(key, near)) == sorted(key(d) for d in exact if d["doc_id"] in heads)

    sizes = {d["doc_id"]: len(d["text"].encode().split()) for d in near}
    source = {d["doc_id"]: d["source"] for d in near}
    totals, taken = Counter(), Counter()
    for k, n in sizes.items():
        totals[source[k]] += n
    copies = Counter(d["doc_id"] for d in mix)
    assert set(map(key, mix)) <= set(map(key, near)) and max(copies.values()) <= 3
    for k, n in copies.items():
        taken[source[k]] += n * sizes[k]
    largest = {s: max(sizes[k] for k in sizes if source[k] == s) for s in totals}
    for s, t in brute_targets(dict(totals)).items():
        assert abs(taken[s] - t) <= 2 * largest[s]

    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    filled = {}
    for r in packed:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.CAPACITY


def test_awkward_rows_and_empty_tables(spark, awkward, nothing):
    from codestrata.llm.common import written

    for table in (awkward, nothing):
        rows = table
        for _, stage in corpus_pipeline.STAGES:
            before, rows = rows, written(stage(spark, rows, None))
        if table is nothing:
            assert rows.count() == 0
        else:
            assert before.columns == awkward.columns
            assert {r["doc_id"] for r in rows.collect()} <= {r["doc_id"] for r in awkward.collect()}


def test_two_results_over_one_folder_are_both_whole(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).write.parquet(f"{tmp_path}/documents.parquet")
    first, second = (corpus_pipeline.run(spark, str(tmp_path)) for _ in range(2))
    assert sorted(map(key, first.collect())) and sorted(r["doc_id"] for r in first.collect()) == sorted(r["doc_id"] for r in second.collect())


def test_the_next_stage_removes_what_rows_no_longer_need(spark, documents):
    from codestrata.llm import common

    known = set(common.WRITTEN)
    rows = corpus_pipeline.exact(spark, documents, None)
    tables = common.WRITTEN - known
    again, path = common.written_at(rows)
    n = rows.count()
    corpus_pipeline.mix(spark, rows, None)  # unwritten rows still read their tables
    assert rows.count() == n > 0
    corpus_pipeline.mix(spark, again, None)
    assert tables and not tables & common.WRITTEN and path in common.WRITTEN
