import numpy as np
from pyspark.sql import functions as F

from codestrata.llm.language_id import Emissions, Field, fit_field, forward_backward, identify_languages, label_texts, training_texts, word_features
from codestrata.llm.quality import NAMES, Forest, fit_forest, score_quality, statistics

SF = "/root/testdata/sf0.001"


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    sizes, moves = np.array([4, 2, 2, 1]), rng.normal(size=(3, 3))
    emissions = rng.normal(size=(sizes.sum(), 3))
    label, expected = forward_backward(emissions, sizes, moves)
    at, all_moves = 0, np.zeros((3, 3))
    for n in sizes:
        total, weight = np.zeros((n, 3)), 0.0
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(emissions[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            weight += w
            for t, y in enumerate(path):
                total[t, y] += w
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(emissions[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))) / weight
            for a, b in zip(path, path[1:]):
                all_moves[a, b] += w
        assert np.allclose(label[at : at + n], total / weight)
        at += n
    assert np.allclose(expected, all_moves)


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = ["the", "été", "x", "Straße".lower()]
    together = word_features(words, [{"the"}, {"x"}])
    for i, w in enumerate(words):
        alone = word_features([w], [{"the"}, {"x"}])[0]
        assert sorted(together[0][together[1] == i]) == sorted(alone)


def test_languages_are_found_in_held_out_text(documents, awkward, nothing):
    found = identify_languages(documents).drop("carried").join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == documents.count() and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    rows = {r["doc_id"]: r for r in identify_languages(awkward).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (3, 4, 8, 9)) and rows[None]["held_out"] is False
    assert rows[7]["lang_pred"] in ("en", "fr", "de") and len(rows) == awkward.select("doc_id").distinct().count()
    assert identify_languages(nothing).collect() == []
    unlabelled = identify_languages(documents.withColumn("lang", F.lit(None).cast("string"))).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0)


def test_switched_text_is_labelled_word_by_word(documents):
    rows = documents.select("lang", "text").collect()
    field = fit_field([(r["lang"], r["text"]) for r in rows if r["text"]])
    assert isinstance(field, Field)
    first, second = (next(r for r in rows if r["lang"] == k and len(r["text"]) > 400) for k in ("en", "de"))
    words = first["text"].split()[:40] + second["text"].split()[:40]
    known = Emissions(field)
    known.learn(set(words))
    at = np.array([known.row_of[w] for w in words])
    label, _ = forward_backward(known.rows[at[at > 0]], np.array([(at > 0).sum()]), field.moves)
    truth = np.array([field.languages.index("en")] * 40 + [field.languages.index("de")] * 40)[at > 0]
    assert (label.argmax(axis=1) == truth).mean() > 0.9
    assert label_texts(field, ["", None, "123 !!"], known)[0] == ["und"] * 3


def brute_score(forest: Forest, row):
    total = forest.base
    for feature, bound, leaf in zip(forest.feature, forest.bound, forest.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + (row[feature[node]] > bound[node])
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_flattened_trees_score_like_a_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    forest = fit_forest(x, y, trees=30)
    assert np.allclose(forest.score(x), [brute_score(forest, r) for r in x])
    fresh = rng.normal(size=(600, 4))
    assert ((forest.score(fresh) >= 0.5) == ((fresh[:, 0] > 0) ^ (fresh[:, 2] > 0.3))).mean() > 0.95
    assert fit_forest(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (fit_forest(x, np.ones(600)).score(x) > 0.9).all()


def test_quality_of_held_out_documents(spark, awkward, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    empty = score_quality(awkward, labels.limit(0)).collect()
    assert len(empty) == awkward.count() and all(r["score"] == 0.5 and r["predicted"] == 1 for r in empty)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 1)], labels.schema))
    assert score_quality(awkward, odd).count() == awkward.count() and score_quality(nothing, odd).collect() == []


def test_statistics_of_odd_texts():
    for text in (None, "", " ", "\n\n", "A", "é" * 10, "a b " * 100_000):
        assert np.isfinite(statistics(text)).all() and len(statistics(text)) == len(NAMES)


def test_every_labelled_language_is_learned(spark):
    rows = [(k, f"w{k % 70}x " * 30 if k % 70 else "rare " * 9000, f"l{k % 70:02}") for k in range(280)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = training_texts(docs, 4, 2, 100, 70, 1000, "doc_id", "text", "lang")
    assert fit_field(texts, max_words=7000, rounds=2).languages == [f"l{k:02}" for k in range(70)]
    # Beyond the languages of a full field there are fewer texts, words and features, but every language is predicted.
    rows = [(k, " ".join(f"{chr(97 + k % 5)}{chr(97 + k % 8)}{w}" for w in "mno") + " ", f"l{k % 40:02}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(training_texts(docs, 4, 2, 6, 8, 1000, "doc_id", "text", "lang")) == 40
    found = identify_languages(docs, per_language=20, max_languages=8, max_words=12_000).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 400 and all(r["lang_pred"] == r["lang"] for r in found)
    few = fit_field([(r[2], r[1]) for r in rows], max_words=10, rounds=1, max_languages=2)
    assert len(few.languages) == 40 and few.weights.shape == ((1 << few.bits) + 40, 40) and few.bits < 17
