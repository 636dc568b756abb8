from pyspark.sql import functions as F

from codestrata.llm.language_id import identify_languages


def covered(runs, n):
    """Whether the runs go over n words without a gap, and neighbours differ."""
    ends = [0, *(r["end"] for r in runs)]
    return [r["start"] for r in runs] == ends[:-1] and ends[-1] == n and all(a["lang"] != b["lang"] for a, b in zip(runs, runs[1:]))


def test_both_languages_of_a_switched_text_come_back(spark, documents):
    long = documents.filter("length(text) > 400")
    first, second = (long.filter(F.col("lang") == k).orderBy("doc_id").first()["text"].split()[:40] for k in ("en", "de"))
    odd = [(10**9, " ".join(["12", *first, "--", *second, "!!"])), (10**9 + 1, None), (10**9 + 2, " 1 2 "), (10**9 + 3, "")]
    docs = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")))
    rows = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    runs = rows[10**9]["runs"]
    assert covered(runs, 83) and all(0 < r["score"] <= 1 for r in runs)
    spoken = [r["lang"] for r in runs for _ in range(r["start"], r["end"])]
    assert spoken[:41].count("en") > 36 and spoken[42:].count("de") > 36
    assert rows[10**9 + 1]["runs"] == rows[10**9 + 3]["runs"] == [] and [tuple(r) for r in rows[10**9 + 2]["runs"]] == [(0, 2, "und", 0.0)]
    for r in documents.select("doc_id", "text").collect():
        own = rows[r["doc_id"]]
        assert covered(own["runs"], len((r["text"] or "").split()))
        if len(own["runs"]) == 1:
            assert own["runs"][0]["lang"] == own["lang_pred"] and abs(own["runs"][0]["score"] - own["score"]) < 1e-9
    unlearned = identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).filter(F.col("doc_id") == 10**9).first()
    assert [tuple(r) for r in unlearned["runs"]] == [(0, 83, "und", 0.0)]


def test_empty_table(nothing):
    assert identify_languages(nothing).collect() == []
