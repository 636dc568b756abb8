import pytest

SF = "/root/testdata/sf0.001"
#: Awkward rows: null and empty texts, ties, repeated rows, clashing names, a very long text.
AWKWARD = [
    (1, "The same Text here", "en", "a", 1, "x"),
    (2, "the SAME text here", "en", "a", 1, "y"),
    (2, "the SAME text here", "en", "a", 1, "y"),
    (3, None, None, None, None, None),
    (4, "", "de", "b", 0, "z"),
    (None, "the same text herE", None, "b", 2, None),
    (5, "É only accents differ é", "fr", None, 3, "q"),
    (6, "é only accents differ é", "fr", None, 3, "q"),
    (7, "long words " * 60_000, "en", "a", 4, "w"),
    (8, " \t\n\x0b ", "en", "b", 4, "w"),
    (9, "!!! ??? 123", "en", "b", 4, "w"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    return spark.createDataFrame(AWKWARD, schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
