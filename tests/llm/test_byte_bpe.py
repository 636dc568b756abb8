import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from codestrata.llm import byte_bpe, queries

from .conftest import SF

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    for n in (1, 2, 3, 64, 1000):
        keys = [f"key {k}".encode() for k in range(n)]
        found = byte_bpe.PerfectHash.of(keys)
        assert sorted(found.key_at.tolist()) == list(range(n))
        assert found.candidates(keys).tolist() == list(range(n))
        assert all(0 <= c < n for c in found.candidates([b"stranger", b""]).tolist())


def test_every_code_point_and_long_texts_as_the_library_does(library, monkeypatch):
    tokens = byte_bpe.read_ranks(PATH)
    encoder = byte_bpe.Encoder(tokens, byte_bpe.PerfectHash.of(tokens), PATTERN, remembered=1000)
    monkeypatch.setattr(byte_bpe, "PIECES", 999)
    every = "".join(chr(c) + "a 1" if c % 3 else " " + chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts = [every, "aaaa" * 5000, "\n\n  \t x" * 3000, "zqzqz " * 9000]
    for text in texts:
        assert np.frombuffer(encoder.texts([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.texts(texts)] == [library.encode_ordinary(t) for t in texts]


def test_query_is_the_library(spark, library):
    rows = {r["doc_id"]: r for r in queries.op11_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        text = d["text"] or ""
        ids, r = library.encode_ordinary(text), rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows_and_unknown_ids(spark, awkward, nothing, library):
    bpe = byte_bpe.ByteBPE(spark, PATH, PATTERN)
    found = awkward.withColumn("ids", bpe.encode(F.col("text"))).withColumn("back", bpe.decode(F.col("ids"))).collect()
    assert len(found) == awkward.count()
    for r in found:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["back"]).decode() == (r["text"] or "")
    assert nothing.select(bpe.encode(F.col("text"))).collect() == []
    assert spark.sql("SELECT CAST(NULL AS array<int>) AS ids").select(bpe.decode(F.col("ids"))).first()[0] is None
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.sql("SELECT array(60000) AS ids").select(bpe.decode(F.col("ids"))).collect()
