import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from codestrata.llm.packing import pack, plan_sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(texts):
    tok = Tokenizer.from_file(PATH)
    return [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


def check(rows, docs, capacity):
    """Pieces give back every document's ids, and sequences are gapless and within the capacity."""
    wanted = sorted(((k, zlib.crc32(v.tobytes())) for k, v in docs), key=str)
    whole, places = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for k, own in by_doc.items():
        for r in sorted(own, key=lambda r: r["start"]):
            whole[k].append((r["start"], r["length"], r["ids"]))
    if len(by_doc) == len(docs):
        assert sorted(((k, zlib.crc32(b"".join(x[2] for x in v))) for k, v in whole.items()), key=str) == wanted
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pack_gives_back_every_document(documents):
    rows = pack(documents, PATH, 4096).collect()
    docs = documents.select("doc_id", "text").collect()
    ids = whole_ids([d["text"] for d in docs])
    n = check(rows, list(zip([d["doc_id"] for d in docs], ids)), 4096)
    assert n <= 1.05 * sum(map(len, ids)) / 4096 + 1
    for r in rows:
        assert r["start"] == r["piece"] * 4096


def test_awkward_rows(awkward, nothing):
    docs = awkward.select("doc_id", "text").collect()
    rows = pack(awkward, PATH, 64).collect()
    check(rows, [(d["doc_id"], i) for d, i in zip(docs, whole_ids([d["text"] for d in docs]))], 64)
    assert sum(r["length"] for r in rows) == sum(map(len, whole_ids([d["text"] for d in docs])))
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert pack(nothing, PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=40))
def test_plan_places_every_piece_once(histogram):
    filled, count = defaultdict(list), defaultdict(int)
    for length, rank, n, first, offset in plan_sequences(histogram, 40):
        assert rank == count[length]
        count[length] += n
        for k in range(n):
            filled[first + k].append((offset, length))
    assert dict(count) == histogram
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 40
    total = sum(k * v for k, v in histogram.items())
    large = sum(v for k, v in histogram.items() if 2 * k > 40)
    assert len(filled) <= max(large, 1.5 * total / 40 + 1) + 1


def test_words_give_the_ids_of_the_whole(documents):
    from codestrata.llm.tokenizing import word_ids

    odd = ["don't STOP", "a<|endoftext|>b", "<|ENDOFTEXT|> <|startoftext|>.", "Ω≈ç√ 123 x y z", "é ́x", "İ. ǅ, ẞ! K.", "it's. 'S, we'LL: x'm.", "... . a.. é. É, Σας Σ. ΑΣ,", ""]
    texts = odd + [r["text"] or "" for r in documents.select("text").collect()]
    words = word_ids(PATH)
    for _ in range(2):
        assert words.texts(texts) == [i[:-1].tobytes() for i in whole_ids(texts)]
