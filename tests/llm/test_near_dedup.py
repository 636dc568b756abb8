import numpy as np
import pytest
import xxhash

from codestrata.llm import components as steps
from codestrata.llm.components import components
from codestrata.llm.near_dedup import BKTree, fingerprint, near_duplicates, simhash_links


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=2):
    """pairs: (id, fingerprint); the smallest id reachable from each row."""
    label = list(range(len(pairs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                label[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(pairs):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(k, least[r])
    return sorted(((k, p, least[find(i)]) for i, (k, p) in enumerate(pairs)), key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in df.collect()), key=str)


def test_against_brute_force(documents):
    docs = documents.select("doc_id", "text").collect()
    assert rows_of(near_duplicates(documents)) == brute_components([(d["doc_id"], brute_print(d["text"])) for d in docs])


def test_awkward_rows(awkward, nothing):
    found = near_duplicates(awkward)
    docs = awkward.select("doc_id", "text").collect()
    assert rows_of(found) == brute_components([(d["doc_id"], brute_print(d["text"])) for d in docs])
    kept = found.filter("kept").collect()
    assert len({r["component_id"] for r in kept}) == len(kept)
    assert near_duplicates(nothing).collect() == []


@pytest.fixture
def many_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_are_few_files(spark, many_tasks, monkeypatch):
    files, written = [], steps.written

    def counting(df):
        table = written(df)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(steps, "written", counting)
    links = spark.range(300).selectExpr("id + 1 AS a", "id - id % 5 AS b")
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(k, 0) for k in range(1, 301)}
    assert max(files[1:]) == 1
    monkeypatch.setattr(steps, "ROWS_A_TASK", 100)
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(k, 0) for k in range(1, 301)}


def test_links_lose_no_near_fingerprint(spark):
    rng = np.random.default_rng(7)
    prints = {int(x) for x in rng.integers(0, 2**64, 150, dtype=np.uint64)} | {0, 2**64 - 1}
    for p in list(prints)[:60]:
        for _ in range(6):  # chains of near fingerprints
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = components(simhash_links(spark.createDataFrame(signed, "fingerprint long"))).collect()
    root = {r["node"]: r["root"] for r in links}
    label = {p: root.get(p, p) for (p,) in signed}
    brute = {k: c for k, _, c in brute_components([(p, p % (1 << 64)) for (p,) in signed])}
    assert {frozenset(k for k in label if label[k] == v) for v in label.values()} == {frozenset(k for k in brute if brute[k] == v) for v in brute.values()}


@pytest.mark.parametrize("leaf", [1, 16, 1000])
def test_bk_tree_finds_what_a_scan_finds(leaf):
    rng = np.random.default_rng(1)
    prints, seekers = np.unique(rng.integers(0, 2**12, 500, dtype=np.uint64)), rng.integers(0, 2**12, 200, dtype=np.uint64)
    found = {(int(m), int(s)) for members, near in BKTree(prints, leaf).search(seekers, 2) for m, s in zip(members, near)}
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(prints[:, None] ^ seekers) <= 2))))


def test_fingerprint_of_texts_of_every_length():
    for text in ("", "One", "one TWO", "one two three", "a b c d e f g", "x " * 250_000):
        if len(text) < 1000:
            assert fingerprint(text) == brute_print(text)
    assert fingerprint("x " * 250_000) == brute_print("x x x")
