import random
import zlib
from collections import Counter

from codestrata.llm import spelling
from codestrata.llm.spelling import group_variants, words_of

SCHEMA = "word string, n long, n_near string, root int"


def apart(a, b):
    """One insertion, deletion or replacement."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def by_hand(words, least_length=6, least_n=5, times=5):
    kept = {w: n for w, n in words.items() if len(w) >= least_length and n >= least_n}
    near = {w: [v for v in kept if apart(w, v)] for w in kept}
    form = {}
    for w, n in kept.items():
        best = min(near[w], key=lambda v: (-kept[v], v), default=None)
        form[w] = best if best is not None and kept[best] >= times * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], kept.get(form[w]), root(w)) for w, n in kept.items()}


def got(df):
    rows = [tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def vocabulary(letters="abcdefghü"):
    rng, words = random.Random(5), {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 11)))
        n = rng.choice([5, 30, 200, 5000])
        words[w] = n
        for _ in range(8):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
            words.setdefault(v, max(1, n // rng.choice([2, 5, 6, 30])))
            w, n = (v, words[v]) if rng.random() < 0.4 else (w, n)
    return words


def test_all_pairs_for_any_number_of_symbols(spark):
    words = vocabulary()
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], SCHEMA)
    want = by_hand(words)
    assert any(w[5] not in (w[0], w[3]) for w in want), "chains of more than one step"
    for symbols in (None, 1, 3, 40):
        assert got(group_variants(df, symbols=symbols)) == want


def test_very_long_words_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 7)
    monkeypatch.setattr(spelling, "TOGETHER", 50)
    words = vocabulary()
    assert got(group_variants(spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], SCHEMA))) == by_hand(words)
    monkeypatch.undo()
    long = {"ab" * 2000: 50, "ab" * 2000 + "c": 5, "ab" * 1999 + "b": 7, "ba" * 2000: 9}
    assert got(group_variants(spark.createDataFrame([(w, n, "x", 1) for w, n in long.items()], SCHEMA))) == by_hand(long)


def test_awkward_words(spark):
    rows = [("aaaaaa", 10, "x", 1), ("aaaaaa", 15, "y", 2), ("aaaaab", 125, None, None), ("aaaaac", 125, None, None), (None, 99, None, None), ("short", 99, None, None), ("seldom", 4, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(group_variants(df)) == {("aaaaaa", 25, 2, "aaaaab", 125, "aaaaab"), ("aaaaab", 125, 2, None, None, "aaaaab"), ("aaaaac", 125, 2, None, None, "aaaaac")}
    assert got(group_variants(df.limit(0))) == set()


def test_words_of_texts(spark, awkward, nothing, documents):
    def count(rows):
        found = Counter()
        for r in rows:
            for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
                found[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
        return found

    for docs in (awkward, documents):
        assert {r["word"]: r["n"] for r in words_of(docs).collect()} == count(docs.collect())
    assert words_of(nothing).collect() == []
