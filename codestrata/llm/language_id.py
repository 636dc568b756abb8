"""Language of each word, and of the text, by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and the lexicons it stands in; transitions
between neighbouring words' languages are learned. Training sequences switch language in the
middle: stretches of documents of different languages, each word labelled with its document's.
Words are labelled by forward-backward, which gives runs of words of one language; a text's language is the one
with the largest mean probability over its words. Documents of similar length go through forward-backward together,
one numpy step per position.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, given_back, in_fold

FEATURE_BITS, GRAM = 17, 4
FEATURES = 1 << FEATURE_BITS
UNKNOWN = "und"
#: Words labelled together, and words whose features are remembered by a task.
TOGETHER, REMEMBERED = 100_000, 150_000
#: Languages up to which a field has its full size.
MAX_LANGUAGES = 256


def shared_out(bound: int, languages: int, full: int = MAX_LANGUAGES) -> int:
    """A bound on rows that hold a number for each language: beyond ``full`` languages the numbers stay as many."""
    return bound if languages <= full else max(1, bound * full // languages)


def letters(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token.lower()))


def word_features(words: list[str], lexicons: list[set[str]], bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words of letters, and the word of each: the n-grams of 1 to 4 bytes of ^word$, of which
    those that hold ^ or $ are its affixes, and the lexicons it stands in."""
    bounded = [b"^" + w.encode() + b"$" for w in words]
    sizes = np.fromiter(map(len, bounded), np.int64, len(bounded))
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(bounded), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(ends, sizes) - np.arange(len(text))  # bytes left in the word
    features, owners, gram = [], [], np.zeros(len(text), np.uint64)
    for n in range(1, GRAM + 1):
        gram = gram[: len(text) - n + 1] * np.uint64(257) + text[n - 1 :]
        fits = room[: len(gram)] >= n
        features.append((gram[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits))
        owners.append(owner[: len(gram)][fits])
    for k, lexicon in enumerate(lexicons):
        inside = [i for i, w in enumerate(words) if w in lexicon]
        features.append(np.full(len(inside), (1 << bits) + k, np.uint64))
        owners.append(np.array(inside, np.int64))
    return np.concatenate(features).astype(np.int64), np.concatenate(owners)


@dataclass
class Field:
    languages: list[str]
    lexicons: list[set[str]]
    weights: np.ndarray  # features, then lexicons, x languages
    moves: np.ndarray  # log weights, from x to
    bits: int = FEATURE_BITS  # of hashed features

    def emissions(self, words: list[str]) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)))]
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            feature, owner = word_features(part, self.lexicons, self.bits)
            out.append(np.column_stack([np.bincount(owner, self.weights[feature, j], len(part)) for j in range(len(self.languages))]))
        return np.concatenate(out)


class Emissions:
    """Rows of emissions of the tokens met so far; row 0 stands for tokens without a letter."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.rows = np.zeros((1, len(self.field.languages)))

    def learn(self, tokens: set[str]) -> None:
        new = [(t, letters(t)) for t in tokens if t not in self.row_of]
        place = {w: len(self.rows) + k for k, w in enumerate(dict.fromkeys(w for _, w in new if w))}
        self.rows = np.concatenate([self.rows, self.field.emissions(list(place))])
        self.row_of.update((t, place.get(w, 0)) for t, w in new)


def forward_backward(emissions: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences that stand one after another, longest first: the label probabilities of every
    position, and the expected moves over all of them. Positions of equal number go together."""
    step = np.exp(moves)
    local = np.exp(emissions - emissions.max(axis=1, keepdims=True)) if len(emissions) else emissions
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    ahead, behind = np.empty_like(local), np.empty_like(local)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than each position
    for t in range(longest):
        at = starts[: active[t]] + t
        a = local[at] if t == 0 else (ahead[at - 1] @ step) * local[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    behind[starts + sizes - 1] = 1.0
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = (local[at + 1] * behind[at + 1]) @ step.T
        behind[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * behind
    inside = np.ones(len(local), bool)
    inside[starts] = False
    after = np.flatnonzero(inside)
    left, right = ahead[after - 1], local[after] * behind[after]
    scale = ((left @ step) * right).sum(axis=1, keepdims=True)
    return both / both.sum(axis=1, keepdims=True), step * ((left / scale).T @ right)


def switched(texts: list[tuple[str, list[str]]], rng: np.random.Generator, shortest: int = 5, longest: int = 60) -> list[list[tuple[str, str]]]:
    """Sequences of (word, language) that go through one to four stretches of different documents."""
    stretches = []
    for language, words in texts:
        at = 0
        while at < len(words):
            n = int(rng.integers(shortest, longest))
            stretches.append([(w, language) for w in words[at : at + n]])
            at += n
    rng.shuffle(stretches)
    out, at = [], 0
    while at < len(stretches):
        n = int(rng.integers(1, 5))
        out.append([x for s in stretches[at : at + n] for x in s])
        at += n
    return out


def fit_field(texts: Iterable[tuple[str, str]], lexicon_size: int = 1000, max_words: int = 150_000, rounds: int = 30, seed: int = 11, max_languages: int = MAX_LANGUAGES) -> Field | None:
    """Texts with their languages -> a field; None without any word. Adam on the whole sample's gradient. Each language
    has an equal share of the words, so that rare ones are learned too. Beyond ``max_languages`` languages, fewer words of
    each and fewer hashed features keep the field and its gradients as large as at that number; none is left out."""
    rng, taken, held = np.random.default_rng(seed), Counter(), []
    texts = list(texts)
    labelled = len({language for language, _ in texts})
    share = shared_out(max_words, labelled, max_languages) / max(1, labelled)
    for language, text in texts:
        words = [w for w in map(letters, text.split()) if w]
        if labelled > max_languages:
            words = words[: max(1, int(share)) - taken[language]]
        if words and taken[language] < max(1, share):
            held.append((language, words))
            taken[language] += len(words)
    if not held:
        return None
    languages = sorted({language for language, _ in held})
    counts = {k: Counter() for k in languages}
    for language, words in held:
        counts[language].update(words)
    lexicons = [{w for w, n in counts[k].most_common(lexicon_size) if n > 1 and n > 2 * sum(c[w] for j, c in counts.items() if j != k)} for k in languages]
    sequences = sorted(switched(held, rng), key=len, reverse=True)
    number: dict[str, int] = {}
    tokens = np.array([number.setdefault(w, len(number)) for s in sequences for w, _ in s])
    truth = np.array([languages.index(k) for s in sequences for _, k in s])
    sizes = np.array([len(s) for s in sequences])
    n, size = len(languages), len(tokens)
    bits = max(8, shared_out(FEATURES, n, max_languages).bit_length() - 1)
    feature, word = word_features(list(number), lexicons, bits)
    types, width = len(number), (1 << bits) + n
    field = Field(languages, lexicons, np.zeros((width, n)), np.zeros((n, n)), bits)
    seen, moved = np.zeros((types, n)), np.zeros((n, n))
    np.add.at(seen, (tokens, truth), 1.0)
    first = np.zeros(size, bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    after = np.flatnonzero(~first)
    np.add.at(moved, (truth[after - 1], truth[after]), 1.0)
    means = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.weights, field.moves)]
    for k in range(1, rounds + 1):
        by_word = np.column_stack([np.bincount(word, field.weights[feature, j], types) for j in range(n)])
        label, moves = forward_backward(by_word[tokens], sizes, field.moves)
        wrong = seen - np.column_stack([np.bincount(tokens, label[:, j], types) for j in range(n)])
        up = np.column_stack([np.bincount(feature, wrong[word, j], width) for j in range(n)])
        for p, g, (mean, square) in zip((field.weights, field.moves), (up / size - 1e-6 * field.weights, (moved - moves) / size), means):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g**2 - square)
            p += 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return field


#: Runs of a text: first words, words after the last, places of languages (-1: unknown), scores.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def unlabelled(text: str | None) -> Runs:
    """One run of unknown language over all words of a text; none if it has no word."""
    n = len((text or "").split())
    some = int(n > 0)
    return np.zeros(some, np.int64), np.full(some, n), np.full(some, -1), np.zeros(some)


def label_texts(field: Field, texts: list[str | None], known: Emissions) -> tuple[list[str], np.ndarray, list[Runs]]:
    """The language and score of each whole text, and its runs of words of one language. Words without a
    letter belong to the run before them, at the beginning to the one after; a run's score is its
    language's mean probability over its other words."""
    language, score, runs = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""), reverse=True)
    at, (together, remembered) = 0, (shared_out(b, len(field.languages)) for b in (TOGETHER, REMEMBERED))
    while at < len(order):
        split, words = [], 0
        while at < len(order) and (words < together or not split):
            split.append((order[at], (texts[order[at]] or "").split()))
            words += len(split[-1][1])
            at += 1
        if len(known.row_of) > remembered:
            known.forget()
        known.learn(set(chain.from_iterable(tokens for _, tokens in split)))
        rows = ((i, np.fromiter(map(known.row_of.__getitem__, tokens), np.int64, len(tokens))) for i, tokens in split)
        group = [(i, len(r), np.flatnonzero(r), r[r > 0]) for i, r in rows if r.any()]
        if not group:
            continue
        group.sort(key=lambda x: len(x[3]), reverse=True)
        sizes = np.array([len(r) for *_, r in group])
        label, _ = forward_backward(known.rows[np.concatenate([r for *_, r in group])], sizes, field.moves)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(label, starts) / sizes[:, None]
        likeliest = label.argmax(axis=1)
        new = np.ones(len(label), bool)
        new[1:] = likeliest[1:] != likeliest[:-1]
        new[starts] = True
        first = np.flatnonzero(new)
        sure = np.minimum(1.0, np.add.reduceat(label[np.arange(len(label)), likeliest], first) / np.diff(first, append=len(label)))
        place, spoken = np.concatenate([p for _, _, p, _ in group])[first], likeliest[first]
        edges = np.searchsorted(first, [*starts, len(label)])
        for (i, n, *_), m, a, b in zip(group, mean, edges, edges[1:]):
            best = int(m.argmax())
            language[i], score[i] = field.languages[best], min(1.0, m[best])
            runs[i] = np.concatenate([[0], place[a + 1 : b]]), np.append(place[a + 1 : b], n), spoken[a:b], sure[a:b]
    return language, score, [unlabelled(t) if r is None else r for t, r in zip(texts, runs)]


def training_texts(docs: DataFrame, modulus: int, remainder: int, per_language: int, max_languages: int, max_bytes: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Up to ``per_language`` whole texts of each language, by smallest hashed id. Of more than ``max_languages`` languages
    each has fewer, but at least one, so that the texts in all stay as many."""
    usable = docs.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    usable = usable.filter(~in_fold(F.col("id"), modulus, remainder) & (F.octet_length("text") >= 1))
    common = usable.groupBy("lang").agg(F.min(F.octet_length("text")).alias("shortest"))
    languages = common.count()
    per_language = shared_out(per_language, languages, max_languages)
    # A language without a text of max_bytes or less is learned from its shortest ones.
    common = common.select("lang", F.greatest("shortest", F.lit(max_bytes)).alias("most"))
    usable = usable.join(F.broadcast(common), "lang").filter(F.octet_length("text") <= F.col("most")).drop("most")
    # The group limit works on each task's rows before they are shuffled, so a hot language sends as little as any.
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = usable.select("id", "lang").withColumn("place", place).filter(F.col("place") <= per_language).select("id", "lang")
    rows = usable.join(F.broadcast(ids), ["id", "lang"], "left_semi").orderBy(F.xxhash64("id"), "id", "text").limit(per_language * max(languages, max_languages)).collect()
    return [(r["lang"], r["text"]) for r in rows]


def identify_languages(docs: DataFrame, modulus: int = 4, remainder: int = 2, per_language: int = 100, max_languages: int = MAX_LANGUAGES, max_bytes: int = 20_000, max_words: int = 150_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (0 to 1), runs, and struct ``carried``.

    ``runs`` are the languages of all words in order: an array of (start, end, lang, score), each for the words
    (what white space separates, from 0) from start up to but without end. It is empty where there is no word.

    The field learns from text and language of rows outside the held-out fold, crc32(id) mod ``modulus`` =
    ``remainder``: at most ``per_language`` whole texts of at most ``max_bytes`` (or the language's shortest) in each
    language, and ``max_words`` words in all, shared alike. Of more than ``max_languages`` languages each has fewer texts, words and
    features, but at least a text and a word, so none is left out. Only text is an input of a prediction, and all of it. Null text and text without a letter are ``und`` with score 0, as is everything if nothing
    could be learned. Null ids are not held out and not learned from; rows with null language are not
    learned from. Repeated rows get equal rows; ties go to the first language by name. An empty table gives an
    empty result. Other columns are ignored unless carried, inside ``carried``.
    """
    carried = F.struct(*[col(c).alias(c) for c in carry]) if carry else F.struct(F.lit(True).alias("none"))
    field = fit_field(training_texts(docs, modulus, remainder, per_language, max_languages, max_bytes, id_col, text_col, lang_col), max_words=max_words, max_languages=max_languages)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("struct<lang_pred: string, score: double, runs: array<struct<start: int, end: int, lang: string, score: double>>>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Emissions(shared.value) if shared.value else None
        names = pa.array([*(shared.value.languages if shared.value else []), UNKNOWN], pa.string())
        for text in batches:
            texts = text.to_pylist()
            language, score, runs = label_texts(shared.value, texts, known) if shared.value else ([UNKNOWN] * len(texts), np.zeros(len(texts)), [unlabelled(t) for t in texts])
            start, end, spoken, sure = (np.concatenate(x) for x in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 4
            fields = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), names.take(pa.array(spoken % len(names))), pa.array(sure, pa.float64())]
            ends = pa.array(np.cumsum([0, *(len(r[0]) for r in runs)]), pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=["start", "end", "lang", "score"]))
            yield pa.StructArray.from_arrays([pa.array(language, pa.string()), pa.array(score), listed], names=["lang_pred", "score", "runs"])
        given_back()

    found = docs.select(col(id_col).alias(id_col), in_fold(col(id_col), modulus, remainder).alias("held_out"), predicted(col(text_col).cast("string")).alias("found"), carried.alias("carried"))
    return found.select(col(id_col), "held_out", "found.lang_pred", "found.score", "found.runs", "carried")
