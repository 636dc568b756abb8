"""Language-model scores of whole texts by Katz backoff over pairs of words.

Every pair of every word counts, at every size of the corpus: nothing of the model is broadcast or collected but the
number of tokens, the number of types and seven counts of counts.

Documents are read and split once, in groups of some two million tokens. A group is one row of a bucketed table, which is never shuffled: its different
words, its different pairs with their training counts, and in which documents each pair occurs. All else is an exchange
of small packed arrays between groups and shards of a table that is cut by hash range:

1. Words: shards add up the training counts of each word and return the totals.
2. Pairs: shards add up the training counts of each pair, return the totals, and tell one of the groups that the
   pair is its own; counts of counts give the Good-Turing discounts.
3. Histories: each group sums over its own pairs what a history needs to be normalised: its count, how many of its pairs are
   rare, and the counts of the words that follow it. Shards add these up, whole numbers all, and return the history's
   scale and backoff weight.
4. Each group evaluates its tokens: the pair if training has it, else the backoff weight times the word, else times the
   one type that stands for all unseen words. Seen pairs get discounted shares; what discounts leave is spread
   over all other words, so probabilities of every history sum to one exactly.

A word, pair or history is sent once by a group, however often it occurs there, so a hot one is one entry per group. The
number of shards follows the number of entries. Words are known by 64-bit hashes, pairs by 64-bit mixtures of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, col, given_back, in_fold, written
from .packed import pack, pack_bits, pack_sorted, unpack, unpack_bits, unpack_sorted
from .tokenizing import together

#: Stand for the end and the start of a text among word hashes.
END_HASH, START_HASH = np.uint64(2**64 - 1), np.uint64(2**64 - 2)
#: Entries sent to a shard, tokens of a group of texts, words whose hash a task remembers, bytes of text for each bucket of groups.
SHARD_ENTRIES, GROUP_TOKENS, REMEMBERED, BUCKET_BYTES = 1_000_000, 2_000_000, 250_000, 64 << 20
#: Counts above this are not discounted.
RELIABLE = 5

GROUPS = pa.schema(
    [(c, pa.int64()) for c in ("grp", "n_words", "n_pairs")]
    + [(c, pa.binary()) for c in ("words", "word_counts", "history", "word", "pair_counts", "times", "doc")]
    + [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))]
)
GROUPS_SQL = (
    "grp long, n_words long, n_pairs long, words binary, word_counts binary, history binary, word binary, pair_counts binary, times binary, doc binary, "
    "ids array<long>, held array<boolean>, sizes array<long>"
)
#: What a group sends to a shard: sorted keys and packed arrays that go with them.
SENT = pa.schema([("shard", pa.int64()), ("grp", pa.int64()), ("keys", pa.binary()), ("values", pa.list_(pa.binary()))])
SENT_SQL = "shard long, grp long, keys binary, values array<binary>"
#: What comes back, in the order of the keys; ``sums`` has figures of the whole shard, in one of its rows.
BACK = pa.schema([("grp", pa.int64()), ("step", pa.int64()), ("shard", pa.int64()), ("values", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])
BACK_SQL = "grp long, step long, shard long, values array<binary>, sums array<long>"
WORDS, PAIRS, HISTORIES = 0, 1, 2


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pair of word hashes."""
    x = history * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def shards_of(keys: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """The shards on which sorted keys fall and where; shards are equal ranges of keys."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist()
    return [(int(shard[a]), slice(a, b)) for a, b in zip(edges, edges[1:]) if a < b]


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0 to RELIABLE from counts of counts n[0..RELIABLE + 1]; 1 where the data give none in (0, 1]."""
    d = np.ones(RELIABLE + 1)
    if n[1] > 0:
        tail = (RELIABLE + 1) * n[RELIABLE + 1] / n[1]
        for r in range(1, RELIABLE + 1):
            if n[r] > 0 and tail < 1:
                value = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail)
                if 0 < value <= 1:
                    d[r] = value
    return d


def backoff(count: np.ndarray, rare: list[np.ndarray], seen: np.ndarray, discounts: np.ndarray, mass_of_all: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each history: what a seen pair's discounted count is multiplied with, and its backoff weight.

    count: its training tokens; rare[r - 1]: its pairs of count r; seen: add-one counts of the words that follow it,
    of ``mass_of_all``, which has one more for unseen words, so that some mass is always left. A history
    without training tokens backs off whole.
    """
    mass = count - sum(r * (1 - discounts[r]) * n for r, n in enumerate(rare, 1))
    scale = 1 / np.maximum(count, 1)
    full = mass * scale > 1 - 1e-9  # no count was discounted: leave what one more count would have got
    scale = np.where(full, 1 / (count + 1), scale)
    return scale, (1 - mass * scale) * mass_of_all / (mass_of_all - seen)


class Group:
    """What a row of the table of groups says of its words and pairs."""

    def __init__(self, row: dict):
        self.words = unpack_sorted(row["words"])
        self.history, self.word = (f(row[c]).astype(np.int64) for f, c in ((unpack_sorted, "history"), (unpack, "word")))
        self.counts = unpack(row["pair_counts"]).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the pairs, and the pair of each."""
        keys = mixed(self.words[self.history], self.words[self.word])
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def totals(self, back: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of words and of pairs, and which pairs are this group's own."""
        words, pairs = (_of(back, step) for step in (WORDS, PAIRS))
        _, order = self.pairs()
        total, own = np.empty(len(order), np.int64), np.empty(len(order), bool)
        total[order] = np.concatenate([unpack(v[0]) for v in pairs]).astype(np.int64)
        own[order] = np.concatenate([unpack_bits(v[1]) for v in pairs])
        return np.concatenate([unpack(v[0]) for v in words]).astype(np.int64), total, own


def _of(back: list[dict], step: int) -> list[list[bytes]]:
    return [r["values"] for r in sorted((r for r in back if r["step"] == step), key=lambda r: r["shard"])]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def read_groups(docs: DataFrame) -> DataFrame:
    """(id, held, text) -> the table of groups, in one pass over the texts."""

    def row(number: int, ids: list, held: list, texts: list[np.ndarray]) -> tuple:
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        token = np.full(ends[-1] + 1, END_HASH, np.uint64)
        token[-1] = START_HASH
        inside = np.ones(len(token), bool)
        inside[ends - 1] = inside[-1] = False
        token[inside] = np.concatenate(texts)
        words, place = np.unique(token, return_inverse=True)
        word, history = place[:-1], np.empty(len(place) - 1, np.int64)
        history[1:] = word[:-1]
        history[ends - sizes] = place[-1]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        learned = ~np.array(held, bool)[doc]
        key = history * len(words) + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pair = key[starts]
        return (
            number, len(words), len(pair), pack_sorted(words), pack(np.bincount(word[learned], minlength=len(words))), pack_sorted(pair // len(words)), pack(pair % len(words)),
            pack(np.add.reduceat(learned[order].astype(np.int64), starts)), pack(np.diff(starts, append=len(key))), pack(doc[order]), ids, held, sizes.tolist(),
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = Hashes(), TaskContext.get().partitionId() << 32
        ids, held, texts, tokens = [], [], [], 0
        for batch in batches:
            ids_here, held_here, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for some in together(batch.column(2)):
                for text in some:
                    split = words_of(text)
                    texts.append(np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split)))
                    ids.append(ids_here[at])
                    held.append(held_here[at])
                    at, tokens = at + 1, tokens + len(split) + 1
                    if tokens >= GROUP_TOKENS:
                        yield from _table(GROUPS, [row(number, ids, held, texts)]).to_batches()
                        ids, held, texts, tokens, number = [], [], [], 0, number + 1
        if texts:
            yield from _table(GROUPS, [row(number, ids, held, texts)]).to_batches()
        given_back()

    return docs.mapInArrow(read, GROUPS_SQL)


def sent_words(groups: DataFrame, shards: int) -> DataFrame:
    """Each group's words and their training counts, cut by shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = unpack_sorted(r["words"]), unpack(r["word_counts"])
                yield from _table(SENT, [(s, r["grp"], pack_sorted(keys[x]), [pack(counts[x])]) for s, x in shards_of(keys, shards)]).to_batches()

    return groups.select("grp", "words", "word_counts").mapInArrow(send, SENT_SQL)


def sent_pairs(groups: DataFrame, shards: int) -> DataFrame:
    """Each group's pairs and their training counts, cut by shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                group = Group(r)
                keys, order = group.pairs()
                counts = group.counts[order]
                yield from _table(SENT, [(s, r["grp"], pack_sorted(keys[x]), [pack(counts[x])]) for s, x in shards_of(keys, shards)]).to_batches()

    return groups.select("grp", "words", "history", "word", "pair_counts").mapInArrow(send, SENT_SQL)


def added_up(sent: DataFrame, step: int) -> DataFrame:
    """Training counts of each key over all groups; ``sums``: tokens, types and counts of counts of the shard."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        own = sorted(rows.to_pylist(), key=lambda r: r["grp"])
        keys, counts = [unpack_sorted(r["keys"]) for r in own], np.concatenate([unpack(r["values"][0]) for r in own]).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(place, counts, len(first)).astype(np.int64)
        owned = np.zeros(len(place), bool)
        owned[first] = True
        sums = [int(total.sum()), int((total > 0).sum()), *np.bincount(np.minimum(total, RELIABLE + 2), minlength=RELIABLE + 3).tolist()]
        back = [[pack(t), pack_bits(o)] for t, o in zip(np.split(total[place], ends), np.split(owned, ends))]
        return _table(BACK, [(r["grp"], step, key[0].as_py(), b, None if k else sums) for k, (r, b) in enumerate(zip(own, back))])

    return sent.groupBy("shard").applyInArrow(add, BACK_SQL)


def _sums(back: DataFrame) -> list[int]:
    """The figures of all shards together: one row."""
    n = RELIABLE + 5
    return list(back.agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)).alias(f"s{k}") for k in range(n)]).first())


def weighed_histories(groups: DataFrame, back: DataFrame, shards: int, discounts: np.ndarray, mass_of_all: int) -> DataFrame:
    """Scale and backoff weight of the histories of each group."""

    def send(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        group = Group(rows.to_pylist()[0])
        word_totals, totals, own = group.totals(answers.to_pylist())
        places, at = np.unique(group.history, return_inverse=True)
        whole = lambda of, weights=None: np.bincount(at[of], None if weights is None else weights[of], len(places)).astype(np.int64)
        trained = own & (totals > 0)
        values = [whole(slice(None), group.counts), whole(trained, word_totals[group.word] + 1), *(whole(own & (totals == r)) for r in range(1, RELIABLE + 1))]
        keys = group.words[places]
        return _table(SENT, [(s, key[0].as_py(), pack_sorted(keys[x]), [pack(v[x]) for v in values]) for s, x in shards_of(keys, shards)])

    def weigh(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in own]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        count, seen, *rare = (_added(place, np.concatenate([unpack(r["values"][k]) for r in own]), len(unique)) for k in range(RELIABLE + 2))
        ends = np.cumsum([len(k) for k in keys])[:-1]
        scale, alpha = backoff(count, rare, seen, discounts, mass_of_all)
        divisor, alpha = np.rint(1 / scale)[place].astype(np.int64), np.log10(alpha)[place]  # scales are one over whole numbers
        return _table(BACK, [(r["grp"], HISTORIES, key[0].as_py(), [pack(d), a.tobytes()], None) for r, d, a in zip(own, np.split(divisor, ends), np.split(alpha, ends))])

    known = groups.select("grp", "words", "history", "word", "pair_counts").groupBy("grp").cogroup(back.select("grp", "step", "shard", "values").groupBy("grp"))
    return known.applyInArrow(send, SENT_SQL).groupBy("shard").applyInArrow(weigh, BACK_SQL)


def _added(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place, exact whatever their size."""
    total = np.zeros(n, np.int64)
    np.add.at(total, place, values.astype(np.int64))
    return total


def score_texts(docs: DataFrame, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words (what white space 0x20, 0x09-0x0D separates, A-Z lower-cased) and one end. The
    model learns from all documents but the held-out fold, crc32(id) mod ``modulus`` = ``remainder``.
    ``score`` is the log10 probability of the text, ``base_score`` that of add-one unigrams. Null text counts as
    empty: its one token is the end. Ids are integers; a null id is not held out. Repeated rows count in training as
    often as they come and each get a row. With no training text every probability is that of
    one unseen type. An empty table gives an empty result. Other columns are ignored.
    """
    keyed = docs.select(col(id_col).cast("long").alias("id"), in_fold(col(id_col), modulus, remainder).alias("held"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    conf = docs.sparkSession.conf
    buckets = min(max(int(conf.get("spark.sql.shuffle.partitions")), 1 + total // BUCKET_BYTES), int(conf.get("spark.sql.sources.bucketing.maxBuckets")))
    groups = bucketed(read_groups(keyed), "grp", buckets)
    n_words, n_pairs = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_pairs")]).first()
    word_shards, pair_shards = 1 + n_words // SHARD_ENTRIES, 1 + n_pairs // SHARD_ENTRIES
    words = written(added_up(sent_words(groups, word_shards), WORDS))
    tokens, types, *_ = _sums(words)
    pairs = written(added_up(sent_pairs(groups, pair_shards), PAIRS))
    discounts, mass_of_all = good_turing(np.array([0, *_sums(pairs)[3 : RELIABLE + 4]])), tokens + types + 1
    counted = words.unionByName(pairs)
    histories = weighed_histories(groups, counted, word_shards, discounts, mass_of_all)

    def score(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        row, back = rows.to_pylist()[0], answers.to_pylist()
        group = Group(row)
        word_totals, totals, _ = group.totals(back)
        base = np.log10((word_totals + 1) / mass_of_all)
        weights = _of(back, HISTORIES)
        scale, alpha = -np.log10(np.concatenate([unpack(v[0]) for v in weights])), np.concatenate([np.frombuffer(v[1]) for v in weights])
        _, at = np.unique(group.history, return_inverse=True)
        discounted = np.where(totals <= RELIABLE, totals * discounts[np.minimum(totals, RELIABLE)], totals)
        log = np.where(totals > 0, np.log10(np.maximum(discounted, 1e-300)) + scale[at], alpha[at] + base[group.word])
        times, doc, n = unpack(row["times"]).astype(np.int64), unpack(row["doc"]).astype(np.int64), len(row["ids"])
        by_doc = lambda x: np.bincount(doc, np.repeat(x, times), n)
        known = by_doc(word_totals[group.word] > 0).astype(np.int64)
        return pa.table({
            "id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(row["sizes"], pa.int64()), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(n, tokens, np.int64)), "base_score": pa.array(by_doc(base[group.word])), "score": pa.array(by_doc(log)),
        })

    back = counted.unionByName(histories).select("grp", "step", "shard", "values")
    whole = groups.drop("n_words", "n_pairs", "word_counts").groupBy("grp").cogroup(back.groupBy("grp"))
    scored = whole.applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
