"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .byte_bpe import ByteBPE
from .common import ascii_lower, shared_dir, written
from .exact_dedup import exact_dedup
from .katz import score_texts
from .language_id import identify_languages
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack
from .quality import score_quality
from .spelling import group_variants, words_of
from .substring_dedup import remove_repeats
from .token_counts import TokenRollup
from .top_k import exact_top_k
from .vector_codes import encode, train

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents")).drop("runs", "carried")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("text_sha256")
    found = exact_dedup(table(spark, sf_dir, "documents"), carry=[digest])
    return found.select("doc_id", "keep_id", "group_size", "kept", "carried.text_sha256")


OP6_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS most, sum(source_size) OVER ()::BIGINT AS words FROM t),
l AS (SELECT *, words - coalesce(sum(most) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
             sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
      FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST)),
f AS (SELECT *, left_ * weight >= most * sharing AS full_ FROM l),
g AS (SELECT *, words - coalesce(sum(most) FILTER (full_) OVER (), 0) AS rest, sum(weight) FILTER (NOT full_) OVER () AS part FROM f),
targets AS (SELECT source, source_size, CASE WHEN full_ THEN most::DOUBLE ELSE (rest * weight)::DOUBLE / part::DOUBLE END AS target FROM g),
steps AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * 16777216.0::DOUBLE / source_size + 0.5)::BIGINT ELSE 16777216 END AS step,
                 ('0x' || substr(md5(coalesce(source, '') || ':mix'), 1, 6))::BIGINT AS offset_ FROM targets),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS rank FROM d),
c AS (SELECT doc_id, size, source_size, target, (((rank + 1) * step + offset_) >> 24) - ((rank * step + offset_) >> 24) AS copies
      FROM r JOIN steps ON r.source IS NOT DISTINCT FROM steps.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM c"""

#: Tokenizer versions of the rollup, as patterns whose matches are the tokens.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-1": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}
REVISED = r"[^\x20\x09-\x0D]*[A-Za-z0-9][^\x20\x09-\x0D]*"


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents under two tokenizer versions, take down the toxic ones, revise the counts of the
    low-quality ones (words without a letter or digit no longer count), and replay every batch."""
    text = F.coalesce("text", F.lit(""))
    counts = [F.regexp_count(text, F.lit(p)).alias(c) for c, p in (("words", TOKENIZERS["words-1"]), ("pieces", TOKENIZERS["pieces-1"]), ("revised", REVISED))]
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", *counts).join(labels, "doc_id", "left"))
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(c).alias("n_tokens")) for v, c in (("words-1", "words"), ("pieces-1", "pieces"))])).alias("v")
    every = docs.select("source", "lang", "toxic", versions).select("source", "lang", "toxic", "v.*", F.lit(0).alias("old_n_tokens"))
    batches = {
        "load": every.withColumn("op", F.lit("insert")),
        "takedown": every.filter("toxic = 1").withColumn("op", F.lit("delete")),
        "revision": docs.filter("quality = 0 AND coalesce(toxic, 0) <> 1").select(
            "source", "lang", F.lit("words-1").alias("tokenizer_version"), F.col("revised").alias("n_tokens"), F.col("words").alias("old_n_tokens"), F.lit("revise").alias("op")
        ),
    }
    rollup = TokenRollup(spark, shared_dir(spark))
    for name, changes in [*batches.items(), *batches.items()]:
        rollup.commit(name, changes)
    return rollup.totals()


def _counted(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"


OP9_SQL = f"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT source, lang, coalesce(toxic, 0) AS toxic, quality, {_counted(TOKENIZERS["words-1"])} AS words, {_counted(TOKENIZERS["pieces-1"])} AS pieces, {_counted(REVISED)} AS revised
      FROM documents LEFT JOIN l USING (doc_id)),
v AS (SELECT source, lang, 'words-1' AS tokenizer_version, CASE WHEN quality = 0 THEN revised ELSE words END AS n FROM d WHERE toxic <> 1
      UNION ALL SELECT source, lang, 'pieces-1', pieces FROM d WHERE toxic <> 1)
SELECT source, lang, tokenizer_version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM v GROUP BY ALL"""

def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM s),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r WHERE n > 1) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text")).alias("ids"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    digests = ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256")
    )
    return written(digests)  # written, so that batches of texts are bounded


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = train(vectors)
    digest = hashlib.sha256(books.text().encode()).hexdigest()
    coded = written(encode(vectors, books, carry=[F.col("label")]).select("id", "codes", "error", "carried.label"))
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    """The nearest entry of each part: (r, k, e, d)."""
    apart = " + ".join(f"(p.c[{i}] - b.c[{i}]) * (p.c[{i}] - b.c[{i}])" for i in range(1, 5))
    return f"SELECT r, k, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT p.r, p.k, b.e, {apart} AS d FROM parts p JOIN {book} b USING (k)) GROUP BY r, k"


_DOWN = lambda i: f"(sum(p.c[{i}]) - ((sum(p.c[{i}]) % count(*)) + count(*)) % count(*)) // count(*)"  # noqa: E731  rounds down, below 0 too


def _updated(book: str, assigned: str) -> str:
    means = ", ".join(f"({_DOWN(i)})::BIGINT" for i in range(1, 5))
    return f"SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN (SELECT a.k, a.e, [{means}] AS c FROM {assigned} a JOIN parts p USING (r, k) GROUP BY a.k, a.e) m ON m.k = b.k AND m.e = b.e"


#: For vectors of 64 components, so that a part has four.
OP12_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT r, k, v[4 * k + 1:4 * k + 4] AS c FROM v, (SELECT unnest(range(16)) AS k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS e, c FROM parts WHERE r <= 64),
a0 AS MATERIALIZED ({_assigned("b0")}), b1 AS MATERIALIZED ({_updated("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}), b2 AS MATERIALIZED ({_updated("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
coded AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), digest"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(words_of(table(spark, sf_dir, "documents")))


#: crc32 by its table of 256 values, which follow from the polynomial. Words that share a deletion or a gap are compared.
OP13_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
bytes AS MATERIALIZED (SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM bytes, crc),
words AS MATERIALIZED (SELECT w AS word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS w FROM hashed)
                       GROUP BY w HAVING length(w) >= 6 AND sum(n) >= 5),
gaps AS (SELECT word, n, unnest(list_transform(range(length(word)), lambda i: word[1:i] || '_' || word[i + 2:])) AS g FROM words),
shorter AS (SELECT DISTINCT word, n, replace(g, '_', '') AS g FROM gaps),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b USING (g) WHERE a.word <> b.word
         UNION SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON w.word = s.g UNION SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON w.word = s.g),
best AS (SELECT word, count(*) AS n_near, arg_max(near, near_n) FILTER (place = 1) AS form, max(near_n) AS form_n
         FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM near) GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= 5 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 5 * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL"""

QUERIES = {
    "op1_packing": op1_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_vector_codes": op12_vector_codes,
    "op13_spelling": op13_spelling,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_katz": op4_katz,
    "op5_simhash": op5_simhash,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_top_k": op8_top_k,
    "op9_token_counts": op9_token_counts,
}
ORACLES = {
    "op2_mixing": OP2_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_spelling": OP13_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_top_k": OP8_SQL,
    "op9_token_counts": OP9_SQL,
}
