"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of ``documents``; the last returns the packed pieces. Nulls in any column, empty and very
long texts, repeated rows, empty tables and further columns are handled as the operators' docstrings say:

* language: text that has no letter (null and empty text too), or whose best language is less likely than
  one third over its words, is rejected; all else stays, whatever its language;
* exact: of texts equal after lower-casing A-Z, the row with the largest doc_id stays;
* near: texts found near by SimHash and BK-trees whose sets of five-word shingles have a Jaccard similarity of 0.8 or
  more are linked; of each component of links, the row with the smallest doc_id stays;
* mix: documents come as often as the mix takes them, so that a doc_id may come again;
* pack: one row per piece, with its ids (little-endian unsigned 32-bit), their checksum, sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import common
from codestrata.llm.common import col, written, written_at
from codestrata.llm.exact_dedup import exact_dedup
from codestrata.llm.language_id import UNKNOWN, identify_languages
from codestrata.llm.mixing import mixed
from codestrata.llm.packing import pack
from codestrata.llm.similar import similar_duplicates

LEAST_SCORE = 1 / 3
LEAST_SIMILARITY = 0.8
CAPACITY = 4096
#: Words that a worker of the last stage remembers: it shares executors with what the stages before have left in memory.
REMEMBERED = 60_000


def _back(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("carried")[c].alias(c) for c in names])


#: Under this name a stage's rows say in their columns' metadata, which Parquet keeps, which working tables they came from.
SPENT = "working_tables"


def _stage(stage):
    """Rows that were written and read again no longer need the working tables they came from: the stage that takes
    them removes those first. A stage's own result has to be read before its written rows go into the next stage."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spent = [p for f in docs.schema for p in f.metadata.get(SPENT, ()) if p in common.WRITTEN]
        read = docs.inputFiles() if spent else []
        common.remove(spark, [p for p in spent if not any(f"{p}/" in f for f in read)])
        with common.noted() as tables:
            rows = stage(spark, docs, sf_dir)
        return rows.select(*[col(c).alias(c, metadata={SPENT: [] if k else tables}) for k, c in enumerate(rows.columns)])

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(identify_languages(docs, carry=tuple(docs.columns)))
    return _back(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(exact_dedup(docs, carry=docs.columns).filter("kept"), docs.columns)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(similar_duplicates(docs, LEAST_SIMILARITY, shingle=5, carry=tuple(docs.columns)).filter("kept"), docs.columns)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, REMEMBERED)
    return packed.select(col("doc_id"), "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    rows, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        rows, path = written_at(stage(spark, rows, sf_dir))
        common.remove(spark, before)
        before = [path]
    return STAGES[-1][1](spark, rows, sf_dir)


#: Not SQL: a trained language model and a tokenizer take part. tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
