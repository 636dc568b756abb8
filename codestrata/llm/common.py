"""What the corpus operators share: text rules, the shared folder, written tables."""

from __future__ import annotations

import ctypes
import gc
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the text contracts: white space is 0x20 and 0x09-0x0D, words are what lies between.
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def in_fold(id_column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) falls on the remainder; a null id never does."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset and driver and tasks are one process,
    as in local tests, a temporary folder is set for the session and used.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Session setting of what a Python worker is sent at a time, and the bytes of it.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 6 << 20


def given_back() -> None:
    """At the end of a Python task: the idle worker keeps no freed memory from the executor's other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


#: Folders of the working tables that were written and not removed.
WRITTEN: set[str] = set()
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of the working tables that are written inside, by this thread."""
    paths: list[str] = []
    token = _NOTED.set(paths)
    try:
        yield paths
    finally:
        _NOTED.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete working tables that nothing reads any more; other folders are left alone."""
    for path in paths:
        if path in WRITTEN:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            WRITTEN.discard(path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Python workers get texts in batches of a few megabytes meanwhile: both sides hold whole batches."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``written``, with the folder."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with _small_batches(spark):
        df.write.parquet(path)
    WRITTEN.add(path)
    if (paths := _NOTED.get()) is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and every later
    reader sees the same rows even if executors are lost. The table stays until it is removed."""
    return written_at(df)[0]


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """As ``written``, dealt by a column into buckets: whatever is grouped with the rows by that column comes to them,
    and they are not shuffled again. The catalog only lends its name for the write; the files stay as those of ``written``.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    name = f"codestrata_{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(name)
    WRITTEN.add(path)
    if (paths := _NOTED.get()) is not None:
        paths.append(path)
    table = spark.table(name)
    table.schema  # noqa: B018  resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return table
