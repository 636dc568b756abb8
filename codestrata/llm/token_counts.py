"""Token counts kept by deltas.

Changes are signed: an insert adds a document and its tokens, a delete takes both away, a revision
adds the difference of the counts. Each batch is reduced to one additive delta per (source,
language, tokenizer version) and committed under its id, once: a batch that comes again, whole or
after a failure halfway, changes nothing. Totals are sums of the committed deltas.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]


class TokenRollup:
    """A rollup kept at ``path``, in a folder that driver and executors share.

    ``commit`` takes columns op (insert, delete or revise), source, lang, tokenizer_version, n_tokens and
    old_n_tokens (revisions only). Null source, lang or version are groups of their own; null counts
    count as 0; rows with another op, or none, are rejected with the batch. Repeated rows count as
    often as they come. An empty batch commits. Other columns are ignored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _claim(self, batch_id: str) -> str:
        return f"{self.path}/_commits/{batch_id}"

    def _held(self, claim: str) -> str:
        """The folder that a commit file names; empty where its writer was lost before it wrote it."""
        fs, at = self._fs(claim)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def committed(self, batch_id: str) -> bool:
        fs, at = self._fs(self._claim(batch_id))
        return fs.exists(at) and bool(self._held(self._claim(batch_id)))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether the batch took effect; False if it had been committed before."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"a batch id is a plain name, not {batch_id!r}")
        if self.committed(batch_id):
            return False
        n, old = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long"), F.coalesce(F.col("old_n_tokens"), F.lit(0)).cast("long")
        op = F.col("op")
        wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))).cast("long")
        signed = changes.select(
            *KEYS,
            F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong).cast("long").alias("docs"),
            F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - old).otherwise(wrong).alias("tokens"),
        )
        delta = f"delta-{uuid.uuid4().hex}"
        signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/{delta}")
        # The commit: the batch belongs to the writer that creates its file, and only deltas that such a file names count.
        fs, at = self._fs(self._claim(batch_id))
        lost = fs.exists(at) and not self._held(self._claim(batch_id))
        try:
            stream = fs.create(at, bool(lost))
        except Py4JJavaError:
            if not fs.exists(at):
                raise
            fs.delete(self._fs(f"{self.path}/{delta}")[1], True)
            return False
        stream.write(bytearray(delta.encode()))
        stream.close()
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens of every group that is not back at zero."""
        fs, at = self._fs(f"{self.path}/_commits")
        named = [self._held(str(f.getPath())) for f in fs.listStatus(at)] if fs.exists(at) else []
        schema = "source string, lang string, tokenizer_version string, docs long, tokens long"
        paths = [f"{self.path}/{delta}" for delta in named if delta]
        deltas = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 OR n_tokens <> 0")
