"""Re-analysis as files arrive: a stream of files keyed by content, findings replaced batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import match

FILES = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("content", T.StringType()), T.StructField("mtime", T.TimestampType())]
)


def arriving_files(spark: SparkSession, folder: str, watermark: str = "1 hour") -> DataFrame:
    """Files (Parquet rows of FILES) as they come; the same content of a path counts once within the watermark."""
    stream = spark.readStream.schema(FILES).parquet(folder)
    return stream.withColumn("sha256", F.sha2("content", 256)).withWatermark("mtime", watermark).dropDuplicatesWithinWatermark(["path", "sha256"])


def findings_stream(files: DataFrame) -> DataFrame:
    """Findings of each arriving file; rule matching needs no state."""
    return match.findings(files)


def write_findings(files: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Start a query that writes each batch's findings under its batch id: a batch that is replayed after a failure
    overwrites what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        match.findings(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
