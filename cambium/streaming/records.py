"""Prediction records as a stream: late and repeated records, and counts by status over time. An addition; a stream's results equal the batch's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def events(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """New files of a folder, files at a time. Times without a zone are taken in the session's, as watermarks need one."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.select(*[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in schema])


def once(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key's first record within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def status_counts(frame: DataFrame, time: str, status: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and status; of a stream or a table."""
    own = frame.withWatermark(time, late) if frame.isStreaming else frame
    return own.groupBy(F.window(time, width), status).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), status, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, written exactly once under a checkpoint, and read back."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
