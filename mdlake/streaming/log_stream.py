"""An append-only log that arrives as segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake.sources.companions import log_fields


def _fields(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.readStream.text(folder).select(F.lit(0).cast("bigint").alias("line_no"), F.col("value").alias("line"))
    return log_fields(lines)


def rejected_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming entries with an impossible date, which have no place in time and hence none in ``log_stream``."""
    return _fields(spark, folder).where("date IS NOT NULL AND log_date IS NULL").select("date", "action", "detail")


def log_stream(spark: SparkSession, folder: str, delay: str = "7 days") -> DataFrame:
    """Streaming entries of all segments in ``folder``, repeats within ``delay`` removed.

    The file source reads each file once, so the log has to come as new files.
    State is dropped once the entry date is ``delay`` behind the newest; entries
    later than that are dropped too, the batch reader stays authoritative.
    """
    entries = _fields(spark, folder).where("log_date IS NOT NULL").select(
        F.col("log_date").cast("timestamp").alias("day"), "date", "action", "detail"
    )
    return entries.withWatermark("day", delay).dropDuplicatesWithinWatermark(["date", "action", "detail"])


def run_once(stream: DataFrame, out: str, checkpoint: str):
    """Process what has arrived and stop."""
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
