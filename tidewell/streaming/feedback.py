"""Feedback as a stream: validated appends and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.schemas import FEEDBACK


QUESTION_CHARS = (1, 2000)


def valid(rows: DataFrame) -> DataFrame:
    """Rows with a question of 1 to 2000 characters and a vote; kind and model may be missing."""
    return rows.filter(F.length("question").between(*QUESTION_CHARS) & F.col("is_positive").isNotNull())


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback dropped as JSON files; rows that are not :func:`valid` are left out."""
    return valid(spark.readStream.schema(FEEDBACK).json(folder))


def windowed_counts(rows: DataFrame, ts: str, kind: str, window: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Counts per window and kind; on a stream, rows later than the watermark are dropped."""
    if rows.isStreaming and late:
        rows = rows.withWatermark(ts, late)
    counts = rows.groupBy(F.window(ts, window).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "kind", "n")


def append(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table, each file once, whatever is drained now."""
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
