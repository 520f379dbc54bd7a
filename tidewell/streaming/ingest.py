"""Incremental ingest: new files in micro-batches through the idempotent batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.embedding import Embedder
from tidewell.plans.ingest import extracted_files, ingest_batch, new_objects, stored
from tidewell.sources.objects import described, of_kind
from tidewell.storage import scratch

FILES_PER_BATCH = 10
FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_ingest(spark: SparkSession, folder: str, schema: str, tables: dict[str, str], embedder: Embedder, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = lambda df: df, files: int = FILES_PER_BATCH) -> StreamingQuery:
    """Ingest (key, metadata, file_type, text, method, page_count, image_paths) records as files of JSON arrive.

    A batch that is replayed after a failure adds nothing twice.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)

    def batch(rows: DataFrame, _: int) -> None:
        ingest_batch(rows.sparkSession, extract(rows), tables, embedder)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_files(spark: SparkSession, folder: str, tables: dict[str, str], embedder: Embedder, checkpoint: str, metadata: DataFrame | None = None, only: str | None = None, files: int = FILES_PER_BATCH, readers: dict | None = None, **options) -> StreamingQuery:
    """Ingest PDFs and workbooks as they arrive below ``folder``, ``files`` at a time, with the readers of :func:`extracted_files`.

    The stream remembers files it has seen; what the tables know already, from a batch that
    was replayed or from :func:`tidewell.plans.ingest.ingest_folder`, is left out by key.
    """
    source = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(folder)

    def batch(rows: DataFrame, _: int) -> None:
        with scratch():
            arrived = of_kind(described(rows.select("path", "content"), folder, metadata), only)
            fresh = new_objects(arrived, stored(rows.sparkSession, tables["documents"]))
            documents, series = extracted_files(fresh, **(readers or {}))
            ingest_batch(rows.sparkSession, documents, tables, embedder, series, **options)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
