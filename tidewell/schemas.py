"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = (
    "id BIGINT, r2_key STRING, filename STRING, file_type STRING, category STRING, subcategory STRING, country STRING, year INT, type_document STRING, "
    "date_publication STRING, extraction_method STRING, page_count INT, char_count INT, doc_metadata MAP<STRING, STRING>, created_at TIMESTAMP_NTZ, source_url STRING"
)
CHUNKS = (
    "id BIGINT, document_id BIGINT, chunk_index INT, content STRING, token_count INT, embedding ARRAY<FLOAT>, "
    "chunk_metadata STRUCT<category: STRING, subcategory: STRING, source: STRING, lien: STRING, image_paths: ARRAY<STRING>>, created_at TIMESTAMP_NTZ"
)
STATISTICS = "id BIGINT, document_id BIGINT, indicator STRING, country STRING, period STRING, year INT, value DOUBLE, unit STRING, raw_label STRING, source_sheet STRING"
FEEDBACK = "id BIGINT, question STRING, is_positive BOOLEAN, query_type STRING, model_key STRING, created_at TIMESTAMP_NTZ"
CELLS = "key STRING, sheet STRING, row_idx INT, col_idx INT, raw STRING, kind STRING"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "statistics": STATISTICS, "feedback": FEEDBACK}

#: Longest period that a statistics row may hold.
PERIOD_CHARS = 32


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create what is missing; statistics are clustered by their usual filters."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def checked_periods(statistics: DataFrame) -> DataFrame:
    """Fail on periods that are too long instead of storing them."""
    return statistics.withColumn("period", F.when(F.length("period") > PERIOD_CHARS, F.raise_error(F.lit("period too long"))).otherwise(F.col("period")))


def unique_keys(documents: DataFrame, key: str = "r2_key") -> DataFrame:
    """Keys that break uniqueness, with their counts; NULL keys may repeat."""
    return documents.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def delete_documents(documents: DataFrame, chunks: DataFrame, statistics: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete by ``id``: chunks go with their document, statistics stay without it."""
    ids = gone.select(F.col("id").alias("__gone")).distinct()
    kept = documents.join(ids, documents["id"] == ids["__gone"], "left_anti")
    left = chunks.join(ids, chunks["document_id"] == ids["__gone"], "left_anti")
    orphaned = statistics.join(ids, statistics["document_id"] == ids["__gone"], "left")
    cleared = orphaned.withColumn("document_id", F.when(F.col("__gone").isNull(), F.col("document_id"))).select(*statistics.columns)
    return kept, left, cleared
