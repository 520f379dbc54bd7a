"""Changes to stored tables: backfills, deletions, feedback. Each is one version of the library.

Only files that hold a changed row are written anew (:mod:`tidewell.versions`); a driver that
dies at any step leaves the tables as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import backfill, dashboards
from tidewell.plans import summaries
from tidewell.plans.ingest import library_of, stored
from tidewell.schemas import TABLES, delete_documents
from tidewell.skew import small
from tidewell.versions import Change, read


def _split(path: str) -> tuple[str, str]:
    root, name = path.rstrip("/").rsplit("/", 1)
    return root, name


def replace_table(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Put ``rows`` in place of all rows of the table at ``path``, which ``rows`` may read."""
    root, name = _split(path)
    with Change(spark, root) as change:
        change.replace(name, rows)


def _columns(name: str) -> list[str]:
    """The columns of a table, from its DDL."""
    return SparkSession.active().createDataFrame([], TABLES[name]).columns


def _updated(spark: SparkSession, path: str, changes: DataFrame, column: str, new: str, dry_run: bool) -> dict[str, int]:
    """Counts of ``changes`` (id, outcome, new) and, unless it is a dry run, the documents with ``column`` filled."""
    changes = changes.cache()
    try:
        counts = {r["outcome"]: r["n"] for r in backfill.outcomes(changes).collect()}
        if counts.get("updated") and not dry_run:
            filled = changes.filter("outcome = 'updated'").select(F.col("id").alias("__id"), F.col(new).alias("__new"))

            def fill(documents: DataFrame) -> DataFrame:
                rows = documents.join(small(filled), documents["id"] == F.col("__id"), "left")
                return rows.withColumn(column, F.coalesce("__new", column)).select(*_columns("documents"))

            root, name = _split(path)
            with Change(spark, root) as change:
                change.rewrite(name, TABLES["documents"], filled.select("__id"), "id", fill)
        return counts
    finally:
        changes.unpersist()


def backfill_keys(spark: SparkSession, path: str, objects: DataFrame, dry_run: bool = False) -> dict[str, int]:
    """Give documents without one the object key of their file name; ``objects`` has ``key``."""
    return _updated(spark, path, backfill.claimed_keys(stored(spark, path).select("id", "filename", "r2_key"), objects.select("key")), "r2_key", "new_key", dry_run)


def backfill_links(spark: SparkSession, path: str, links: DataFrame, dry_run: bool = False) -> dict[str, int]:
    """Fill empty links of PDF documents from a list (chemin_relatif, lien, row_no)."""
    return _updated(spark, path, backfill.filled_links(stored(spark, path).select("id", "filename", "file_type", "source_url"), links), "source_url", "new_url", dry_run)


def remove_documents(spark: SparkSession, tables: dict[str, str], ids: DataFrame) -> None:
    """Delete documents by ``id`` with their chunks; statistics stay without them."""
    def kept(which: int):
        def change(rows: DataFrame) -> DataFrame:
            empty = {n: spark.createDataFrame([], TABLES[n]) for n in ("documents", "chunks", "statistics")}
            name = ("documents", "chunks", "statistics")[which]
            return delete_documents(*(empty | {name: rows}).values(), ids)[which].select(*_columns(name))

        return change

    with Change(spark, library_of(tables)) as change:
        if "summary" in change.tables:
            name = _split(tables["documents"])[1]
            there = read(spark, change.root, name, TABLES["documents"], change.base)
            gone = ids.select(F.col("id").alias("__gone")).distinct()
            summaries.add(change, there.join(small(gone), there["id"] == F.col("__gone"), "left_semi"), -1)
        for which, (name, key) in enumerate((("documents", "id"), ("chunks", "document_id"), ("statistics", "document_id"))):
            change.rewrite(_split(tables[name])[1], TABLES[name], ids.select("id"), key, kept(which))


def health(spark: SparkSession, tables: dict[str, str]) -> dict:
    """Totals of all tables and the satisfaction, as one row."""
    return dashboards.health(*(stored(spark, tables[n]) for n in ("documents", "chunks", "statistics", "feedback"))).first().asDict()
