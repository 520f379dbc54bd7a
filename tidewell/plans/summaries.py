"""Dashboards kept up by deltas.

The counts behind the dashboards are one table of the library's versions: rows (dimension,
value, n) that add up. :func:`build` adds it once; from then on an ingest stages the counts
of its own documents and a deletion those of its documents with the opposite sign, in the
same version as the documents themselves. A dashboard sums a few small files and never
scans documents. Once more than ``PIECES`` deltas lie there, the next change puts their sum
in their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import dashboards
from tidewell.versions import Change, Version, current, read

SUMMARY = "dimension string, value string, n bigint"
#: Columns of documents that are counted; ``month`` is that of ``created_at``.
DIMENSIONS = ("month", "category", "country", "year", "type_document")
PIECES = 100


def deltas(documents: DataFrame, sign: int = 1) -> DataFrame:
    """Counts of every dimension's values, in one pass."""
    values = [F.struct(F.lit(d).alias("dimension"), (dashboards.month("created_at") if d == "month" else F.col(d).cast("string")).alias("value")) for d in DIMENSIONS]
    each = documents.select(F.explode(F.array(*values)).alias("p")).select("p.*")
    return each.groupBy("dimension", "value").agg((sign * F.count(F.lit(1))).alias("n"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dimension", "value").agg(F.sum("n").alias("n")).filter("n <> 0")


def add(change: Change, documents: DataFrame, sign: int = 1) -> None:
    """Stage the counts of added (1) or removed (-1) documents, if the library keeps any."""
    if "summary" not in change.tables:
        return
    new = deltas(documents, sign)
    if len(change.tables["summary"].folders) > PIECES:
        old = read(change.spark, change.root, "summary", SUMMARY, Version(change.base.number, change.tables))
        change.replace("summary", summed(old.unionByName(new)).coalesce(1))
    else:
        change.append("summary", new.coalesce(1))


def build(spark: SparkSession, root: str, documents: DataFrame) -> None:
    """Count all documents once, in place of an earlier summary."""
    with Change(spark, root) as change:
        change.replace("summary", deltas(documents).coalesce(1))


def summary(spark: SparkSession, root: str) -> DataFrame:
    """(dimension, value, n) of the newest version."""
    return summed(read(spark, root, "summary", SUMMARY, current(spark, root)))


def by_month(counts: DataFrame) -> DataFrame:
    """:func:`tidewell.operators.dashboards.by_month` out of a summary."""
    return counts.filter("dimension = 'month'").select(F.col("value").alias("month"), "n").orderBy("month")


def by_label(counts: DataFrame, column: str, missing: str) -> DataFrame:
    """:func:`tidewell.operators.dashboards.by_label` out of a summary."""
    own = counts.filter(F.col("dimension") == column).orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return own.select(F.coalesce(F.nullif("value", F.lit("")), F.lit(missing)).alias("label"), "n")


def distinct_values(counts: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`tidewell.operators.dashboards.distinct_values` out of a summary."""
    kept = counts.filter(F.col("dimension").isin(*columns) & (F.col("value") != "") & ~((F.col("dimension") == "year") & (F.col("value") == "0")))
    return kept.select(F.col("dimension").alias("field"), "value").orderBy("field", "value")
