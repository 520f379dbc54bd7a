"""Counts and distributions for the dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import half_even


def month(ts: str) -> Column:
    return F.date_format(F.date_trunc("month", F.col(ts)), "yyyy-MM")


def by_month(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Counts in order of months; a group a month is all that is sorted."""
    return df.groupBy(month(ts).alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy("month")


def by_label(df: DataFrame, column: str, missing: str) -> DataFrame:
    """Count per value, the largest first; null and '' stay two groups that share the label ``missing``."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_last())
    return counts.select(F.coalesce(F.nullif(column, F.lit("")), F.lit(missing)).alias("label"), "n")


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value): the distinct values of each column in one pass, in order; '' and the number 0 are left out, the text '0' is not."""
    kinds = dict(df.dtypes)
    pairs = []
    for c in columns:
        kind = kinds[c].partition("(")[0]
        kept = F.col(c) != "" if kind == "string" else F.col(c) != 0 if kind in NUMBERS else F.col(c).isNotNull()
        pairs.append(F.struct(F.lit(c).alias("field"), F.when(kept, F.col(c).cast("string")).alias("value")))
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("value IS NOT NULL").distinct().orderBy("field", "value")


def satisfaction(is_positive: str = "is_positive") -> Column:
    """Percentage of positive votes to one digit, NULL without votes."""
    return half_even(100 * F.try_divide(F.count_if(F.col(is_positive)), F.count(F.col(is_positive))), 1)


def health(documents: DataFrame, chunks: DataFrame, statistics: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row of totals: a partial count of each table, united, then summed."""
    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("t"), F.lit(None).cast("boolean").alias("vote"))

    rows = tagged(documents, "d").unionByName(tagged(chunks, "c")).unionByName(tagged(statistics, "s")).unionByName(feedback.select(F.lit("f").alias("t"), F.col("is_positive").alias("vote")))
    return rows.agg(
        F.count_if(F.col("t") == "d").alias("documents"),
        F.count_if(F.col("t") == "c").alias("chunks"),
        F.count_if(F.col("t") == "s").alias("statistics"),
        F.count_if(F.col("vote")).alias("positive"),
        F.count_if(~F.col("vote")).alias("negative"),
        satisfaction("vote").alias("satisfaction"),
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def without_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks: new objects, documents without chunks."""
    keys = right.select(F.col(right_key).alias("__key"))
    return left.join(keys, left[left_key] == keys["__key"], "left_anti")
