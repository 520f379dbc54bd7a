"""Backfills: object keys claimed by documents, links from a CSV, and what became of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import basename


def keys_by_name(objects: DataFrame, key: str = "key", listed: int = 16) -> DataFrame:
    """(filename, n_keys, key, keys): per base name how many keys there are, the smallest, and the first ``listed`` in order.

    The list is cut by rank before it is gathered, so that a name with a third of all keys is not.
    """
    named = objects.select(basename(F.col(key)).alias("filename"), F.col(key).alias("key"))
    counts = named.groupBy("filename").agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("key"))
    rank = F.row_number().over(Window.partitionBy("filename").orderBy("key"))
    first = named.withColumn("__rank", rank).filter(F.col("__rank") <= listed).groupBy(F.col("filename").alias("__name")).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return counts.join(first, counts["filename"].eqNullSafe(first["__name"])).drop("__name")


def claimed_keys(documents: DataFrame, objects: DataFrame) -> DataFrame:
    """documents(id, filename, r2_key) with ``outcome`` and ``new_key``.

    A key is given to the document of the smallest id among those that ask for it, unless
    the name is ambiguous or the key is taken. Only documents that ask for a free,
    unambiguous key are grouped by it, on the map side first; what matches no key meets nowhere.
    """
    by_name = objects.groupBy(basename(F.col("key")).alias("__name")).agg(F.count(F.lit(1)).alias("n_keys"), F.min("key").alias("key"))
    taken = documents.filter(F.coalesce("r2_key", F.lit("")) != "").select(F.col("r2_key").alias("__taken")).distinct()
    names = by_name.join(taken, by_name["key"] == taken["__taken"], "left")
    free = F.coalesce("r2_key", F.lit("")) == ""
    wanting = documents.filter(free).select("id", F.col("filename").alias("__asked"))
    first = wanting.groupBy("__asked").agg(F.min("id").alias("__first"))  # a name has one key, so its first asker is its key's
    names = names.join(first, names["__name"] == first["__asked"], "left").drop("__asked")
    asked = documents.join(names, documents["filename"] == names["__name"], "left")
    outcome = (
        F.when(~free, "already_set").when(F.col("n_keys").isNull(), "unmatched").when(F.col("n_keys") > 1, "ambiguous").when(F.col("__taken").isNotNull() | (F.col("id") != F.col("__first")), "duplicate_rows").otherwise("updated")
    )
    out = asked.withColumn("outcome", outcome)
    return out.select("id", "filename", "r2_key", "outcome", F.when(F.col("outcome") == "updated", F.col("key")).otherwise(F.col("r2_key")).alias("new_key"))


def last_links(links: DataFrame, path: str = "chemin_relatif", link: str = "lien", order: str = "row_no") -> DataFrame:
    """One link per base name: that of the last row."""
    return links.groupBy(basename(F.replace(F.col(path), F.lit("\\"), F.lit("/"))).alias("filename")).agg(F.max_by(link, order).alias("link"))


def filled_links(documents: DataFrame, links: DataFrame) -> DataFrame:
    """PDF documents with ``outcome`` and ``new_url``; only empty ones are filled."""
    by_name = last_links(links).withColumnRenamed("filename", "__name")
    pdf = documents.filter(F.col("file_type") == "pdf")
    found = pdf.join(by_name, pdf["filename"] == by_name["__name"], "left")
    has, got = F.coalesce("source_url", F.lit("")) != "", F.coalesce("link", F.lit("")) != ""
    outcome = F.when(has, "already_set").when(~got, "unmatched").otherwise("updated")
    return found.select("id", "filename", outcome.alias("outcome"), F.when(has, F.col("source_url")).when(got, F.col("link")).alias("new_url"))


def outcomes(df: DataFrame) -> DataFrame:
    return df.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
