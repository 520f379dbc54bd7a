"""Object listings: files below a folder, their metadata sidecar, and link lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import basename, percent_decode, suffix

PDF = (".pdf",)
SHEETS = (".xls", ".xlsx", ".xlsm")


def list_objects(spark: SparkSession, folder: str, metadata: DataFrame | None = None) -> DataFrame:
    """(path, key, metadata): every file below ``folder``; contents are never read.

    ``metadata`` is (key, metadata map) as the store keeps it, percent-encoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return described(files, folder, metadata)


def key_of(path: Column, folder: str) -> Column:
    """A file's path below ``folder``."""
    return F.substring_index(path, folder.rstrip("/").split("://")[-1].lstrip("/") + "/", -1)


def described(files: DataFrame, folder: str, metadata: DataFrame | None = None) -> DataFrame:
    """Files (path, ...) with ``key`` and ``metadata``."""
    rest = [c for c in files.columns if c != "path"]
    listed = files.select("path", key_of(F.col("path"), folder).alias("key"), *rest)
    if metadata is None:
        return listed.withColumn("metadata", F.create_map().cast("map<string,string>"))
    known = metadata.select(F.col("key").alias("__key"), percent_decode(F.col("metadata")).alias("metadata"))
    joined = listed.join(known, listed["key"] == known["__key"], "left")
    return joined.select("path", "key", *rest, F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def of_kind(objects: DataFrame, only: str | None = None) -> DataFrame:
    """Objects that can be ingested: ``pdf``, ``excel``, or both."""
    wanted = {"pdf": PDF, "excel": SHEETS, None: PDF + SHEETS}[only]
    return objects.filter(suffix(F.col("key")).isin(*wanted))


def read_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, content) of these files alone, for extraction in Arrow batches."""
    literal = [re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in paths]  # a path is no pattern
    return spark.read.format("binaryFile").load(literal).select("path", "content")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """(chemin_relatif, lien, row_no) of a ``;``-separated list with or without a byte order mark, blank rows left out."""
    rows = spark.read.option("header", True).option("sep", ";").option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    numbered = rows.withColumn("row_no", F.monotonically_increasing_id())  # file order within a list
    return numbered.filter((F.coalesce(F.trim("chemin_relatif"), F.lit("")) != "") & (F.coalesce(F.trim("lien"), F.lit("")) != "")).select(F.trim("chemin_relatif").alias("chemin_relatif"), F.trim("lien").alias("lien"), "row_no")


def names(objects: DataFrame) -> DataFrame:
    return objects.select(basename(F.col("key")).alias("filename"), "key")
