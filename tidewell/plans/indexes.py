"""Indexes that are kept: graphs over chunk vectors and trigram postings over documents.

Both are tables of the library's versions. :func:`build` adds them once; from then on every
ingest stages the entries of its own batch with its documents and chunks, so an index never
knows more or less than the tables do. Entries lie in a folder for each cell or bucket, and
a search opens only the folders it asks for; nothing is fitted or built while searching.

Cells are fitted once, on a bounded sample (:data:`tidewell.operators.ann.SAMPLE`), and kept
as a table; vectors that come later go to the nearest of them. Entries of deleted chunks and
documents stay until the next :func:`build` and are left out of results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import ann, graph
from tidewell.versions import Change, Version, current, folders_of

CENTROIDS = "cell int, embedding array<double>"
#: ``id`` is what entries of before :func:`ann.packed_postings` have instead of ``ids``.
POSTINGS = "gram string, ids array<bigint>, id bigint"
BUCKETS = 64
SEARCHED = ("filename", "subcategory", "category", "country")


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _graph_rows(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    rows = chunks.filter("embedding IS NOT NULL").withColumn("cell", ann.cell_of(F.col("embedding"), centroids))
    built = graph.built(rows.select("chunk_id", "embedding", "cell"))
    return built.withColumn("cell", F.col("home")).repartition("home", "block")


def _posting_rows(documents: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = ann.packed_postings(documents, columns).withColumn("bucket", bucket(F.col("gram")))
    return rows.repartition("bucket", F.pmod(F.xxhash64("ids"), F.lit(4)))  # a gram in every document is dealt over tasks


def add(change: Change, chunks: DataFrame, documents: DataFrame, centroids: np.ndarray, columns: Sequence[str] = SEARCHED) -> None:
    """Stage the entries of new chunks (chunk_id, embedding) and documents."""
    change.append("graph", _graph_rows(chunks, centroids), by="cell")
    change.append("postings", _posting_rows(documents, columns), by="bucket")


def build(spark: SparkSession, root: str, chunks: DataFrame | None, documents: DataFrame | None, cells: int = 16, columns: Sequence[str] = SEARCHED) -> int:
    """Fit cells and index all chunks and documents, in place of earlier indexes; returns the version.

    A table that only one of the searches is for is built alone: without ``documents`` there
    are no postings, without ``chunks`` no cells and graphs, and what there was of them stays.
    """
    with Change(spark, root) as change:
        if chunks is not None:
            centroids = ann.fit_cells(chunks.filter("embedding IS NOT NULL"), cells)
            change.tables.pop("graph", None)
            change.replace("centroids", spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], CENTROIDS))
            change.append("graph", _graph_rows(chunks, centroids), by="cell")
        if documents is not None:
            change.tables.pop("postings", None)
            change.append("postings", _posting_rows(documents, columns), by="bucket")
    return current(spark, root).number


def centroids_of(spark: SparkSession, root: str, version: Version) -> np.ndarray | None:
    """The kept cells, none if the library has no index."""
    if "centroids" not in version.tables:
        return None
    found = spark.read.schema(CENTROIDS).parquet(*[f"{root}/{f}" for f in version.tables["centroids"].folders])
    return np.array([r["embedding"] for r in found.orderBy("cell").collect()])


def nearest(spark: SparkSession, root: str, queries: DataFrame, top_k: int, cells: int, chunks: DataFrame | None = None, ef: int = graph.EF) -> DataFrame:
    """(qid, rank, chunk_id, score): the ``top_k`` nearest of each query's ``cells`` nearest cells.

    The cells that any of ``queries`` (qid, embedding) asks for are all that is opened.
    ``chunks`` (chunk_id) leaves out entries of chunks that are gone.
    """
    version = current(spark, root)
    asked = queries.withColumn("near", ann.near_cells(F.col("embedding"), centroids_of(spark, root, version), cells))
    wanted = sorted(r[0] for r in asked.select(F.explode("near")).distinct().collect())  # at most as many as there are cells
    found = folders_of(spark, root, version.tables["graph"], "cell", wanted)
    graphs = spark.read.schema(graph.GRAPH).parquet(*found) if found else spark.createDataFrame([], graph.GRAPH)
    hits = graph.searched(graphs, asked, max(ef, top_k), top_k if chunks is None else None)
    if chunks is not None:
        hits = hits.join(chunks.select(F.col("chunk_id").alias("__there")), hits["chunk_id"] == F.col("__there"), "left_semi")
    return graph.ranked(hits, top_k)


def containing(spark: SparkSession, root: str, documents: DataFrame, text: str, columns: Sequence[str] = SEARCHED) -> DataFrame:
    """Documents with ``text`` in any of the columns; only the buckets of its trigrams are opened."""
    low = text.lower()
    grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    index = spark.createDataFrame([], POSTINGS)
    if grams:
        wanted = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket(F.col("gram"))).distinct().collect()]
        found = folders_of(spark, root, current(spark, root).tables["postings"], "bucket", sorted(wanted))
        index = spark.read.schema(POSTINGS).parquet(*found) if found else index
    some = index.filter(F.col("gram").isin(grams)).select("gram", F.explode(F.coalesce("ids", F.array("id"))).alias("id"))
    return ann.substring_search(documents, some, text, columns)
