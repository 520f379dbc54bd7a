"""Optional indexes: cells and codes for vectors, trigrams for substrings.

Exact search is the default. The cell index is fitted on a bounded, hash-chosen sample of
vectors (``SAMPLE``) and every vector is indexed; its table is partitioned by cell, so a
query that probes a few cells reads only their files. It pays where vectors have clusters.
The code index keeps a byte for each number of a vector, a quarter of it: codes of all
vectors propose ``SPARE`` times as many as are asked for, and whole vectors rank these.
Trigrams narrow a substring search to candidates, which are then verified, so its result is
exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import vectors
from tidewell.functions.text import grams
from tidewell.operators import retrieval
from tidewell.sampling import hash_sample

SAMPLE = 20_000
#: Candidates of the code index, for each result.
SPARE = 4
#: Documents whose ids one row of packed postings may hold.
PACKED = 1000


def fit_cells(chunks: DataFrame, cells: int, key: str = "chunk_id", rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Unit centroids by spherical k-means on at most SAMPLE vectors."""
    some = hash_sample(chunks.select(key, "embedding"), key, SAMPLE).toPandas()
    x = np.array(some["embedding"].tolist(), np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centroids = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        for k in range(len(centroids)):
            if (own == k).any():
                mean = x[own == k].mean(axis=0)
                centroids[k] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids


def cell_of(embedding: Column, centroids: np.ndarray) -> Column:
    """Number of the centroid with the largest dot product, the first of equals."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centroids])
    scores = F.transform(table, lambda c: vectors.dot(embedding, c))
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def write_cells(chunks: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Every vector, in a folder per cell; large cells go to several files."""
    chunks.withColumn("cell", cell_of(F.col("embedding"), centroids)).repartition("cell", F.pmod(F.xxhash64("embedding"), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(path)


def probe(spark: SparkSession, path: str, centroids: np.ndarray, query: Sequence[float], cells: int) -> DataFrame:
    """Chunks of the ``cells`` cells nearest to the query; other partitions are not read."""
    near = heapq.nlargest(cells, range(len(centroids)), key=lambda k: float(np.dot(centroids[k], query)))
    return spark.read.parquet(path).filter(F.col("cell").isin(near)).drop("cell")


def near_cells(embedding: Column, centroids: np.ndarray, cells: int) -> Column:
    """The ``cells`` cells nearest to each query, by dot product, the first of equals."""
    table = F.array(*[F.struct((-vectors.dot(embedding, F.array(*[F.lit(float(v)) for v in c]))).alias("d"), F.lit(k).alias("cell")) for k, c in enumerate(centroids)])
    return F.transform(F.slice(F.array_sort(table), 1, cells), lambda s: s["cell"])


def cells_topk(indexed: DataFrame, centroids: np.ndarray, queries: DataFrame, top_k: int, cells: int, metric: str = "cosine") -> DataFrame:
    """:func:`retrieval.topk_per_query` over ``indexed`` (with ``cell``), each query in its nearest cells."""
    return retrieval.topk_per_query(indexed.select("chunk_id", "embedding", "cell"), queries.withColumn("near", near_cells(F.col("embedding"), centroids, cells)), top_k, metric)


def _encode(embeddings: pd.Series) -> pd.Series:
    out = []
    for e in embeddings:
        v = np.asarray(e, np.float64)
        out.append(np.round(v * (127 / max(np.abs(v).max(initial=0), 1e-300))).astype(np.int8).tobytes())
    return pd.Series(out)


def codes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, embedding as one byte a number): every vector; write it beside the chunks."""
    return chunks.select("chunk_id", F.pandas_udf(_encode, "binary")(F.col("embedding")).alias("embedding"))


def codes_topk(coded: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int, spare: int = SPARE) -> DataFrame:
    """(qid, rank, chunk_id, score): nearest by cosine among the ``spare * top_k`` that codes propose for each query."""
    few = retrieval.topk_per_query(coded, queries, top_k * spare).select("qid", F.col("chunk_id").alias("__id"))
    asked = queries.select(F.col("qid").alias("__qid"), F.col("embedding").alias("__q"))
    pairs = few.join(asked, few["qid"] == asked["__qid"])
    whole = chunks.join(pairs, chunks["chunk_id"] == pairs["__id"]).select("qid", "chunk_id", vectors.score("cosine", F.col("embedding"), F.col("__q")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*retrieval.best_first()))
    return whole.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def trigrams(text: Column) -> Column:
    """Distinct lower-case trigrams of a text; none for fewer than three characters."""
    return grams(F.lower(text), 3)


def postings(documents: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """(gram, key) for every trigram of the columns; write it partitioned or bucketed by gram."""
    grams = F.array_distinct(F.flatten(F.array(*[F.coalesce(trigrams(F.col(c)), F.array().cast("array<string>")) for c in columns])))
    return documents.select(key, F.explode(grams).alias("gram"))


def _grams_of(texts: Sequence[str | None]) -> np.ndarray:
    """Distinct trigrams of a document's texts, each as its three code points in 63 bits."""
    out = []
    for text in texts:
        if text is not None and len(text) > 2:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            out.append(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def packed_postings(documents: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """:func:`postings` as (gram, ids): a row for each trigram of at most ``PACKED`` documents that lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                some = batch.slice(at, PACKED)
                each = [_grams_of(texts) for texts in zip(*(some.column(k + 1).to_pylist() for k in range(len(columns))))]
                grams, ids = np.concatenate(each), np.repeat(some.column(0).to_numpy(zero_copy_only=False), [len(g) for g in each])
                order = np.argsort(grams, kind="stable")
                one, starts = np.unique(grams[order], return_index=True)
                letters = (one[:, None] >> np.array([42, 21, 0]) & 0x1FFFFF).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                names = pa.array([letters[3 * k : 3 * k + 3] for k in range(len(one))], pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids[order], pa.int64()))], ["gram", "ids"])

    rows = documents.select(F.col(key).cast("long").alias("id"), *[F.lower(F.col(c)).alias(f"c{k}") for k, c in enumerate(columns)])
    return rows.mapInArrow(run, "gram string, ids array<bigint>")


def substring_search(documents: DataFrame, index: DataFrame, text: str, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Documents with ``text`` in any column: candidates hold all its trigrams, the rest is not looked at."""
    low = text.lower()
    grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(low))
    if not grams:
        return documents.filter(hit)
    holds = index.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select(F.col(key).alias("__key"))
    return documents.join(holds, documents[key] == holds["__key"], "left_semi").filter(hit)
