"""Vector retrieval: exact filtered top-k, the fallback cascade, enrichment and context."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import vectors
from tidewell.functions.text import half_even
from tidewell.skew import attach
from tidewell.storage import materialize

FILTERS = ("document_id", "category", "country", "year")


def matches(filters: Mapping[str, object] | None, drop: Sequence[str] = ()) -> Column:
    """AND of the filters that have a value; an absent or null value does not filter."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        if value is not None and name not in drop:
            out = out & (F.col(name) == F.lit(value))
    return out


def best_first() -> list[Column]:
    """Best score first, NaN last, ties by id."""
    return [F.nanvl("score", F.lit(float("-inf"))).desc(), F.col("chunk_id")]


def scored_chunks(chunks: DataFrame, query: Sequence[float], metric: str = "cosine", batched: bool = False) -> DataFrame:
    """Chunks with ``score``; the vector is dropped as soon as it has been used.

    ``batched`` scores Arrow batches, which pays from some hundred dimensions on.
    """
    if batched:
        return chunks.withColumn("score", vectors.batch_score_to(metric, F.col("embedding"), query)).drop("embedding")
    return chunks.withColumn("score", vectors.score_to(metric, F.col("embedding"), vectors.norm(F.col("embedding")), query)).drop("embedding")


def similarity_search(chunks: DataFrame, query: Sequence[float], top_k: int = 6, filters: Mapping[str, object] | None = None, min_similarity: float | None = None, metric: str = "cosine", batched: bool = False) -> DataFrame:
    """The ``top_k`` nearest chunks under the filters, then those at or above the floor.

    ``chunks`` carries the filter columns (joined from documents where needed). The floor
    comes after the limit; a NaN score is not below any floor.
    """
    top = scored_chunks(chunks.filter(matches(filters)), query, metric, batched).orderBy(*best_first()).limit(top_k)
    return top if min_similarity is None else top.filter(~(F.col("score") < min_similarity))


#: Vectors and queries that meet in one task, about.
VECTOR_BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Scores that a task holds at once, about.
_SCORES = 1 << 19


def slices(metric: str, rows: np.ndarray, asked: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a query, its scores to all rows), a few queries as one product of matrices at a time."""
    step = max(1, _SCORES // max(len(rows), 1))
    for start in range(0, len(asked), step):
        yield from enumerate(vectors.block_scores(metric, asked[start : start + step], rows), start)


def best_rows(scores: np.ndarray, top_k: int) -> np.ndarray:
    """Places of the ``top_k`` best scores, best first, NaN last, the first of equals."""
    keyed = np.where(np.isnan(scores), -np.inf, scores)
    if len(keyed) > top_k:
        least = np.partition(keyed, len(keyed) - top_k)[len(keyed) - top_k]
        above = np.flatnonzero(keyed > least)
        some = np.concatenate([above, np.flatnonzero(keyed == least)[: top_k - len(above)]])
    else:
        some = np.arange(len(keyed))
    return some[np.lexsort((some, -keyed[some]))]


def met(own: pd.DataFrame, others: pd.DataFrame, top_k: int, metric: str = "cosine") -> pd.DataFrame:
    """(qid, chunk_id, score): the ``top_k`` of a block of vectors for each of a block of queries; about ``_SCORES`` scores are held at once."""
    if not len(own) or not len(others):
        return pd.DataFrame({"qid": pd.Series(dtype="int64"), "chunk_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    own = own.sort_values("chunk_id")
    ids, best, scores = own["chunk_id"].to_numpy(), [], []
    for _, score in slices(metric, vectors.matrix(own["embedding"]), vectors.matrix(others["asked"])):
        best.append(best_rows(score, top_k))
        scores.append(score[best[-1]])
    return pd.DataFrame({"qid": np.repeat(others["qid"].to_numpy(), [len(b) for b in best]), "chunk_id": ids[np.concatenate(best)], "score": np.concatenate(scores)})


def topk_per_query(chunks: DataFrame, queries: DataFrame, top_k: int, metric: str = "cosine", vector_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """(qid, rank, chunk_id, score): the ``top_k`` nearest chunks of every query.

    ``chunks`` has (chunk_id, embedding) and ``queries`` (qid, embedding); both may be large.
    Each is dealt into blocks by hash, and every block of queries meets every block of
    vectors in one task as products of matrices, a few queries at a time, of which each query
    keeps its ``top_k``; what a task holds does not grow with either side.
    Rows move once for each block of the other side; no pair becomes a row. If ``chunks``
    has a column ``cell`` and ``queries`` an array ``near`` of cells, a query meets these
    cells only. An embedding may be an array of numbers or, in ``chunks``, one byte each.
    """
    celled = "cell" in chunks.columns
    cell, near = (F.col("cell"), F.col("near")) if celled else (F.lit(0), F.array(F.lit(0)))
    most = chunks.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // (vector_block or VECTOR_BLOCK)))
    groups = max(1, -(-queries.count() // (query_block or QUERY_BLOCK)))
    rows = chunks.select("chunk_id", "embedding", cell.cast("int").alias("cell"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = queries.select("qid", F.col("embedding").alias("asked"), F.explode(near.cast("array<int>")).alias("cell"), F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("group"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def meet(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return met(own, others, top_k, metric)

    best = rows.groupBy("cell", "part", "group").cogroup(asked.groupBy("cell", "part", "group")).applyInPandas(meet, "qid long, chunk_id long, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*best_first()))  # top_k rows a block
    return best.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def best_chunk_per_document(hits: DataFrame) -> DataFrame:
    """Each document's best chunk; order by score for the page."""
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(*best_first()))
    return hits.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def retrieve(chunks: DataFrame, query: Sequence[float], top_k: int = 8, filters: Mapping[str, object] | None = None, min_similarity: float = 0.45, metric: str = "cosine", batched: bool = False) -> DataFrame:
    """The fallback cascade as one plan.

    With a document filter there is neither floor nor fallback. Otherwise a chunk's tier is
    0 if all filters hold, 1 if all but the year do (only if there is a year), else 2; the
    lowest tier with a chunk above the floor decides how far filters are relaxed.
    """
    filters = {k: v for k, v in (filters or {}).items() if v is not None}
    if "document_id" in filters:
        return similarity_search(chunks, query, top_k, filters, None, metric, batched).withColumn("tier", F.lit(0))
    tier = F.when(F.coalesce(matches(filters), F.lit(False)), 0)
    if "year" in filters:
        tier = tier.when(F.coalesce(matches(filters, drop=("year",)), F.lit(False)), 1)
    tier = tier.otherwise(2)
    above = scored_chunks(chunks, query, metric, batched).filter(~(F.col("score") < min_similarity)).withColumn("tier", tier)
    # the best of each tier are enough to know the lowest tier and its pool: 3 * top_k rows at most
    few = above.withColumn("__rank", F.row_number().over(Window.partitionBy("tier").orderBy(*best_first()))).filter(F.col("__rank") <= top_k).drop("__rank")
    lowest = few.withColumn("__lowest", F.min("tier").over(Window.partitionBy(F.lit(0))))
    return lowest.filter(F.col("tier") <= F.col("__lowest")).drop("__lowest").orderBy(*best_first()).limit(top_k)


def retrieve_many(chunks: DataFrame, queries: DataFrame, top_k: int = 8, min_similarity: float = 0.45, metric: str = "cosine", vector_block: int | None = None, query_block: int | None = None) -> DataFrame:
    """:func:`retrieve` for a table of questions: (qid, rank, chunk_id, document_id, tier, score).

    ``queries`` has qid, embedding and the filters of each question (``FILTERS``, null: no
    filter), ``chunks`` chunk_id, embedding and the columns they filter. Questions that agree
    in vector and filters are answered once. Both sides are dealt into blocks by hash; where a
    block of each meets, scores are products of matrices, filters one mask a value, and every
    question keeps the ``top_k`` of the lowest tier that has a chunk of the block above the
    floor. Of those of all blocks the lowest tier decides. A question with a document has
    tier 0, that document and no floor.
    """
    same = ["embedding", *FILTERS]
    once = materialize(queries.groupBy(*same).agg(F.min("qid").alias("first"), F.count(F.lit(1)).alias("__weight")), "questions")
    total, different = once.agg(F.sum("__weight"), F.count(F.lit(1))).first()
    parts = max(1, -(-chunks.count() // (vector_block or VECTOR_BLOCK)))
    groups = max(1, -(-different // (query_block or QUERY_BLOCK)))
    rows = chunks.select("chunk_id", "embedding", *FILTERS, F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = once.select("first", F.col("embedding").alias("asked"), *[F.col(f).alias(f"by_{f}") for f in FILTERS], F.pmod(F.xxhash64("first"), F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def meet(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(others):
            return pd.DataFrame({"first": [], "chunk_id": [], "document_id": [], "tier": [], "score": []})
        own = own.sort_values("chunk_id")
        columns, every = {f: own[f].to_numpy() for f in FILTERS}, np.ones(len(own), bool)
        holds = lru_cache(maxsize=1024)(lambda f, v: columns[f] == v)

        def tiers(wanted: dict) -> Iterator[np.ndarray]:
            """The chunks of each tier, those of the tiers before it included."""
            yield np.logical_and.reduce([every, *(holds(f, v) for f, v in wanted.items())])
            if "document_id" not in wanted:
                yield np.logical_and.reduce([every, *(holds(f, v) for f, v in wanted.items() if f != "year")]) if "year" in wanted else ~every
                yield every

        filters = [{f: q[f"by_{f}"] for f in FILTERS if not pd.isna(q[f"by_{f}"])} for q in others[[f"by_{f}" for f in FILTERS]].to_dict("records")]
        vector, place = np.unique(vectors.matrix(others["asked"]), axis=0, return_inverse=True)
        by_vector = np.argsort(place.ravel(), kind="stable")
        ends = np.searchsorted(place.ravel()[by_vector], np.arange(len(vector) + 1))
        found = []
        for k, score in slices(metric, vectors.matrix(own["embedding"]), vector):
            above = ~(score < min_similarity)
            for q in by_vector[ends[k] : ends[k + 1]]:
                for tier, mask in enumerate(tiers(filters[q])):
                    some = np.flatnonzero(mask if "document_id" in filters[q] else mask & above)
                    if len(some):  # what later tiers have in this block can't count any more
                        some = some[best_rows(score[some], top_k)]
                        found.append((np.full(len(some), q), some, np.full(len(some), tier), score[some]))
                        break
        which, best, tier, scores = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 4
        return pd.DataFrame({"first": others["first"].to_numpy()[which], "chunk_id": own["chunk_id"].to_numpy()[best], "document_id": own["document_id"].to_numpy()[best], "tier": tier, "score": scores})

    few = rows.groupBy("part", "group").cogroup(asked.groupBy("part", "group")).applyInPandas(meet, "first long, chunk_id long, document_id long, tier int, score double")
    lowest = few.withColumn("__lowest", F.min("tier").over(Window.partitionBy("first"))).filter(F.col("tier") <= F.col("__lowest"))  # top_k rows a block
    rank = F.row_number().over(Window.partitionBy("first").orderBy(*best_first()))
    hits = lowest.withColumn("rank", rank).filter(F.col("rank") <= top_k).groupBy("first").agg(F.collect_list(F.struct("rank", "chunk_id", "document_id", "tier", "score")).alias("hits"))
    answers = materialize(once.join(hits, "first").select(*same, "__weight", "hits"), "answers")
    return attach(queries.select("qid", *same), answers, same, "__weight", total or 0, ["qid"]).select("qid", F.inline("hits"))


def enriched_many(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """:func:`enriched` for the hits of many questions: rows of ``hits`` join their documents by id."""
    docs = documents.select(F.col("id").alias("__id"), "filename", "category", "year", "source_url")
    out = hits.join(docs, F.col("document_id") == F.col("__id"), "left")
    return out.withColumn("source", F.coalesce("filename", F.concat(F.lit("doc#"), F.col("document_id").cast("string")))).drop("__id", "filename")


def sources_many(items: DataFrame) -> DataFrame:
    """(qid, source, rank, score): one row per question and source name, the best placed."""
    first = F.row_number().over(Window.partitionBy("qid", "source").orderBy("rank"))
    return items.withColumn("__first", first).filter("__first = 1").select("qid", "source", "rank", half_even(F.col("score"), 3).alias("score"))


def enriched(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """A few ranked hits with their documents' columns; a missing document gives ``doc#id`` and nulls.

    The hits' ids are broadcast to the documents, which are filtered where they lie; what is
    left is no larger than the hits and joins them by broadcast.
    """
    wanted = hits.select(F.col("document_id").alias("__wanted")).distinct()
    docs = documents.join(F.broadcast(wanted), documents["id"] == F.col("__wanted"), "left_semi").select(F.col("id").alias("__id"), "filename", "category", "year", "source_url")
    out = hits.join(F.broadcast(docs), F.col("document_id") == F.col("__id"), "left")
    return out.withColumn("source", F.coalesce("filename", F.concat(F.lit("doc#"), F.col("document_id").cast("string")))).drop("__id", "filename")


def distinct_sources(items: DataFrame, default_url: str = "") -> DataFrame:
    """One row per source name, the best placed; scores to three digits beside the raw value."""
    first = F.row_number().over(Window.partitionBy("source").orderBy("rank"))
    one = items.withColumn("__first", first).filter("__first = 1").drop("__first")
    return one.select(
        "rank",
        "source",
        "category",
        "year",
        half_even(F.col("score"), 3).alias("score"),
        F.col("score").alias("raw_score"),
        F.coalesce(F.nullif("source_url", F.lit("")), F.lit(default_url)).alias("source_url"),
        F.when(F.col("document_id") != 0, F.concat(F.lit("/api/documents/"), F.col("document_id").cast("string"), F.lit("/view"))).alias("url"),
    )


# Fixed value: the context where nothing was found.
NO_CONTEXT = "[Aucun document pertinent trouve.]"


def context_text(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ranked items as one text per group: ``[Source i : name, year]`` and the content."""
    label = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" : "), F.col("source"), F.when(F.coalesce(F.col("year"), F.lit(0)) != 0, F.concat(F.lit(", "), F.col("year").cast("string"))).otherwise(""), F.lit("]\n"), F.coalesce("content", F.lit("")))
    blocks = items.select(*by, "rank", label.alias("block")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return blocks.select(*by, F.when(F.size("b") == 0, NO_CONTEXT).otherwise(F.array_join("b.block", "\n\n")).alias("context"))


def joined_context(*parts: str | None) -> str:
    """Non-empty context texts, separated by a blank line."""
    return "\n\n".join(p for p in parts if p)
