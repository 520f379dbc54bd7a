"""Navigable small-world graphs over vectors, one for each block of a cell.

Vectors are dealt into cells (:mod:`tidewell.operators.ann`) and, within a cell, into blocks
of at most ``BLOCK`` by hash. Each block is a graph of its own, so building is linear in the
table and blocks are built and searched by different tasks: every vector is linked both ways
to the ``m`` nearest of those before it in a random order, which gives the first ones the
long links by which a search crosses the graph. A search is best-first with a list of
``ef`` candidates in every block of the query's nearest cells; the best of all blocks are
ranked. Similarity is the cosine; vectors without a direction are in no graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import vectors
from tidewell.operators import retrieval

#: Links of a vector to those before it, and candidates of a search.
M, EF = 16, 64
#: Vectors of a graph, about.
BLOCK = 4096
_STEP = 512
#: Queries that a block is searched for at once.
_ASKED = 256

GRAPH = "home int, block bigint, place int, chunk_id bigint, embedding array<float>, links array<int>"


def _units(embeddings: pd.Series) -> np.ndarray:
    x = np.array(embeddings.tolist(), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(units: np.ndarray, m: int = M) -> list[list[int]]:
    """Links of each row: to the ``m`` most similar before it, and back."""
    links: list[list[int]] = [[] for _ in units]
    for start in range(0, len(units), _STEP):
        rows = units[start : start + _STEP]
        scores = rows @ units[: start + len(rows)].T
        for k, row in enumerate(scores, start):
            near = np.argpartition(-row[:k], m)[:m] if k > m else range(k)
            for j in near:
                links[k].append(int(j))
                links[j].append(k)
    return links


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of several stretches, one after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def beams(units: np.ndarray, links: list[np.ndarray], queries: np.ndarray, ef: int = EF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`beam` for several unit queries side by side: scores (none: -inf) and rows, ``ef`` a query in any order, and how many rows were compared.

    Each step opens the best candidate of every query that still has one; candidates that
    leave a full list are worse than all of it and would never be opened.
    """
    units, queries, lines = units.astype(np.float32), queries.astype(np.float32), np.arange(len(queries))
    degree = np.array([len(n) for n in links])
    starts, targets = np.cumsum(degree) - degree, np.concatenate(links).astype(np.int64)
    seen = np.zeros((len(queries), len(units)), bool)
    best, rows, ahead = np.full((len(queries), ef), -np.inf, np.float32), np.zeros((len(queries), ef), np.int64), np.zeros((len(queries), ef), bool)
    seen[:, 0], ahead[:, 0], best[:, 0] = True, True, queries @ units[0]
    compared, live = np.ones(len(queries), np.int64), lines
    while True:
        live = live[ahead[live].any(axis=1)]
        if not len(live):
            return best, rows, compared
        at = np.where(ahead[live], best[live], -np.inf).argmax(axis=1)
        ahead[live, at] = False
        node = rows[live, at]
        who, to = np.repeat(lines[: len(live)], degree[node]), targets[_spans(starts[node], degree[node])]
        fresh = ~seen[live[who], to]
        who, to = who[fresh], to[fresh]
        seen[live[who], to] = True
        compared[live] += np.bincount(who, minlength=len(live))
        score = np.einsum("ij,ij->i", units[to], queries[live[who]])
        better = score > best[live].min(axis=1)[who]
        who, to, score = who[better], to[better], score[better]
        new = np.bincount(who, minlength=len(live))
        if not len(who):
            continue
        place = ef + _spans(np.zeros(len(live), np.int64), new)
        wide = [np.concatenate([x[live], np.zeros((len(live), new.max()), x.dtype)], axis=1) for x in (best, rows, ahead)]
        wide[0][:, ef:] = -np.inf
        for x, values in zip(wide, (score, to, True)):
            x[who, place] = values
        top = np.argpartition(-wide[0], ef - 1, axis=1)[:, :ef]
        best[live], rows[live], ahead[live] = (np.take_along_axis(x, top, axis=1) for x in wide)


def beam(units: np.ndarray, links: list[np.ndarray], query: np.ndarray, ef: int = EF) -> tuple[list[int], int]:
    """Up to ``ef`` rows most similar to a unit query, best first, and how many rows were compared with it."""
    best, rows, compared = beams(units, links, query[None, :], ef)
    found = rows[0][np.isfinite(best[0])]
    return found[np.lexsort((found, -(units[found] @ query)))].tolist(), int(compared[0])


def built(chunks: DataFrame, m: int = M, block: int | None = None) -> DataFrame:
    """Graphs over ``chunks`` (chunk_id, embedding, cell): the columns of ``GRAPH``."""
    counts = chunks.groupBy("cell").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("cell", "__cell")  # a row a cell
    dealt = chunks.join(F.broadcast(counts), F.col("cell") == F.col("__cell"))
    part = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("__n") / (block or BLOCK)))
    rows = dealt.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), F.col("cell").cast("int").alias("home"), part.cast("long").alias("part"), F.xxhash64("chunk_id", F.lit(3)).alias("order"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "chunk_id"])
        group = group[[bool(np.any(e)) and bool(np.isfinite(e).all()) for e in group["embedding"]]]
        if not len(group):
            return pd.DataFrame({"home": [], "block": [], "place": [], "chunk_id": [], "embedding": [], "links": []})
        number = int(np.uint64(abs(hash((int(group["chunk_id"].min()), len(group), int(group["part"].iloc[0])))) & 0x7FFFFFFFFFFFFFFF))
        return pd.DataFrame({"home": group["home"], "block": number, "place": range(len(group)), "chunk_id": group["chunk_id"], "embedding": group["embedding"], "links": linked(_units(group["embedding"]), m)})

    return rows.groupBy("home", "part").applyInPandas(build, GRAPH)


def dealt(graphs: DataFrame, queries: DataFrame, query_block: int | None = None) -> tuple[DataFrame, int]:
    """(home, block, group, qid, asked): every query for each block of its cells, in groups of about ``query_block``; and how many groups there are."""
    asked = queries.select("qid", F.col("embedding").alias("asked"), F.explode(F.col("near").cast("array<int>")).alias("__home"))
    most = asked.groupBy("__home").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    groups = max(1, -(-most // (query_block or retrieval.QUERY_BLOCK)))
    blocks = graphs.select("home", "block").distinct()
    group = F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("group")
    return asked.join(blocks, asked["__home"] == blocks["home"]).select("home", "block", group, "qid", "asked").toDF("home", "block", "group", "qid", "asked"), groups


def searched(graphs: DataFrame, queries: DataFrame, ef: int = EF, most: int | None = None, query_block: int | None = None) -> DataFrame:
    """(qid, chunk_id, score, compared): up to ``ef`` rows of each block for every query (qid, embedding, near: its cells).

    With ``most`` a block hands on the best ``most`` of these. Queries are dealt into groups,
    each of which meets a block in a task of its own, so a task does not grow with them; a
    graph moves once for each group.
    """
    asked, groups = dealt(graphs, queries, query_block)
    graphs = graphs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(others):
            rows = rows.sort_values("place")
            units, links = _units(rows["embedding"]), [np.asarray(n, np.int64) for n in rows["links"]]
            ids, wanted, qids = rows["chunk_id"].to_numpy(), vectors.matrix(others["asked"]), others["qid"].to_numpy()
            lengths = np.linalg.norm(wanted, axis=1, keepdims=True)
            some = np.flatnonzero(lengths[:, 0] > 0)
            for start in range(0, len(some), _ASKED):
                now = some[start : start + _ASKED]
                best, found, compared = beams(units, links, wanted[now] / lengths[now], ef)
                scores = np.round(np.einsum("qmd,qd->qm", units[found], wanted[now] / lengths[now]), 12)
                scores[~np.isfinite(best)] = -np.inf
                order = np.lexsort((ids[found], -scores))[:, : most or ef]
                scores, found = np.take_along_axis(scores, order, axis=1), np.take_along_axis(found, order, axis=1)
                line, place = np.nonzero(np.isfinite(scores))
                out.append(pd.DataFrame({"qid": qids[now][line], "chunk_id": ids[found[line, place]], "score": scores[line, place], "compared": compared[line]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": pd.Series(dtype="int64"), "chunk_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "compared": pd.Series(dtype="int64")})

    return graphs.groupBy("home", "block", "group").cogroup(asked.groupBy("home", "block", "group")).applyInPandas(search, "qid long, chunk_id long, score double, compared long")


def ranked(found: DataFrame, top_k: int) -> DataFrame:
    """(qid, rank, chunk_id, score): the best of all blocks."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*retrieval.best_first()))  # ef rows a block
    return found.select("qid", "chunk_id", "score").withColumn("rank", rank).filter(F.col("rank") <= top_k)
