"""Graphs over vectors, and the indexes that a library keeps."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_plans import EXTRACTED, MODEL, files, tables  # noqa: F401  a fixture
from tidewell.operators import ann, graph, retrieval
from tidewell.plans import catalog, indexes, ingest, maintenance
from tidewell.versions import current


def recall(found, exact):
    want = {}
    for r in exact.collect():
        want.setdefault(r["qid"], set()).add(r["chunk_id"])
    got = {}
    for r in found.collect():
        got.setdefault(r["qid"], set()).add(r["chunk_id"])
    return sum(len(got.get(q, set()) & ids) for q, ids in want.items()) / sum(map(len, want.values()))


def test_links_go_both_ways_and_reach_all():
    x = np.random.default_rng(1).standard_normal((700, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = graph.linked(x, 8)
    assert all(k in links[j] for k, own in enumerate(links) for j in own)
    assert all(len([j for j in own if j < k]) == min(k, 8) for k, own in enumerate(links))
    for k in (9, 300, 699):
        near = set(np.argsort(-(x[:k] @ x[k]))[:8].tolist())
        assert near == {j for j in links[k] if j < k}


def test_a_search_compares_few_and_finds_most():
    r = np.random.default_rng(2)
    x = r.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [np.asarray(n) for n in graph.linked(x)]
    hit = compared = 0
    for q in x[:40] + 0.05 * r.standard_normal((40, 24)):
        q = q / np.linalg.norm(q)
        found, n = graph.beam(x, links, q)
        hit, compared = hit + len(set(found[:8]) & set(np.argsort(-(x @ q))[:8].tolist())), compared + n
    assert hit >= 0.95 * 40 * 8 and compared < 0.35 * 40 * 4000


def test_recall_over_the_vectors_as_they_are(spark):
    chunks = catalog._chunks(spark, "/root/testdata/sf0.1")
    centroids = ann.fit_cells(chunks, 4)
    built = graph.built(chunks.withColumn("cell", ann.cell_of(F.col("embedding"), centroids)), block=300)
    assert built.count() == chunks.count() and built.select("home", "block").distinct().count() > 4
    queries = catalog._queries(chunks)
    found = graph.searched(built, queries.withColumn("near", F.sequence(F.lit(0), F.lit(3))))
    assert recall(graph.ranked(found, 8), retrieval.topk_per_query(chunks, queries, 8)) >= 0.9


def test_vectors_without_a_direction_and_empty_tables(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0], 0) for k in range(20)] + [(100, [0.0, 0.0], 0), (101, [float("nan"), 1.0], 0)], "chunk_id long, embedding array<float>, cell int")
    built = graph.built(rows)
    assert built.count() == 20
    queries = spark.createDataFrame([(1, [1.0, 0.0], [0]), (2, [0.0, 0.0], [0])], "qid long, embedding array<float>, near array<int>")
    got = graph.ranked(graph.searched(built, queries), 3).collect()
    assert {r["qid"] for r in got} == {1} and [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"])] == [19, 18, 17]
    assert graph.searched(graph.built(rows.limit(0)), queries).count() == 0


def library_of(spark, tables):  # noqa: F811
    chunks = ingest.stored(spark, tables["chunks"]).select(F.col("id").alias("chunk_id"), "document_id", "embedding")
    return ingest.library_of(tables), chunks, ingest.stored(spark, tables["documents"])


def test_indexes_are_kept_up_by_ingest(spark, tables, monkeypatch):  # noqa: F811
    ingest.ingest_batch(spark, spark.createDataFrame(files("a", "b"), EXTRACTED), tables, MODEL)
    root, chunks, documents = library_of(spark, tables)
    indexes.build(spark, root, chunks, documents, cells=2)
    monkeypatch.setattr(ann, "fit_cells", None)  # from here on nothing is fitted
    assert [r["filename"] for r in indexes.containing(spark, root, documents, "B.PD").collect()] == ["b.pdf"]
    version = current(spark, root).number
    ingest.ingest_batch(spark, spark.createDataFrame(files("c"), EXTRACTED), tables, MODEL)
    assert current(spark, root).number == version + 1  # documents, chunks and entries in one
    root, chunks, documents = library_of(spark, tables)
    assert [r["filename"] for r in indexes.containing(spark, root, documents, "c.pdf").collect()] == ["c.pdf"]
    assert indexes.containing(spark, root, documents, "pd").count() == 3  # too short for a trigram: all are looked at
    queries = chunks.select(F.col("chunk_id").alias("qid"), "embedding")
    best = {r["qid"]: r["chunk_id"] for r in indexes.nearest(spark, root, queries, 3, 2, chunks).filter("rank = 1").collect()}
    assert best == {q: q for q in best} and len(best) == 3
    gone = spark.createDataFrame(documents.filter("filename = 'c.pdf'").select("id").collect(), "id long")
    lost = {r["chunk_id"] for r in chunks.join(gone, chunks["document_id"] == gone["id"]).collect()}
    maintenance.remove_documents(spark, tables, gone)
    root, chunks, documents = library_of(spark, tables)
    found = indexes.nearest(spark, root, queries, 3, 2, chunks).collect()
    assert found and not lost & {r["chunk_id"] for r in found}
    assert indexes.containing(spark, root, documents, "c.pdf").count() == 0


def test_a_search_opens_its_folders_only(spark, tmp_path):
    chunks = catalog._chunks(spark, "/root/testdata/sf0.001")
    documents = catalog._library_documents(spark, "/root/testdata/sf0.001")
    root = str(tmp_path)
    indexes.build(spark, root, chunks, documents, cells=8, columns=["filename", "country"])
    found = indexes.containing(spark, root, documents, "doc-12", ["filename", "country"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    opened = {p for p in found.inputFiles() if "/postings/" in p}
    assert opened and len({p.split("bucket=")[1].split("/")[0] for p in opened}) <= 4 and "Python" not in plan
    one = chunks.filter("chunk_id = 7").select(F.col("chunk_id").alias("qid"), "embedding")
    near = indexes.nearest(spark, root, one, 5, 2)
    cells = {p.split("cell=")[1].split("/")[0] for p in near.inputFiles() if "/graph/" in p}
    assert len(cells) == 2 and near.filter("rank = 1").first()["chunk_id"] == 7


def test_queries_side_by_side_find_what_each_finds_alone(spark):
    r = np.random.default_rng(4)
    x, queries = r.standard_normal((600, 12)), r.standard_normal((30, 12))
    x, queries = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, queries))
    links = [np.asarray(n) for n in graph.linked(x, 8)]
    best, rows, compared = graph.beams(x, links, queries, 20)
    for k, q in enumerate(queries):
        found, n = graph.beam(x, links, q, 20)
        assert set(found) == set(rows[k].tolist()) and n == compared[k] < 600 and np.allclose(np.sort(best[k]), np.sort(x[rows[k]] @ q), atol=1e-5)
    table = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)], "chunk_id long, embedding array<float>, cell int")
    asked = spark.createDataFrame([(k, q.tolist(), [0, 1]) for k, q in enumerate(queries)], "qid long, embedding array<double>, near array<int>")
    graphs = graph.built(table, block=100)
    few = graph.searched(graphs, asked, most=5)
    assert few.count() == 30 * 5 * graphs.select("home", "block").distinct().count()
    assert graph.ranked(few, 5).orderBy("qid", "rank").collect() == graph.ranked(graph.searched(graphs, asked), 5).orderBy("qid", "rank").collect()


def test_a_task_takes_few_queries(spark):
    r = np.random.default_rng(6)
    table = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(r.standard_normal((300, 8)))], "chunk_id long, embedding array<float>, cell int")
    asked = spark.createDataFrame([(k, v.tolist(), [0, 1] if k % 3 else [1]) for k, v in enumerate(r.standard_normal((400, 8)))], "qid long, embedding array<double>, near array<int>")
    graphs = graph.built(table, block=100).cache()
    each, groups = graph.dealt(graphs, asked, 50)
    sizes = [n for *_, n in each.groupBy("home", "block", "group").count().collect()]
    assert groups == 8 and max(sizes) < 100 and len(sizes) == 8 * graphs.select("home", "block").distinct().count()
    few, whole = (graph.searched(graphs, asked, query_block=b).select("qid", "chunk_id", "score", "compared") for b in (50, None))
    assert graph.dealt(graphs, asked)[1] == 1 and sorted(few.collect()) == sorted(whole.collect())
    assert graph.searched(graphs, asked.limit(0)).count() == 0
    graphs.unpersist()


def test_an_index_is_built_without_the_other(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    root = str(tmp_path)
    indexes.build(spark, root, catalog._chunks(spark, small), None, 2)
    assert set(current(spark, root).tables) == {"graph", "centroids"}
    held = current(spark, root).tables["graph"]
    indexes.build(spark, root, None, catalog._library_documents(spark, small), columns=["filename"])
    assert set(current(spark, root).tables) == {"graph", "centroids", "postings"} and current(spark, root).tables["graph"] == held
    assert set(current(spark, catalog._indexed(spark, small, "graph")).tables) == {"graph", "centroids"}
