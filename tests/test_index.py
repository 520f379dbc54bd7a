import numpy as np

from tidewell.config import Config
from tidewell.operators import ann, retrieval
from tidewell.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_cells_hold_every_vector_and_recall_is_high(spark, tmp_path):
    chunks = catalog._chunks(spark, DATA)
    centroids = ann.fit_cells(chunks, 8)
    ann.write_cells(chunks, centroids, f"{tmp_path}/cells")
    assert spark.read.parquet(f"{tmp_path}/cells").count() == chunks.count()
    hit = total = 0
    for q in [r["embedding"] for r in chunks.filter("chunk_id % 100 = 0").collect()]:
        exact = {r["chunk_id"] for r in retrieval.similarity_search(chunks, q, 8).collect()}
        found = {r["chunk_id"] for r in retrieval.similarity_search(ann.probe(spark, f"{tmp_path}/cells", centroids, q, 7), q, 8).collect()}
        hit, total = hit + len(exact & found), total + len(exact)
    assert hit >= 0.9 * total
    probed = ann.probe(spark, f"{tmp_path}/cells", centroids, [1.0] * 64, 2)
    assert "PartitionFilters: [cell#" in probed._jdf.queryExecution().executedPlan().toString()


def test_cell_is_the_nearest_centroid(spark):
    centroids = np.array([[1.0, 0.0], [0.0, 1.0]])
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([3.0, 1.0],), ([1.0, 2.0],), ([1.0, 1.0],)], "v array<float>")
    assert [r[0] for r in rows.select(ann.cell_of(F.col("v"), centroids)).collect()] == [0, 1, 0]


def test_trigrams_are_exact(spark):
    docs = spark.createDataFrame([(1, "Rapport annuel"), (2, "annuaire"), (3, None), (4, "ra")], "id long, name string")
    index = ann.postings(docs, ["name"])
    assert [r["id"] for r in ann.substring_search(docs, index, "ANNU", ["name"]).orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in ann.substring_search(docs, index, "ra", ["name"]).orderBy("id").collect()] == [1, 4]


def test_packed_postings_are_the_postings(spark):
    texts = ["Rapport annuel", "annuaire " * 400, None, "ra", "", "\U0001f600bc\U0001f600 \0\0\0x", "É\n\téa"]
    docs = spark.createDataFrame([(k, texts[k % 7], texts[k * 3 % 7]) for k in range(2300)], "id long, a string, b string").coalesce(1)
    packed = ann.packed_postings(docs, ["a", "b"])
    got = packed.selectExpr("gram", "explode(ids) id").collect()
    want = {(low[k : k + 3], r["id"]) for r in docs.collect() for low in [t.lower() for t in (r["a"], r["b"]) if t] for k in range(len(low) - 2)}
    assert len(got) == len(want) and {(r["gram"], r["id"]) for r in got} == want
    assert packed.count() < len(want) / 100  # a row for many documents
    index = packed.selectExpr("gram", "explode(ids) id")
    assert ann.substring_search(docs, index, "ANNU", ["a", "b"]).count() == sum("annu" in f"{r['a']} {r['b']}".lower() for r in docs.collect())


def test_config_layers():
    c = Config.load({"top_k": "5", "unknown": 1, "models": "a, b,"}, {"TIDEWELL_MIN_SIMILARITY": "0.3"})
    assert (c.top_k, c.min_similarity, c.chunk_tokens) == (5, 0.3, 400)
    assert c.listed("models") == ["a", "b"] and c.resolve_model("b") == "b" and c.resolve_model("x") == "primary"
