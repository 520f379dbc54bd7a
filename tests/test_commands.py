import json

import pytest
from pyspark.sql import functions as F

from tests.test_plans import EXTRACTED, MODEL, files, tables  # noqa: F401  a fixture
from tidewell import storage
from tidewell.__main__ import main
from tidewell.operators import evaluation
from tidewell.plans import ingest, maintenance
from tidewell.schemas import TABLES


class Embedder:
    dimension = 16

    def embed(self, texts):
        return MODEL.embed(texts)


def answer(prompt):
    if "question et expected_answer" in prompt:
        return '{"question": "le taux directeur ?", "expected_answer": "stable"}'
    return '{"context_recall": 5, "faithfulness": 4, "answer_relevance": 3}' if prompt.startswith("Note") else "une réponse"


@pytest.fixture
def library(spark, tables):  # noqa: F811
    series = spark.createDataFrame([("d/a.pdf", k, "PIB", "Gabon", "2021", 2021, 1.0, None, "x", "S") for k in range(2)], "key string, id long, indicator string, country string, period string, year int, value double, unit string, raw_label string, source_sheet string")
    ingest.ingest_batch(spark, spark.createDataFrame(files("a", "b", "c"), EXTRACTED), tables, MODEL, series)
    spark.createDataFrame([(1, "q", True, None, None, None)], TABLES["feedback"]).write.parquet(tables["documents"].replace("documents", "feedback"))
    return {**tables, "feedback": tables["documents"].replace("documents", "feedback")}


def command(spark, library, *words):
    return main(["--tables", library["documents"].rsplit("/", 1)[0], "--embedder", "tests.test_commands:Embedder", *words], spark)


def test_commands(spark, library, tmp_path, capsys):
    assert command(spark, library, "health") == {"documents": 3, "chunks": 3, "statistics": 2, "positive": 1, "negative": 0, "satisfaction": 100.0}
    assert json.loads(capsys.readouterr().out)["documents"] == 3
    found = command(spark, library, "search", "a.pdf")
    assert (found["total"], found["searchMode"], found["items"][0]["title"]) == (1, "text", "a.pdf")
    said = command(spark, library, "ask", "statistiques du Gabon en 2021", "--generate", "tests.test_commands:answer")
    assert said["query_type"] == "hybrid" and said["answer"] == "une réponse" and "value=1.0" in said["context"]
    means = command(spark, library, "evaluate", str(tmp_path / "out"), "--generate", "tests.test_commands:answer", "--samples", "2")
    assert means["n_samples"] <= 2 and set(evaluation.METRICS) <= {k.removeprefix("avg_") for k in means}
    assert command(spark, library, "index", "--cells", "2") == {"version": 3}
    assert command(spark, library, "index", "--cells", "2") == {"version": 5} and command(spark, library, "vacuum")["folders"] == 4
    assert command(spark, library, "health")["documents"] == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(b"no pdf")
    assert command(spark, library, "ingest", str(tmp_path / "in"))["processed"] == 0
    assert command(spark, library, "query", "library_sort_recent", "/root/testdata/sf0.001") is None


def test_backfills_update_or_only_count(spark, library, tmp_path):
    documents = lambda: {r["filename"]: (r["r2_key"], r["source_url"]) for r in ingest.stored(spark, library["documents"]).collect()}
    emptied = ingest.stored(spark, library["documents"]).withColumn("r2_key", F.when(F.col("filename") != "a.pdf", F.col("r2_key"))).withColumn("source_url", F.lit(None).cast("string"))
    maintenance.replace_table(spark, emptied, library["documents"])
    assert documents()["a.pdf"] == (None, None)
    (tmp_path / "objects" / "sub").mkdir(parents=True)
    (tmp_path / "objects" / "sub" / "a.pdf").write_bytes(b"x")
    (tmp_path / "links.csv").write_text("chemin_relatif;lien\nx\\a.pdf;one\ny/a.pdf;two\n")
    for dry in (["--dry-run"], []):
        assert command(spark, library, "backfill-keys", str(tmp_path / "objects"), *dry) == {"updated": 1, "already_set": 2}
        assert command(spark, library, "backfill-links", str(tmp_path / "links.csv"), *dry) == {"updated": 1, "unmatched": 2}
        assert documents()["a.pdf"] == ((None, None) if dry else ("sub/a.pdf", "two"))
    assert command(spark, library, "backfill-keys", str(tmp_path / "objects")) == {"already_set": 3}


def test_documents_are_removed_with_their_chunks(spark, library):
    gone = ingest.stored(spark, library["documents"]).filter("filename = 'a.pdf'").select("id")
    maintenance.remove_documents(spark, library, spark.createDataFrame(gone.collect(), "id long"))
    assert ingest.stored(spark, library["documents"]).count() == 2 and ingest.stored(spark, library["chunks"]).count() == 2
    left = ingest.stored(spark, library["statistics"]).collect()
    assert len(left) == 2 and all(r["document_id"] is None for r in left)


def test_a_failed_write_changes_nothing(spark, library):
    broken = ingest.stored(spark, library["documents"]).withColumn("filename", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        maintenance.replace_table(spark, broken, library["documents"])
    assert ingest.stored(spark, library["documents"]).count() == 3
    assert storage.exists(spark, library["documents"])
