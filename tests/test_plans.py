import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidewell import storage
from tidewell.functions.embedding import HashingEmbedder
from tidewell.config import Config
from tidewell.operators import evaluation, statements
from tidewell.plans import ask, ingest
from tidewell.plans.runner import Runner
from tidewell.schemas import TABLES
from tidewell.sources import objects
from tidewell.streaming import feedback
from tidewell.streaming.ingest import stream_files, stream_ingest

EXTRACTED = "key string, metadata map<string,string>, file_type string, text string, method string, page_count int, image_paths array<string>"
MODEL = HashingEmbedder(16)


def files(*names):
    return [(f"d/{n}.pdf", {"module": "m", "nom_pdf": f"Rapport Gabon 2021 {n}", "lien": "u"}, "pdf", f"Le taux directeur du document {n} reste stable. " * 4, "native", 3, ["i.png"]) for n in names]


@pytest.fixture
def tables(tmp_path):
    return {n: f"{tmp_path}/{n}" for n in ("documents", "chunks", "statistics")}


def test_ingest_is_idempotent(spark, tables):
    batch = spark.createDataFrame(files("a", "b") + [("d/c.pdf", {}, "pdf", "short", "native", 1, None), ("d/e.pdf", {}, "pdf", "", "error", 0, None)], EXTRACTED)
    statistics = spark.createDataFrame([("d/a.pdf", 1.0), ("d/c.pdf", 2.0)], "key string, value double")
    first = ingest.ingest_batch(spark, batch, tables, MODEL, None)
    assert (first.processed, first.failed, first.skipped) == (2, 1, 0) and first.chunks == 2
    again = ingest.ingest_batch(spark, batch, tables, MODEL)
    assert (again.processed, again.chunks, again.skipped) == (0, 0, 2)
    docs = ingest.stored(spark, tables["documents"])
    assert docs.count() == 2 and {(r["country"], r["year"], r["category"]) for r in docs.collect()} == {("Gabon", 2021, "m")}
    chunk = ingest.stored(spark, tables["chunks"]).first()
    assert len(chunk["embedding"]) == 16 and chunk["chunk_metadata"]["image_paths"] == ["i.png"]
    assert statistics.count() == 2


def test_a_folder_is_ingested_once(spark, tables, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "Rapport Gabon 2021.pdf").write_bytes(b"p")
    (tmp_path / "in" / "Tchad series.xlsx").write_bytes(b"x")
    (tmp_path / "in" / "other.txt").write_bytes(b"x")

    def pages(content):
        return ["Le rapport annuel décrit la politique monétaire. " * 4, "Seconde page."]

    def cells(content, name):
        rows = [["Indicateur des prix à la consommation", "2022", "2023"], ["Inflation annuelle moyenne", "2,5", "(1)"], ["PIB Gabon en volume", "n.d.", "7"]]
        return [("S", r, c, v, "str") for r, row in enumerate(rows) for c, v in enumerate(row)]

    got = ingest.ingest_folder(spark, str(tmp_path / "in"), tables, MODEL, pdf_reader=pages, sheet_reader=cells)
    assert (got.processed, got.failed, got.stat_rows, got.skipped) == (2, 0, 3, 0)
    series = {(r["indicator"], r["period"]): (r["country"], r["value"]) for r in ingest.stored(spark, tables["statistics"]).collect()}
    assert series == {("Inflation annuelle moyenne", "2022"): ("Tchad", 2.5), ("Inflation annuelle moyenne", "2023"): ("Tchad", -1.0), ("PIB Gabon en volume", "2023"): ("Gabon", 7.0)}
    (tmp_path / "in" / "new [1]* {x}.pdf").write_bytes(b"new")

    def only_new(content):
        assert content == b"new", "a known file was opened"
        return pages(content)

    again = ingest.ingest_folder(spark, str(tmp_path / "in"), tables, MODEL, pdf_reader=only_new, sheet_reader=only_new, files_per_job=1)
    assert (again.processed, again.skipped) == (1, 2) and ingest.stored(spark, tables["documents"]).count() == 3
    third = ingest.ingest_folder(spark, str(tmp_path / "in"), tables, MODEL, limit=2, pdf_reader=only_new, sheet_reader=only_new)
    assert (third.processed, third.skipped) == (0, 2)


def test_extraction_runs_once_and_leaves_nothing(spark, tables, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.pdf").write_bytes(b"p")
    log = tmp_path / "calls"

    def pages(content):
        with open(log, "a") as out:
            out.write("x")
        return ["Le rapport annuel décrit la politique monétaire. " * 4]

    root = storage.shared_root(spark)
    before = set(os.listdir(root.removeprefix("file:"))) if storage.exists(spark, root) else set()
    got = ingest.ingest_folder(spark, str(tmp_path / "in"), tables, MODEL, pdf_reader=pages)
    assert got.processed == 3 and len(log.read_text()) == 3
    assert set(os.listdir(root.removeprefix("file:"))) <= before


def test_keys_that_share_an_id_are_an_error(spark, tables, monkeypatch):
    monkeypatch.setattr(ingest, "document_id", lambda key="key": F.lit(7).cast("long"))
    with pytest.raises(ValueError, match="same id"):
        ingest.ingest_batch(spark, spark.createDataFrame(files("a", "b"), EXTRACTED), tables, MODEL, min_chars=1)


def test_files_are_ingested_as_they_arrive(spark, tables, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    readers = {"pdf_reader": lambda content: [content.decode() * 20], "sheet_reader": lambda content, name: [("S", 0, 0, "Libellé de la série", "str"), ("S", 0, 1, "2022", "str"), ("S", 0, 2, "2023", "str"), ("S", 1, 0, "Inflation au Gabon", "str"), ("S", 1, 1, "2,5", "str")]}
    for step, name in enumerate(["a.pdf", "sub/b.xlsx"]):
        (source / name).parent.mkdir(exist_ok=True)
        (source / name).write_bytes(b"Un texte assez long. ")
        (source / f"{step}.txt").write_bytes(b"x")
        stream_files(spark, str(source), tables, MODEL, f"{tmp_path}/cp", files=1, readers=readers).awaitTermination()
        assert ingest.stored(spark, tables["documents"]).count() == step + 1
    stream_files(spark, str(source), tables, MODEL, f"{tmp_path}/other", files=1, readers=readers).awaitTermination()  # all files again
    assert {r["r2_key"] for r in ingest.stored(spark, tables["documents"]).collect()} == {"a.pdf", "sub/b.xlsx"}
    assert [(r["country"], r["value"]) for r in ingest.stored(spark, tables["statistics"]).collect()] == [("Gabon", 2.5)]


def test_evaluation_end_to_end(spark):
    passages = spark.createDataFrame([(k, k, "f.pdf", "c", "Gabon", 2020, f"passage {k} " * 40) for k in range(6)], "chunk_id long, document_id long, filename string, category string, country string, year int, content string")

    def generate(prompt):
        if prompt.startswith("Note"):
            return '{"context_recall": 5, "faithfulness": 4, "answer_relevance": 3}'
        return "no pair" if "passage 1 " in prompt else '{"question": "Q?", "expected_answer": "A"}'

    rows = evaluation.evaluate(spark, passages, lambda q: ask.Response("R", "vector", [{"source": "f"}], None, "ctx"), generate, 6)
    assert rows.columns == list(evaluation.REPORT) and rows.count() == 5
    assert evaluation.summary(rows).first()["avg_global"] == 4.0


def test_limit_comes_before_what_is_known(spark, tables):
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    known = spark.createDataFrame([("a",)], "r2_key string")
    assert ingest.new_objects(listed, known, 1).count() == 0 and ingest.new_objects(listed, known).count() == 2


def test_streams_ingest_and_count_once(spark, tables, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in "ab":
        spark.createDataFrame(files(name), EXTRACTED).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(str(source))
    for _ in range(2):
        stream_ingest(spark, str(source), EXTRACTED, tables, MODEL, f"{tmp_path}/cp", files=1).awaitTermination()
        assert ingest.stored(spark, tables["documents"]).count() == 2


def test_feedback_stream(spark, tmp_path):
    source = tmp_path / "fb"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"id": k, "question": q, "is_positive": k % 2 == 0, "created_at": "2024-01-01T00:00:00"}) for k, q in enumerate(["a", "b", "", "x" * 2001])))
    feedback.append(feedback.read(spark, str(source)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_windowed_counts_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.repartition(3).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/ev")
    q = feedback.windowed_counts(stream, "ts", "event_type", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = feedback.windowed_counts(rows, "ts", "event_type")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))


def test_cache_order_and_expiry():
    now = [0.0]
    cache = ask.ResponseCache(2, 10, lambda: now[0])
    for q in "abc":
        cache.set(None, q, ask.Response(q, "vector"))
    assert cache.get(None, "a") is None and cache.get(None, " B ").answer == "b"
    assert cache.get(None, "b", 7) is None
    now[0] = 10.5
    assert cache.get(None, "b") is None and len(cache.entries) == 1


def test_retries_wait_and_fall_back():
    waits, calls = [], []

    def call(model):
        calls.append(model)
        if model == "a":
            raise ask.RateLimited
        return "ok"

    assert ask.with_retries(call, ["a", "b"], wait=waits.append) == "ok"
    assert waits == [3, 6, 12, 24] and calls == ["a"] * 4 + ["b"]
    with pytest.raises(KeyError):
        ask.with_retries(lambda m: {}[m], ["a"], wait=waits.append)


def test_a_question_end_to_end(spark, tables):
    ingest.ingest_batch(spark, spark.createDataFrame(files("a", "b"), EXTRACTED), tables, MODEL)
    docs = ingest.stored(spark, tables["documents"])
    chunks = ingest.stored(spark, tables["chunks"]).withColumnRenamed("id", "chunk_id").join(docs.select(F.col("id").alias("document_id"), "category", "country", "year"), "document_id")
    spark.createDataFrame([("Gabon", 2021, 3.0)], "country string, year int, value double").createOrReplaceTempView("statistics")
    asked = []
    routed = []
    engine = ask.Engine(spark, chunks, docs, MODEL, lambda p, m: asked.append((p, m)) or "la réponse", lambda q: "SELECT country, value FROM statistics", Config(models="primary,small", min_similarity=-1.0))
    plain = engine.route
    engine.route = lambda *a: routed.append(a) or plain(*a)
    assert engine.ask("Que peux-tu faire ?").query_type == "meta" and len(routed) == 1
    got = engine.ask("le taux directeur du document a au Gabon en 2021")
    assert got.query_type == "hybrid" and "- country=Gabon, value=3.0" in got.context and "[Source 1 : " in got.context and len(got.sources) == 2
    assert len(routed) == 2 and asked[-1][1] == "primary"
    assert engine.ask("le taux directeur du document a au Gabon en 2021") is got
    engine.generate = lambda p, m: f" {ask.NO_ANSWER}\n"
    assert engine.ask("le taux directeur du document b au Gabon en 2021").sources == []
    lines = list(engine.stream("le taux directeur du document b", lambda p, m: iter(["x", m]), model="small"))
    assert json.loads(lines[0])["query_type"] == "sql" and lines[1:] == ["x", "small"]
    meta = list(engine.stream("Que peux-tu faire ?", lambda p, m: iter([])))
    assert json.loads(meta[0]) == {"type": "meta", "query_type": "meta", "sources": [], "sql": None} and meta[1] == ask.META_ANSWER
    one = list(engine.stream("Que peux-tu faire ?", lambda p, m: iter([p]), document_id=docs.first()["id"]))
    assert json.loads(one[0])["query_type"] == "vector" and len(json.loads(one[0])["sources"]) == 1
    assert "structurée" in list(engine.stream("Explique-moi le document a", lambda p, m: iter([p])))[1]

    def broken(prompt, model):
        yield "x"
        raise OSError

    assert list(engine.stream("le document b", broken))[1:] == ["x", ask.INTERRUPTED]
    engine.embedder = None
    failed = list(engine.stream("le document c", broken))
    assert json.loads(failed[0])["error"] is True and failed[1:] == [ask.UNAVAILABLE]
    with pytest.raises(ValueError):
        engine.ask("?")


def test_statements_by_rule(spark):
    spark.createDataFrame([(1, 2, "Masse monétaire M2", "Gabon", "2021", 2021, 3.0, None, None, "S"), (2, 2, "Inflation", "Gabon", "2021", 2021, 4.0, None, None, "S"), (3, 2, "Inflation", "Tchad", "2022", 2022, 6.0, None, None, "S")], TABLES["statistics"]).createOrReplaceTempView("statistics")

    def rows(question):
        return [tuple(r) for r in statements.ask(spark, question, statements.offline_sql).rows]

    assert rows("Quelle est l'inflation au Gabon en 2021 ?") == [("Inflation", "Gabon", "2021", 2021, 4.0, None)]
    assert rows("la moyenne de l'inflation entre 2021 et 2022") == [("Gabon", 2021, 4.0), ("Tchad", 2022, 6.0)] or rows("la moyenne de l'inflation entre 2021 et 2022") == []
    assert len(rows("statistiques du Gabon")) == 2
    assert rows("'; DROP TABLE statistics --") == []
    assert "Guinee Equatoriale" in statements.prompt("x") and statements.model_sql(lambda p: p[-5:])("x") == "SQL :"


def test_runner_runs_once_and_reports():
    gate = []
    runner = Runner([("one", lambda log: log("hello")), ("two", lambda log: gate.append(1) or time.sleep(0.2))], count=lambda: len(gate))
    assert runner.start() and not runner.start()
    for _ in range(50):
        if runner.status()["status"] == "done":
            break
        time.sleep(0.05)
    assert runner.status()["new_documents"] == 1 and runner.status()["log_tail"] == ["hello"]
    broken = Runner([("x", lambda log: 1 / 0)])
    broken.start()
    time.sleep(0.2)
    assert broken.status()["status"] == "error"


def test_listing_links_and_tables(spark, tmp_path):
    (tmp_path / "o" / "sub").mkdir(parents=True)
    (tmp_path / "o" / "sub" / "a.pdf").write_bytes(b"x")
    (tmp_path / "o" / "b.txt").write_bytes(b"x")
    meta = spark.createDataFrame([("sub/a.pdf", {"lien": "u%20v"})], "key string, metadata map<string,string>")
    listed = objects.of_kind(objects.list_objects(spark, str(tmp_path / "o"), meta)).collect()
    assert [(r["key"], r["metadata"]) for r in listed] == [("sub/a.pdf", {"lien": "u v"})]
    (tmp_path / "links.csv").write_bytes("﻿chemin_relatif;lien\na/x.pdf;one\n;\nb/x.pdf;two\n".encode())
    assert [r["lien"] for r in objects.read_links(spark, str(tmp_path / "links.csv")).orderBy("row_no").collect()] == ["one", "two"]
    stored = storage.materialize(spark.range(0), "test")
    assert stored.columns == ["id"] and stored.count() == 0
    storage.release(stored)


def test_report_and_samples(spark, tmp_path):
    rows = spark.createDataFrame([tuple(f"{c}\nx" if c == "question" else "1" for c in evaluation.REPORT)], list(evaluation.REPORT))
    evaluation.write_report(rows, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/rows").first()["question"] == "question x"
    chunks = spark.range(500).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("a"), 300).alias("content"))
    first, again, other = (sorted(r[0] for r in evaluation.sample(c, 20, s).select("chunk_id").collect()) for c, s in ((chunks, 1), (chunks.repartition(7), 1), (chunks, 2)))
    assert first == again != other
