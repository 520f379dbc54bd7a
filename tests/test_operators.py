import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell import schemas, skew
from tidewell.operators import backfill, chunking, library, retrieval, routing, statements, tabular
from tidewell.sources.extract import chosen_text, joined_pages

CHUNK = "chunk_id long, document_id long, content string, embedding array<float>, category string, country string, year int"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, k % 3, f"c{k}", [1.0, k / 10.0], "a" if k % 2 else "b", "Gabon" if k < 6 else None, 2020 + k % 3) for k in range(12)]
    return spark.createDataFrame(rows, CHUNK)


def test_floor_comes_after_the_limit(chunks):
    assert [r["chunk_id"] for r in retrieval.similarity_search(chunks, [1, 0], 3).collect()] == [0, 1, 2]
    assert retrieval.similarity_search(chunks, [1, 0], 3, min_similarity=0.999).count() == 1
    assert retrieval.similarity_search(chunks, [1, 0], 3, {"category": "a", "year": None}).count() == 3


def test_a_vector_without_direction_comes_last_but_is_kept(spark):
    some = spark.createDataFrame([(1, 1, "a", [0.0, 0.0], "a", None, 1), (2, 1, "b", [-1.0, 0.0], "a", None, 1)], CHUNK)
    assert [r["chunk_id"] for r in retrieval.similarity_search(some, [1, 0], 5, min_similarity=-2.0).collect()] == [2, 1]
    assert [r["chunk_id"] for r in retrieval.similarity_search(some, [0, 0], 5, min_similarity=0.5).collect()] == [1, 2]


def cascade(rows, filters, floor, k):
    """The fallback as a loop."""

    def search(f):
        hits = sorted((r for r in rows if all(r[c] == v for c, v in f.items())), key=lambda r: (-r["score"], r["chunk_id"]))[:k]
        return [r["chunk_id"] for r in hits if not r["score"] < floor]

    found = search(filters)
    if not found and "year" in filters:
        found = search({c: v for c, v in filters.items() if c != "year"})
    return found or (search({}) if filters else [])


@pytest.mark.parametrize("filters", [{}, {"year": 2021}, {"year": 1999}, {"country": "Gabon", "year": 1999}, {"country": "Mars"}, {"country": "Mars", "year": 2021}, {"category": "a", "country": "Gabon", "year": 2021}])
@pytest.mark.parametrize("floor", [0.0, 0.8, 0.99, 2.0])
def test_cascade_equals_the_loop(chunks, filters, floor):
    rows = [r.asDict() for r in retrieval.scored_chunks(chunks, [1, 0]).collect()]
    got = [r["chunk_id"] for r in retrieval.retrieve(chunks, [1, 0], 4, filters, floor).collect()]
    assert got == cascade(rows, filters, floor, 4)


def test_a_document_scope_has_no_floor(chunks):
    assert [r["chunk_id"] for r in retrieval.retrieve(chunks, [1, 0], 10, {"document_id": 2, "year": 1}, 5.0).collect()] == []
    assert len(retrieval.retrieve(chunks, [1, 0], 10, {"document_id": 2}, 5.0).collect()) == 4


def test_plans(chunks):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan(retrieval.similarity_search(chunks, [1, 0], 3))
    asked = chunks.select(F.col("chunk_id").alias("qid"), "embedding").filter("qid < 3")
    shape = plan(retrieval.topk_per_query(chunks, asked, 3))
    assert "WindowGroupLimit" in shape and not any(word in shape for word in ("Cartesian", "BroadcastNestedLoop", "Join"))


def test_search_falls_back_to_meaning(spark, chunks):
    docs = spark.createDataFrame([(k, f"f{k}.pdf", "cat", None, "Gabon", 2020, "pdf", None, None) for k in range(3)], "id long, filename string, category string, subcategory string, country string, year int, file_type string, date_publication string, created_at timestamp_ntz")
    found = library.search(docs, "F1", limit=5)
    assert found["total"] == 1 and found["searchMode"] == "text" and found["items"][0]["title"] == "f1.pdf"
    meaning = library.search(docs, "nothing", limit=2, chunks=chunks, embed=lambda _: [1, 0])
    assert meaning["searchMode"] == "semantic" and meaning["total"] == 3 and [r["id"] for r in meaning["items"]] == [0, 1]
    assert library.search(docs, "zz", chunks=chunks, embed=lambda _: [1, 0])["total"] == 0


def test_paging_is_validated(spark):
    with pytest.raises(ValueError):
        library.page(spark.range(3), [F.col("id")], 0)
    with pytest.raises(ValueError):
        library.ordering("newest")


def test_accents_are_folded_on_request_only(spark):
    row = spark.createDataFrame([("Quelle est la masse monétaire ?",)], "q string")
    assert row.select(routing.routed(F.col("q"))["query_type"]).first()[0] == "vector"
    assert row.select(routing.routed(F.col("q"), fold_accents=True)["query_type"]).first()[0] == "sql"


@pytest.mark.parametrize(("sql", "fine"), [("SELECT country FROM statistics", True), ("WITH x AS (SELECT 1) SELECT * FROM x", False), ("SELECT 'call'", False), ("DELETE FROM statistics", False), ("SELECT * FROM secrets", False), ("SELECT reflect('java.lang.System','exit')", False), ("SELECT * FROM range(3)", False), ("SELECT count(*) FROM statistics HAVING count(*) > 0", True), ("SELECT * FROM statistics WHERE value > (SELECT avg(value) FROM secrets)", False)])
def test_guard(spark, sql, fine):
    spark.range(100).selectExpr("'x' country", "id value").createOrReplaceTempView("statistics")
    spark.range(1).selectExpr("id value").createOrReplaceTempView("secrets")
    if fine:
        assert statements.run(spark, sql).count() <= statements.MAX_ROWS
    else:
        with pytest.raises(ValueError):
            statements.run(spark, sql)


def test_statement_texts(spark):
    assert statements.extract("```sql\nSELECT 1; DROP TABLE x;\n```") == "SELECT 1"
    assert statements.capped("select 1") == "select 1 LIMIT 50" and statements.capped("select 1 limit 5") == "select 1 limit 5"
    answer = statements.ask(spark, "q", lambda _: "SELECT nothing FROM statistics")
    assert answer.error and statements.context(answer).startswith("[Donnees chiffrees indisponibles")
    assert statements.context(statements.Answer("s")) == "[Aucune donnee chiffree trouvee pour cette question.]"


@given(st.lists(st.sampled_from(["mot ", "Phrase longue ici. ", "\n", "\n\n", "x" * 11 + " ", "Titre : Nom.\n"]), max_size=60))
@settings(max_examples=60, deadline=None)
def test_chunks_hold_sizes_and_words(parts):
    text = "".join(parts)
    got = chunking.chunks_of(text, size=12, overlap=4, min_chars=1)
    assert all(n == chunking.estimate_tokens(c) and c == c.strip() for c, n in got)
    assert "".join(sorted(set("".join(c for c, _ in got)) - {" ", "\n"})) == "".join(sorted(set(text) - {" ", "\n"}))


def test_directory_entries():
    assert chunking.join_titles("GOUVERNEUR\nYvon SANA BANGUI", "de la X") == "Gouverneur de la X : Yvon SANA BANGUI."
    assert chunking.chunks_of("GOUVERNEUR\nYvon SANA BANGUI", affiliation="de la X") == []
    five = "\n".join(f"Titre numero {k} : Nom Prenom du responsable." for k in range(5))
    assert [c.count("\n") for c, _ in chunking.chunks_of(five, min_chars=10)] == [3, 0]


def test_pdf_decisions(spark):
    rows = [("a.pdf", 0, "x" * 200, "", 0), ("a.pdf", 1, "n" * 100, "o" * 500, 0), ("a.pdf", 1, "n" * 10, "o" * 50, 0), ("a_b.pdf", 1, "", " ", 2), ("a.pdf", 1, "n" * 10, "o" * 5, 0)]
    frame = spark.createDataFrame(rows, "key string, page_count int, native_text string, ocr_text string, n_images int")
    assert [r["method"] for r in frame.select(chosen_text()["method"].alias("method")).collect()] == ["error", "native", "ocr", "image_extracted", "native"]
    pages = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, " ")], "key string, page int, text string")
    assert joined_pages(pages).first()["ocr_text"] == "one\ntwo"


def test_sheet_without_header_gives_nothing(spark):
    cells = spark.createDataFrame([("k", "s", 0, 0, "a"), ("k", "s", 1, 1, "2020")], "key string, sheet string, row_idx int, col_idx int, raw string")
    assert tabular.statistics(cells).count() == 0


def test_links_fill_only_empty_ones(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "pdf", None), (2, "b.pdf", "pdf", "u"), (3, "c.pdf", "pdf", ""), (4, "a.pdf", "excel", None)], "id long, filename string, file_type string, source_url string")
    links = spark.createDataFrame([("x\\a.pdf", "old", 1), ("y/a.pdf", "new", 2)], "chemin_relatif string, lien string, row_no long")
    got = {r["id"]: (r["outcome"], r["new_url"]) for r in backfill.filled_links(docs, links).collect()}
    assert got == {1: ("updated", "new"), 2: ("already_set", "u"), 3: ("unmatched", None)}


def test_deleting_cascades_and_clears(spark):
    docs = spark.range(3)
    chunks = spark.createDataFrame([(1, 0), (2, 1)], "id long, document_id long")
    stats = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id long, document_id long")
    kept, left, cleared = schemas.delete_documents(docs, chunks, stats, docs.filter("id = 1"))
    assert kept.count() == 2 and [r["id"] for r in left.collect()] == [1]
    assert {r["id"]: r["document_id"] for r in cleared.collect()} == {1: 0, 2: None, 3: None}


def test_overlong_periods_fail(spark):
    with pytest.raises(Exception, match="period too long"):
        schemas.checked_periods(spark.createDataFrame([("x" * 40,)], "period string")).collect()


def test_lookup_joins_hot_and_null_keys(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    for join in (skew.lookup, skew.attach):
        got = join(left, right, ["k"], "n", 5000, ["id"])
        assert got.columns == ["id", "k", "top"] and got.count() == 5000
        assert got.filter("k = -1 AND top <> 4998").count() == 0 and got.filter("top IS NULL").count() == 0
