"""Operators against brute force, and what their plans must not do."""

import random
import re
import subprocess
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.config import Config
from tidewell.functions import registry
from tidewell.operators import ann, backfill, chatlog, chunking, dashboards, library, retrieval, routing
from tidewell.streaming.feedback import valid


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- vectors ---------------------------------------------------------------------------


def embedded(spark, n, dims, seed, clusters=0):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (n, dims)) + (8 * r.normal(0, 1, (clusters, dims))[r.integers(0, clusters, n)] if clusters else 0)
    x[n // 2] = x[0]  # a tie
    x[n // 3] = 0  # no direction
    x = x.astype(np.float32)
    return x.astype(float), spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id long, embedding array<float>")


def exact(x, queries, k, metric):
    out = {}
    for q in queries:
        if metric == "cosine":
            lengths = np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])
            score = np.where(lengths > 0, (x @ x[q]) / np.where(lengths > 0, lengths, 1), -np.inf)
        else:
            score = 1 - np.linalg.norm(x - x[q], axis=1) if metric == "l2" else 1 + x @ x[q]
        out[q] = [int(i) for i in np.lexsort((np.arange(len(x)), -np.round(score, 9)))[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_blocks_give_the_exact_nearest(spark, metric):
    x, chunks = embedded(spark, 300, 12, 3)
    asked = chunks.filter("chunk_id % 10 = 0 AND chunk_id <> 100").select(F.col("chunk_id").alias("qid"), "embedding")
    for vector_block, query_block in ((1000, 1000), (37, 7)):
        got = {}
        for r in retrieval.topk_per_query(chunks, asked, 6, metric, vector_block, query_block).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["chunk_id"])
        assert got == exact(x, [q for q in range(0, 300, 10) if q != 100], 6, metric)
    assert retrieval.topk_per_query(chunks, asked.limit(0), 6).count() == 0


def test_products_are_bounded_whatever_the_block(monkeypatch):
    r, held = np.random.default_rng(8), []
    rows, asked = r.standard_normal((9_000, 4)), r.standard_normal((700, 4))
    whole = retrieval.vectors.block_scores("cosine", asked, rows)

    def recorded(*given, block_scores=retrieval.vectors.block_scores):
        held.append(block_scores(*given))
        return held[-1]

    monkeypatch.setattr(retrieval.vectors, "block_scores", recorded)
    scores = list(retrieval.slices("cosine", rows, asked))
    assert [k for k, _ in scores] == list(range(700)) and np.allclose([s for _, s in scores], whole)
    assert len(held) > 10 and max(h.size for h in held) <= retrieval._SCORES


def test_best_rows_keep_the_first_of_equals():
    r = np.random.default_rng(9)
    for n in (0, 1, 5, 40):
        for _ in range(50):
            score = r.integers(0, 4, n).astype(float)
            score[r.random(n) < 0.2] = np.nan
            want = np.lexsort((np.arange(n), -np.where(np.isnan(score), -np.inf, score)))[:6]
            assert retrieval.best_rows(score, 6).tolist() == want.tolist()


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_batches_score_like_elements(spark, metric):
    x, chunks = embedded(spark, 90, 300, 4)
    rows = chunks.selectExpr("*", "chunk_id % 4 document_id", "'a' category", "'c' country", "cast(2020 + chunk_id % 3 AS int) year")
    for filters in (None, {"year": 2021}, {"document_id": 3}):
        plain, batched = (retrieval.retrieve(rows, x[7], 9, filters, 0.0, metric, batched).collect() for batched in (False, True))
        assert [r["chunk_id"] for r in plain] == [r["chunk_id"] for r in batched]
        assert np.allclose([r["score"] for r in plain], [r["score"] for r in batched], atol=1e-9, equal_nan=True)


def test_equal_questions_are_answered_once_and_as_one_by_one(spark, monkeypatch):
    x, chunks = embedded(spark, 120, 6, 11)
    chunks = chunks.selectExpr("*", "chunk_id % 9 document_id", "nullif('k' || chunk_id % 4, 'k3') category", "'c' country", "cast(2020 + chunk_id % 3 AS int) year").cache()
    kinds = [(7, None, None, None), (8, "k1", 2021, None), (8, "none", 2021, None), (9, "k2", 1999, None), (60, None, 2020, 4), (40, None, None, None)]
    asked = [(100 * n + k, x[v].tolist(), category, None, year, document) for n in range(30) for k, (v, category, year, document) in enumerate(kinds)]
    stored, materialize = {}, retrieval.materialize

    def counted(df, label):
        stored[label] = materialize(df, label)
        return stored[label]

    monkeypatch.setattr(retrieval, "materialize", counted)
    queries = spark.createDataFrame(asked, "qid long, embedding array<double>, category string, country string, year int, document_id long")
    got = {}
    for r in retrieval.retrieve_many(chunks, queries, 5, 0.3, vector_block=37, query_block=2).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["chunk_id"], r["tier"]))
    assert stored["questions"].count() == len(kinds)
    for k, (v, category, year, document) in enumerate(kinds):
        want = retrieval.retrieve(chunks, x[v], 5, {"category": category, "year": year, "document_id": document}, 0.3)
        want = [(r["chunk_id"], r["tier"]) for r in want.collect()]
        if category is None and year is None:  # no filter: all chunks are of the first tier
            want = [(c, 0) for c, _ in want]
        assert all(got.get(100 * n + k, []) == want for n in range(30)), k
    chunks.unpersist()
    assert retrieval.retrieve_many(chunks, queries.limit(0), 5).count() == 0


def test_codes_find_the_nearest(spark):
    x, chunks = embedded(spark, 800, 32, 5)
    asked = chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    coded = ann.codes(chunks)
    assert coded.count() == 800 and {len(r["embedding"]) for r in coded.collect()} == {32}
    want = exact(x, range(0, 800, 20), 8, "cosine")
    found = {}
    for r in ann.codes_topk(coded, chunks, asked, 8).collect():
        found.setdefault(r["qid"], set()).add(r["chunk_id"])
    assert sum(len(found[q] & set(w)) for q, w in want.items()) >= 0.98 * 8 * len(want)


def test_codes_meet_in_bounded_products():
    r = np.random.default_rng(12)
    x = r.standard_normal((5_000, 8))
    coded = retrieval.vectors.matrix(ann._encode(retrieval.pd.Series(list(x))))
    found = {k: retrieval.best_rows(score, 32) for k, score in retrieval.slices("cosine", coded, x[:300])}
    assert len(found) == 300 > retrieval._SCORES // len(coded)  # more queries than one product takes
    assert all(found[k][0] == k and len(found[k]) == 32 for k in found)


def test_a_task_holds_few_scores_of_two_full_blocks():
    r = np.random.default_rng(13)
    rows, asked = r.standard_normal((retrieval.VECTOR_BLOCK, 8)), r.standard_normal((retrieval.QUERY_BLOCK, 8))
    pd = retrieval.pd
    own = pd.DataFrame({"chunk_id": np.arange(len(rows)), "embedding": ann._encode(pd.Series(list(rows)))})
    others = pd.DataFrame({"qid": np.arange(len(asked)), "asked": list(asked)})
    tracemalloc.start()
    try:
        found = retrieval.met(own, others, 8 * ann.SPARE)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == len(asked) * 8 * ann.SPARE
    assert peak < len(rows) * len(asked) * 8 / 5  # a fifth of all scores, which a task once held several times


def test_cells_of_clusters_need_a_quarter(spark, tmp_path):
    x, chunks = embedded(spark, 1000, 24, 7, clusters=20)
    centroids = ann.fit_cells(chunks, 24)
    ann.write_cells(chunks, centroids, f"{tmp_path}/cells")
    indexed = spark.read.parquet(f"{tmp_path}/cells")
    assert indexed.count() == 1000
    asked = chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    want, found = exact(x, range(0, 1000, 20), 8, "cosine"), {}
    for r in ann.cells_topk(indexed, centroids, asked, 8, 6).collect():
        found.setdefault(r["qid"], set()).add(r["chunk_id"])
    assert sum(len(found.get(q, set()) & set(w)) for q, w in want.items()) >= 0.9 * 8 * len(want)


# --- joins that must not move the library ------------------------------------------------


def test_enrichment_does_not_shuffle_documents(spark, tmp_path):
    spark.range(2000).selectExpr("id", "concat('f', id) filename", "'c' category", "2020 year", "'u' source_url").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    hits = spark.createDataFrame([(1, 5, 0.9), (2, 99_999, 0.8), (3, 5, 0.7)], "rank int, document_id long, score double")
    got = retrieval.enriched(hits, docs)
    shape = plan(got)
    assert "SortMergeJoin" not in shape and not re.search(r"Exchange hashpartitioning\((id|__id)", shape)
    assert [(r["rank"], r["source"], r["year"]) for r in got.orderBy("rank").collect()] == [(1, "f5", 2020), (2, "doc#99999", None), (3, "f5", 2020)]


def claims(docs, objects):
    """Claims one after another, in order of ids."""
    names, taken, out = {}, {d[2] for d in docs if d[2]}, {}
    for key in objects:
        names.setdefault(key.rsplit("/", 1)[-1], []).append(key)
    for i, name, key in sorted(docs):
        found = names.get(name, [])
        if key:
            out[i] = ("already_set", key)
        elif not found:
            out[i] = ("unmatched", key)
        elif len(found) > 1:
            out[i] = ("ambiguous", key)
        elif found[0] in taken:
            out[i] = ("duplicate_rows", key)
        else:
            taken.add(found[0])
            out[i] = ("updated", found[0])
    return out


def test_claims_match_one_after_another(spark):
    r = random.Random(2)
    docs = [(k, r.choice([None, "f1", "f2", "f3", "f4", "f5"]), r.choice([None, "", "x/f1", "x/f2"]) if k % 4 == 0 else None) for k in range(80)]
    objects = ["x/f1", "y/f2", "x/f3", "z/f3", "x/f4"]
    frame = spark.createDataFrame(docs, "id long, filename string, r2_key string")
    found = backfill.claimed_keys(frame, spark.createDataFrame([(o,) for o in objects], "key string"))
    assert {x["id"]: (x["outcome"], x["new_key"]) for x in found.collect()} == claims(docs, objects)
    assert "Window" not in plan(found)
    listed = backfill.keys_by_name(spark.createDataFrame([(o,) for o in objects], "key string"), listed=1)
    assert {x["filename"]: (x["n_keys"], x["keys"]) for x in listed.collect()}["f3"] == (2, ["x/f3"])


def test_any_number_of_synonyms_without_a_nested_loop(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcé'") for _ in range(r.randrange(1, 5)))
    keys = sorted({word() for _ in range(400)} | {""})
    table = spark.createDataFrame([(k, w, [w]) for k, w in enumerate(keys)], "ord int, key string, terms array<string>")
    questions = [(k, " ".join(word() for _ in range(6)).upper()) for k in range(60)] + [(60, ""), (61, None)]
    found = routing.matched_synonyms(spark.createDataFrame(questions, "qid long, question string"), table)
    assert not any(w in plan(found) for w in ("NestedLoop", "Cartesian"))
    flat = lambda s: s.lower().replace("é", "e")
    want = {(q, k) for q, s in questions if s is not None for k in keys if flat(k) in flat(s)}
    rows = [(x["qid"], x["key"]) for x in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_dictionaries_are_read_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Taux  Été": ["x", "y"], "b": ["z"], "taux  ete": ["w"]}')
    (tmp_path / "b.json").write_text('{"key": "b", "terms": ["z"]}\n\n{"key": "a", "terms": ["x", "y"]}\n')
    got = [(r["key"], r["terms"]) for r in routing.read_synonyms(spark, str(tmp_path / "a.json")).orderBy("ord").collect()]
    assert got == [("Taux  Été", ["w"]), ("b", ["z"])]
    assert [(r["key"], r["terms"]) for r in routing.read_synonyms(spark, str(tmp_path / "b.json")).orderBy("ord").collect()] == [("b", ["z"]), ("a", ["x", "y"])]


@pytest.mark.parametrize("block", [20, 33, 1000])
def test_rolling_means_by_blocks(spark, block):
    r = random.Random(block)
    rows = [(k, r.choice("ab") if k % 3 else "a", r.randrange(12), r.random()) for k in range(400)] + [(400, None, 3, 0.5)]
    frame = spark.createDataFrame(rows, "id long, g string, t int, v double")
    plain = chatlog.rolling_mean(frame, "v", ["t", "id"], ["g"])
    dealt = chatlog.rolling_mean(frame, "v", ["t", "id"], ["g"], slot=F.floor(F.col("t") / 3), block=block)
    assert dealt.columns == plain.columns
    assert sorted(map(tuple, dealt.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_groups_come_in_order(spark):
    rows = spark.createDataFrame([("b",)] * 3 + [("a",)] * 3 + [("",)] + [(None,)] * 2 + [("0",)], "c string")
    assert [tuple(r) for r in dashboards.by_label(rows, "c", "?").collect()] == [("a", 3), ("b", 3), ("?", 2), ("?", 1), ("0", 1)]
    mixed = spark.createDataFrame([("0", 0), ("x", 5), ("", None), (None, 7)], "s string, n int")
    assert [tuple(r) for r in dashboards.distinct_values(mixed, ["s", "n"]).collect()] == [("n", "5"), ("n", "7"), ("s", "0"), ("s", "x")]


def test_sources_are_held_back(spark):
    rows = [("réponse", "vector"), (f" {chatlog.NO_ANSWER}\n", "vector"), ("", "sql"), ("x", "error"), (None, None)]
    shown = spark.createDataFrame(rows, "answer string, kind string").select(chatlog.shown_sources(F.array(F.lit("s")), F.col("answer"), F.col("kind")).alias("s"))
    assert [r["s"] for r in shown.collect()] == [["s"], None, None, None, None]


def test_feedback_needs_a_question_and_a_vote(spark):
    rows = spark.createDataFrame([("q", True), ("", True), ("q", None), (None, False), ("x" * 2000, False), ("x" * 2001, False)], "question string, is_positive boolean")
    assert valid(rows).count() == 2


def test_search_leaves_nothing_cached(spark):
    docs = spark.range(3).selectExpr("id", "concat('f', id) filename", "'c' category", "'s' subcategory", "'g' country", "2020 year", "'pdf' file_type", "'2020' date_publication", "timestamp_ntz'2020-01-01' created_at")
    chunks = spark.createDataFrame([(k, k, [1.0, k / 9], "c", "g", 2020) for k in range(3)], "chunk_id long, document_id long, embedding array<float>, type_document string, country string, year int")
    spark.catalog.clearCache()
    assert library.search(docs, "nothing", chunks=chunks, embed=lambda _: [1, 0])["total"] == 3
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


# --- chunks ------------------------------------------------------------------------------


def slow_split(text, size, overlap, count, separators):
    """The published splitter, from its description: positions and lists, no running totals."""
    separator = next((s for s in separators if s == "" or s in text), separators[-1])
    finer = separators[separators.index(separator) + 1 :]
    if separator:
        ends = [m.start() for m in re.finditer(re.escape(separator), text)]
        pieces = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if text[a:b]]
    else:
        pieces = list(text)
    out, run = [], []

    def merged(run):
        window, made = [], []
        for p in run:
            if window and sum(map(count, window)) + count(p) > size:
                made.append("".join(window).strip())
                while window and (sum(map(count, window)) > overlap or sum(map(count, window)) + count(p) > size):
                    window = window[1:]
            window = [*window, p]
        return made + (["".join(window).strip()] if window else [])

    for p in pieces:
        if count(p) < size:
            run.append(p)
            continue
        out += merged(run)
        run = []
        out += slow_split(p, size, overlap, count, finer) if finer else [p]
    return [p for p in out + merged(run) if p]


def test_chunks_match_the_splitter_by_description(spark):
    r = random.Random(11)
    parts = ["mot ", "Phrase longue ici. ", "\n", "\n\n", "x" * 23 + " ", "élan, ", "a. b", "   "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 80))) for _ in range(150)]
    for text in texts:
        if text:
            assert chunking.split_recursive(text, 14, 5, chunking.estimate_tokens) == slow_split(text, 14, 5, chunking.estimate_tokens, list(chunking.SEPARATORS))
    got = chunking.chunked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=14, overlap=5, min_chars=3).collect()
    for k, text in enumerate(texts):
        cleaned = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
        want = [p for p in (slow_split(cleaned, 14, 5, chunking.estimate_tokens, list(chunking.SEPARATORS)) if cleaned else []) if len(p) >= 3]
        mine = sorted((x["chunk_index"], x["content"], x["token_count"]) for x in got if x["doc_id"] == k)
        assert mine == [(i, p, chunking.estimate_tokens(p)) for i, p in enumerate(want)]


def test_tokens_of_a_vocabulary():
    vocabularies = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    count = chunking.VocabularyCounter(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)
    plain = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    for text in ("Le taux directeur reste stable.", "", "é ü\n\n  x1"):
        assert count(text) == len(plain.encode(text, add_special_tokens=False).ids)
    long = "x" + "\n" * 1_200_000 + "y" + " " * 30_000  # more blanks in a row than the pattern's stack takes
    assert 0 <= count(long) - len(plain.encode(long, add_special_tokens=False).ids) <= 30
    assert all(n == count(c) and n <= 40 for c, n in chunking.chunks_of("Le taux directeur de la banque reste stable. " * 30, size=40, overlap=8, count=count))


def test_functions_by_name(spark):
    assert registry.register(spark, min_chars=1) == ["chunk_text", "count_tokens", "embed_text"]
    spark.createDataFrame([(1, "Un texte. " * 300), (2, None), (3, "court")], "id long, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, c.chunk_index, c.token_count FROM texts, LATERAL chunk_text(text) c").collect()
    assert {r["id"] for r in got} == {1, 3} and max(r["chunk_index"] for r in got) > 0
    assert [tuple(r) for r in spark.sql("SELECT count_tokens(text), size(embed_text(text)) FROM texts WHERE id = 3").collect()] == [(2, 256)]


# --- settings and imports ------------------------------------------------------------------


def test_settings_from_files(tmp_path):
    (tmp_path / "c.json").write_text('{"rag": {"top_k": 5, "sql_max_rows": 9}, "chunk_tokens": 100, "unknown": 1}')
    c = Config.read(str(tmp_path / "c.json"), {"TIDEWELL_TOP_K": "7"})
    assert (c.top_k, c.sql_max_rows, c.chunk_tokens) == (7, 9, 100)
    assert chunking.chunks_of("mot " * 300, **c.chunking())[0][1] <= 100


def test_a_missing_library_is_an_error_but_a_missing_subpackage_is_not(tmp_path):
    code = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    root = __file__.rsplit("/tests/", 1)[0]
    gone = subprocess.run([sys.executable, "-c", code.format("tidewell.llm")], cwd=root, capture_output=True, text=True)
    assert gone.returncode == 0 and gone.stdout.split()[1] == "False"
    if subprocess.run([sys.executable, "-c", "import tidewell.llm.entries"], cwd=root, capture_output=True).returncode == 0:
        lacking = subprocess.run([sys.executable, "-c", code.format("ahocorasick")], cwd=root, capture_output=True, text=True)
        assert lacking.returncode != 0 and "ahocorasick" in lacking.stderr
