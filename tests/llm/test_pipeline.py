import random
from collections import Counter

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import edited, kept_by_brute_force
from tests.llm.test_packing import ids_of
from tidewell.llm import packing

LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"


def tables(spark, folder):
    rows, labels = [], []
    items = [(k, t) for k, t in enumerate(cases.filler(5, 71, 20))]
    r = random.Random(4)
    for k, text in enumerate(cases.filler(420, 70, 40)):
        good, toxic = k % 6 != 0, k % 7 == 3
        words = text.split()
        if toxic:
            words.insert(5, "zarkole")
        if k % 25 == 8:
            words[9:9] = items[k % 5][1].split()
        if not good:
            words = [w + "###" for w in words]
        rows.append((k, " ".join(words), "en", f"s{k % 4}", 1))
        labels.append((k, int(good), int(toxic)))
    rows += [(1000 + k, rows[k][1].replace(" ", "  "), "en", "s0", 1) for k in range(40)]
    base = cases.filler(1, 91, 120)[0]
    rows += [(2000 + k, edited(base, r, k % 4), "en", "s1", 1) for k in range(24)]  # near copies
    cases.docs(spark, rows, clash=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, items


def pieces(rows):
    return sorted((str(r[0]), start, size, len(ids_of(r[1]))) for r in rows for start, size in packing.binary_pieces(len(ids_of(r[1]))))


def result(spark, folder):
    return sorted((str(r["doc_id"]), r["start"], r["length"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, str(folder)).collect())


def test_every_stage_takes_effect(spark, tmp_path):
    rows, labels, items = tables(spark, str(tmp_path))
    truth = {k: (q, t) for k, q, t in labels} | {1000 + k: labels[k][1:] for k in range(40)}
    kept = [r for r in rows if truth.get(r[0], (1, 0)) == (1, 0)]
    stay = set(kept_by_brute_force(kept))
    kept = [r for r in kept if r[0] in stay]
    dirty = {d for d, *_ in leaks(kept, items)}
    assert dirty and 2000 in stay and len(stay & set(range(2000, 2024))) < 8
    assert result(spark, tmp_path) == pieces([r for r in kept if r[0] not in dirty])


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_awkward_rows_go_through(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties, columns with names that stages use."""
    other = cases.filler(1, 13, 30)[0]
    rows = [*cases.ROWS, (2, other, None, "a", 1), (None, other + " more", "en", None, None)]
    cases.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, None, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, cases.BASE), (2, None), (None, ""), (1, "absent words only")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = result(spark, tmp_path)
    want = [next(r for r in rows if r[0] == k) for k in (5, 8, 9, 10, 11, 12)] + [(2, other)]  # of the copies of BASE one stays, and it holds item 1
    assert Counter(got) == Counter(pieces(want))


def test_empty_tables_give_no_rows(spark, tmp_path):
    cases.docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and "sequence_id" in got.columns
