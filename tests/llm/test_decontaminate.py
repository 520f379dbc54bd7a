import random

from tests.llm import cases
from tidewell.llm import decontaminate

ITEMS = "item_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    width = min(5, len(words))
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()


def brute(docs, items):
    out = set()
    for item_id, text in items:
        q = shingles(text)
        width = min(5, len((text or "").split()))
        for doc_id, body, *_ in docs:
            words = (body or "").lower().split()
            have = {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()
            n = len(q & have)
            if q and n >= 0.8 * len(q) - 1e-9:
                out.add((doc_id, item_id, len(q), n))
    return out


def test_matches_brute_force(spark):
    r = random.Random(1)
    items = [(k, t) for k, t in enumerate(cases.filler(12, 31, 30) + cases.filler(4, 32, 7) + ["two words", "one", "", None, "a b c d e"])]
    items += [(3, "another text under the same id " + cases.filler(1, 33, 12)[0]), items[0]]
    rows = []
    for k, text in enumerate(cases.filler(40, 34, 200)):
        words = text.split()
        passage = (r.choice(items[:16])[1]).split()
        for _ in range(k % 4):
            passage[r.randrange(len(passage))] = "swap"
        words[50:50] = passage
        rows.append((k, " ".join(words) + (" two  words" if k % 9 == 0 else ""), "en", "a", 1))
    rows += [(*x,) for x in cases.ROWS]
    got = decontaminate.contaminations(cases.docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    assert len(got) == len({(x["doc_id"], x["item_id"], x["n_shingles"], x["n_shared"]) for x in got})
    assert {(x["doc_id"], x["item_id"], x["n_shingles"], x["n_shared"]) for x in got} == brute(rows, items)


def test_a_sketch_too_large_to_broadcast(spark, monkeypatch):
    from tidewell import skew

    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontaminate, "SAMPLED", 2)
    items = [(k, t) for k, t in enumerate(cases.filler(8, 31, 30))]
    rows = [(k, f"{t} {items[k % 3][1]} {t}", "en", "a", 1) for k, t in enumerate(cases.filler(30, 35, 50))] + [(None, items[0][1], "en", "a", 1)] * 3
    got = decontaminate.contaminations(cases.docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    assert {(x["doc_id"], x["item_id"], x["n_shingles"], x["n_shared"]) for x in got} == brute(rows, items) and len(got) == 31
    assert decontaminate.remove_contaminated(cases.docs(spark, rows), spark.createDataFrame(items, ITEMS)).count() == 0


def test_what_a_text_offers_depends_on_its_length(spark):
    items = decontaminate.sketched(spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(9))), (2, " ".join(f"b{k}" for k in range(200))), (3, "x y")], ITEMS))
    parts = decontaminate.partitions(items)
    assert sorted(parts) == [2, 5] and [least for least, _ in parts[5]] == [4, 157]
    texts = spark.createDataFrame([(k, " ".join(f"c{k}x{j}" for j in range(n))) for k, n in enumerate((7, 8, 100, 400))], "doc_id long, text string")
    for width, cut in parts.items():
        got = {}
        for r in decontaminate.offered(texts, width, cut).collect():
            got.setdefault(r["held"] + width - 1, []).append(r["code"])
        assert all(c <= max(b for least, b in cut if least <= n - width + 1) for n, codes in got.items() for c in codes)
        assert width == 2 or 7 not in got


def test_rows_go_by_their_own_text(spark):
    item, other = cases.filler(2, 77, 30)
    rows = [(1, f"x {item} y", "en", "a", 1), (1, other, "en", "a", 1), (None, item, "en", "a", 1), (None, other, "en", "a", 1), (None, None, None, None, None)]
    left = decontaminate.remove_contaminated(cases.docs(spark, rows), spark.createDataFrame([(5, item)], ITEMS)).select("doc_id", "text").collect()
    assert sorted(map(str, left)) == sorted(map(str, [(1, other), (None, other), (None, None)])) or sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(1, other), (0, other), (0, "")])


def test_sql_agrees_on_awkward_rows(spark):
    import duckdb
    import pandas as pd

    items = [(k, t) for k, t in enumerate(cases.filler(6, 31, 30) + ["two words", "one", "", None, "A b C d E"])] + [(3, "another text under the same id " + cases.filler(1, 33, 12)[0])]
    rows = [(k, f"{t} {items[k % 6][1].upper()}" + (" two\t words" if k % 4 == 0 else ""), "en", "a", 1) for k, t in enumerate(cases.filler(20, 34, 80))] + [r for r in cases.ROWS if r[1] != cases.LONG]
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    c.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = c.execute(decontaminate.ORACLE_SQL).fetchall()
    got = decontaminate.contaminations(cases.docs(spark, rows), spark.createDataFrame(items, ITEMS)).select("doc_id", "item_id", "n_shingles", "n_shared", "containment").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) > 20


def test_contaminated_rows_go(spark):
    docs = cases.docs(spark)
    left = decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, cases.BASE)], ITEMS))
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.select("doc_id").collect()) == sorted(["5", "6", "7", "8", "9", "10", "11", "12", "None"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.contaminations(cases.docs(spark), none).count() == 0
    assert decontaminate.contaminations(cases.docs(spark, []), spark.createDataFrame([(1, "x y")], ITEMS)).count() == 0
    assert decontaminate.remove_contaminated(cases.docs(spark), none).count() == len(cases.ROWS)
