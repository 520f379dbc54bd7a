import random

import numpy as np
import pytest

from tests.llm import cases
from tidewell.llm import simhash


def brute(prints):
    """Component of each index by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def slow_fingerprint(text):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_definition():
    for _, text, *_ in cases.ROWS:
        if text != cases.LONG:
            assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_anchors_cover_and_are_complete():
    half = np.random.default_rng(3).integers(0, 1 << 32, 300).astype(np.int64)
    home = simhash.home_anchor(half)
    assert (simhash.home_anchor(home) == home).all()
    assert (simhash._weight(home ^ half) <= 1).all()
    for radius in (1, 2):
        index, anchor = simhash.near_anchors(half, radius)
        for k in range(0, 300, 50):
            x = int(half[k])
            ball = {x} | {x ^ 1 << p for p in range(32)}
            if radius == 2:
                ball |= {x ^ 1 << p ^ 1 << q for p in range(32) for q in range(p)}
            ball = np.array(sorted(ball), np.int64)
            assert set(ball[simhash.home_anchor(ball) == ball].tolist()) == set(anchor[index == k].tolist())


@pytest.mark.parametrize("size", [30, 400])
def test_links_of_one_run_match_brute_force(size):
    r = np.random.default_rng(size)
    base = r.integers(0, 1 << 62, size // 10, dtype=np.int64)
    fp = base[r.integers(0, len(base), size)]
    for _ in range(3):
        fp = fp ^ np.where(r.random(size) < 0.5, np.int64(1) << r.integers(0, 62, size), 0)
    fp = np.unique(fp)
    a, b = simhash._links(np.zeros(len(fp), np.int64), fp, 2)
    place = {int(x): k for k, x in enumerate(fp)}
    roots = simhash._roots(len(fp), np.array([place[int(x)] for x in a], np.int64), np.array([place[int(x)] for x in b], np.int64))
    assert roots.tolist() == brute([int(x) for x in fp])


def test_components_match_brute_force(spark):
    r = random.Random(5)
    texts = cases.filler(60, 1, 40)
    for t in texts[:20]:
        words = t.split()
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += texts[:15] + ["", None, " ", "one", "one"]
    rows = [(1000 - k, t, "en", "a", 1) for k, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in simhash.op4_simhash(cases.docs(spark, rows)).collect()}
    rows.sort()
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    for (doc_id, *_), fp, root in zip(rows, prints, brute(prints)):
        assert got[doc_id]["fingerprint"] == f"{fp:016x}"
        assert got[doc_id]["component_id"] == rows[root][0]


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_crowded_anchors_are_taken_apart(spark, monkeypatch, distance):
    monkeypatch.setattr(simhash, "CROWD", 1)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    r = np.random.default_rng(distance)
    fp = np.full(150, r.integers(1 << 60, 1 << 62), np.int64)
    for _ in range(4):
        fp = fp ^ np.where(r.random(150) < 0.6, np.int64(1) << r.integers(0, 63, 150), 0)
    fp = np.unique(np.r_[fp, fp[:5] ^ np.int64(-(1 << 63)), r.integers(0, 1 << 62, 40)])
    distinct = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    assert simhash.crowded_anchors(distinct, 2).count() > 100
    links = {frozenset((x["a"], x["b"])) for x in simhash.anchor_links(distinct, distance).collect()}
    near = {(int(x), int(y)) for x in fp for y in fp if x < y and bin((int(x) ^ int(y)) & (1 << 64) - 1).count("1") <= distance}
    assert all(tuple(sorted(x)) in near for x in links)
    place = {int(x): k for k, x in enumerate(fp)}
    roots = [simhash._roots(len(fp), np.array([place[min(x)] for x in e], np.int64), np.array([place[max(x)] for x in e], np.int64)).tolist() for e in (links, near)]
    assert roots[0] == roots[1]


def test_edge_cases(spark):
    got = simhash.op4_simhash(cases.docs(spark)).collect()
    assert len(got) == len(cases.ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {by[k]["component_id"] for k in (1, 2, 3, 4)} == {1}
    assert {by[k]["fingerprint"] for k in (5, 6, 7)} == {"0" * 16} and {by[k]["component_id"] for k in (5, 6, 7)} == {5}
    assert simhash.op4_simhash(cases.docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    docs = cases.docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids == [1, 5, 8, 9, 10, 11, 12]
