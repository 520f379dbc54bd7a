import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm import cases
from tidewell.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes):
    """Targets by resharing the excess round by round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    held, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in held]
        share = sum(weight[s] for s in open_)
        out = {s: left * weight[s] / share for s in open_} if share else {}
        full = [s for s in open_ if out[s] > 3 * sizes[s]]
        if not full:
            return held | out
        for s in full:
            held[s] = 3 * sizes[s]
            left -= held[s]


def check(got, rows):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for doc_id, text, _, source, *_ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    source_of = {doc_id: source for doc_id, _, _, source, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            s = source_of[r["doc_id"]]
            assert r["source_size"] == sizes[s]
            taken[s] += r["taken"]
            targets[s] = r["target"]
    return sizes, taken, targets


def test_counts_words_as_the_pattern_does():
    texts = ["", " ", "a", " a  b\n", "é ü x", "x" * 40, "\x0b\x0c\r\t one\x1ftwo three ", "a b " * 30, None and ""]
    texts = [t or "" for t in texts]
    column = pa.array(["skip me", *texts])[1:]
    old, mixing.CHUNK = mixing.CHUNK, 7
    try:
        small = mixing.count_words(column).tolist()
    finally:
        mixing.CHUNK = old
    assert small == mixing.count_words(column).tolist() == [len(WORD.findall(t)) for t in texts]
    assert mixing.count_words(pa.array([], pa.string())).tolist() == []


def test_points_are_those_of_the_golden_ratio(spark):
    for first in (0, 10**12 - 5, 3 * 10**15):
        got = [r[0] for r in spark.range(first, first + 20).select(mixing.point(F.col("id"))).collect()]
        assert got == [i * mixing.STEP % mixing.LATTICE for i in range(first, first + 20)]
    assert abs(mixing.STEP / mixing.LATTICE - (5**0.5 - 1) / 2) < 1e-20 + 1e-15


def corpus():
    rows = [(k, t, "en", f"s{k % 7}" if k % 3 else "hot", 1) for k, t in enumerate(cases.filler(400, 3, 70))]
    rows += [(1000 + k, "tiny text here", "en", "tiny", 1) for k in range(4)] + [(2000, "no source at all " * 5, "en", None, 1)]
    return rows


def test_targets_are_met_to_the_word(spark):
    rows = corpus()
    sizes, taken, targets = check(mixing.op12_mixing(cases.docs(spark, rows)).collect(), rows)
    want = expected_targets(sizes)
    assert set(targets) == set(want)
    for s, t in want.items():
        assert abs(targets[s] - t) < 1e-6 * max(t, 1)
        assert abs(taken[s] - t) <= 1


def test_a_prefix_of_the_schedule_holds_the_sources_in_proportion(spark):
    rows = corpus()
    told, mix = mixing.mixed(cases.docs(spark, rows))
    source = {r["pos"]: (r["g"], r["target"]) for r in told.collect()}
    slots = defaultdict(lambda: defaultdict(int))
    for r in mix.collect():
        slots[r["slot"]][source[r["pos"]][0]] += r["words"]
    assert all(len(by) == 1 and max(by.values()) <= mixing.BLOCK for by in slots.values())
    total = sum(v for by in slots.values() for v in by.values())
    at, seen = 0, defaultdict(int)
    for slot in sorted(slots):
        for g, words in slots[slot].items():
            seen[g] += words
            at += words
        for g, target in set(source.values()):
            assert abs(seen[g] - target * at / total) <= 6 * mixing.BLOCK


def test_another_run_on_other_partitions_gives_the_same_mix(spark):
    docs = cases.docs(spark, corpus())
    a = sorted(map(tuple, mixing.op12_mixing(docs).collect()), key=repr)
    assert a == sorted(map(tuple, mixing.op12_mixing(docs.repartition(7)).collect()), key=repr)


def test_awkward_rows(spark):
    got = mixing.op12_mixing(cases.docs(spark)).collect()
    check(got, cases.ROWS)
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, *_ in cases.ROWS)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.op12_mixing(cases.docs(spark, [])).count() == 0
    blank = mixing.op12_mixing(cases.docs(spark, [(1, None, "en", "a", 1), (2, " \n", "en", None, 1)])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in blank] == [(0, 0, 0.0, 0)] * 2


def test_equal_rows_of_one_document_are_cut(spark):
    rows = [(7, "the same few words again", "en", "a", 1)] * 300 + [(k, t, "en", "b", 1) for k, t in enumerate(cases.filler(20, 5))]
    got = mixing.op12_mixing(cases.docs(spark, rows)).collect()
    assert len(got) == 320
    taken = sum(r["taken"] for r in got if r["doc_id"] == 7 and r["size"] == 5)
    assert abs(taken - next(r["target"] for r in got if r["size"] == 5)) <= 1
