import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm import cases
from tidewell.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500):
    rows, labels = [], []
    for k, text in enumerate(cases.filler(n, 12, 40)):
        good = k % 6 != 0
        if not good:
            text = " ".join(w + "###" for w in text.split()) if k % 12 else " ".join([text.split()[0]] * 40)
        rows.append((k, text, ("en", "fr", None)[k % 3], f"site{k % 9}", 1))
        labels.append((k, int(good), 0))
    return rows, labels


def brute(rows):
    """{id: (host rate, path rate, score)} from (id, host, path, p), document by document."""
    every = [p for *_, p in rows]
    n, mean = len(rows), sum(every) / len(rows)
    hosts, paths = {}, {}
    for _, h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)

    def strength(groups, parent_of, parents):
        inside = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values()) / (n - len(groups))
        between = sum(len(g) * (np.mean(g) - np.mean(parent_of(k))) ** 2 for k, g in groups.items())
        spread = n - sum(len(g) ** 2 / len(parent_of(k)) for k, g in groups.items())
        beyond = (between - (len(groups) - parents) * inside) / spread
        return min(max(inside / beyond, 1.0), 1e6) if beyond > 0 else 1e6

    k_host, k_path = strength(hosts, lambda k: every, 1), strength(paths, lambda k: hosts[k[0]], len(hosts))

    def logit(x):
        return math.log(x / (1 - x))

    out = {}
    for i, h, q, p in rows:
        others_h, others_q = list(hosts[h]), list(paths[h, q])
        others_h.remove(p)
        others_q.remove(p)
        host = (sum(others_h) + k_host * mean) / (len(others_h) + k_host)
        path = (sum(others_q) + k_path * host) / (len(others_q) + k_path)
        out[i] = host, path, 1 / (1 + math.exp(-(logit(p) + logit(path) - logit(mean))))
    return out, k_host, k_path


def test_both_levels_match_brute_force(spark):
    r = random.Random(4)
    rows = []
    for h, sites in (("good", ("x", "y")), ("mixed", ("x", "bad", None)), (None, (None,)), ("tiny", ("x",))):
        for q in sites:
            centre = {"good": 0.9, "tiny": 0.2}.get(h, 0.2 if q == "bad" else 0.8)
            rows += [(len(rows) + k, h, q, min(max(r.gauss(centre, 0.12), 0.01), 0.99)) for k in range(1 if h == "tiny" else r.randrange(20, 60))]
    judged = spark.createDataFrame(rows, "doc_id long, host string, path string, p double")
    known = quality.hierarchy(judged, "host", "path")
    want, k_host, k_path = brute(rows)
    assert abs(known.host_strength - k_host) < 1e-6 * k_host and abs(known.path_strength - k_path) < 1e-6 * k_path
    got = quality.with_scores(judged, known, "host", "path", len(rows), "doc_id").collect()
    assert len(got) == len(rows)
    for x in got:
        assert np.allclose((x["host_rate"], x["path_rate"], x["score"]), want[x["doc_id"]], atol=1e-9)
    tiny = next(x for x in got if x["host"] == "tiny")
    assert abs(tiny["path_rate"] - known.corpus) < 1e-9  # nothing but its own document: the corpus speaks


def test_alike_sites_shrink_fully(spark):
    rows = [(k, f"h{k % 7}", f"q{k % 3}", 0.3 + 0.4 * (k * 7919 % 101) / 101) for k in range(900)]
    known = quality.hierarchy(spark.createDataFrame(rows, "doc_id long, host string, path string, p double"), "host", "path")
    assert known.host_strength > 100 and known.path_strength > 100


def test_a_site_turns_the_verdict_on_the_same_text(spark):
    """Borderline texts are kept on a good site and go on a bad one; their own evidence is equal."""
    clean, labels, rows = cases.filler(700, 61, 40), [], []
    r = random.Random(3)

    def marked(text, share):
        return " ".join(w + "##" if r.random() < share else w for w in text.split())

    for k, text in enumerate(clean[:600]):
        site = ("good", "bad", "mixed")[k % 3]
        good = r.random() < {"good": 0.97, "bad": 0.1, "mixed": 0.6}[site]
        rows.append((k, marked(text, r.uniform(0.0, 0.45) if good else r.uniform(0.35, 0.9)), "en", site, 1))
        labels.append((k, int(good), 0))
    for k, text in enumerate(clean[600:]):
        borderline = marked(text, 0.4)
        rows += [(10_000 + 2 * k, borderline, "en", "good", 1), (10_001 + 2 * k, borderline, "en", "bad", 1)]
    got = {x["doc_id"]: x for x in quality.scored(cases.docs(spark, rows, clash=False), spark.createDataFrame(labels, LABELS)).collect()}
    pairs = [(got[10_000 + 2 * k], got[10_001 + 2 * k]) for k in range(100)]
    assert all(a["p"] == b["p"] and a["score"] > b["score"] for a, b in pairs)
    assert sum(a["keep"] and not b["keep"] for a, b in pairs) >= 10
    assert any(a["keep"] and a["p"] < 0.5 for a, _ in pairs) and any(not b["keep"] and b["p"] >= 0.5 for _, b in pairs)


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, marks = cases.docs(spark, rows, clash=False), spark.createDataFrame(labels, LABELS)
    got = quality.scored(docs, marks).collect()
    truth = {k: q for k, q, _ in labels}
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["keep"] == bool(truth[r["doc_id"]]) for r in held) >= 0.98 * len(held)
    assert all(0 < r["host_rate"] < 1 and 0 < r["path_rate"] < 1 for r in got)


def test_keep_good_agrees_with_scores_and_carries_columns(spark):
    rows, labels = corpus(200)
    docs, marks = cases.docs(spark, rows).withColumn("n_words", F.lit("clash")).withColumn("s", F.lit("clash")), spark.createDataFrame(labels, LABELS)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in quality.scored(docs, marks).collect() if r["keep"]}
    assert {r["doc_id"] for r in kept.select("doc_id", "fp").collect()} == want


def test_edge_cases(spark):
    none = spark.createDataFrame([], LABELS)
    got = quality.scored(cases.docs(spark), none).collect()
    assert len(got) == len(cases.ROWS) and all(r["keep"] for r in got)
    assert quality.scored(cases.docs(spark, []), none).count() == 0
    assert quality.keep_good(cases.docs(spark, []), none).count() == 0
    marks = spark.createDataFrame([(1, 0, 0), (1, None, 0), (2, 1, 0), (3, 1, 0), (None, 1, 0), (5, 0, 0), (9, 1, 0)], LABELS)
    assert quality.scored(cases.docs(spark), marks).count() == len(cases.ROWS)
