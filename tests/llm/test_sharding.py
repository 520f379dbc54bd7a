import zlib

from pyspark.sql import functions as F

from tests.llm import cases
from tidewell.llm import sharding


def held(rows, shards=16):
    for k in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_exact_cuts_and_edge_cases(spark):
    got = sharding.op3_sharding(cases.docs(spark)).collect()
    assert len(got) == len(cases.ROWS)
    held(got)
    for doc_id, text, *_ in cases.ROWS:
        mine = [r for r in got if r["doc_id"] == doc_id]
        assert (len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) in {(r["size"], r["text_crc32"]) for r in mine}
    assert sharding.op3_sharding(cases.docs(spark, [])).count() == 0


def test_shards_are_prefix_cuts_of_bytes(spark):
    texts = cases.filler(400, 9)
    rows = [(k, t * (1 + k % 5), "en", "a", 1) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in sharding.op3_sharding(cases.docs(spark, rows)).collect()}
    total, at = sum(len(t) + 1 for _, t, *_ in rows), 0
    for doc_id, text, *_ in rows:
        size = len(text) + 1
        assert got[doc_id]["shard"] == (at + size // 2) * 16 // total
        at += size
    sums = [sum(r["size"] for r in got.values() if r["shard"] == k) for k in range(16)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in got.values())


def test_a_hot_key_is_subdivided(spark):
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(cases.filler(600, 4, 12))]
    docs = cases.docs(spark, rows, clash=False).withColumn("k", F.when(F.col("doc_id") % 3 == 0, 5).otherwise(F.col("doc_id")))
    got = sharding.sharded(docs, "k", ranges=32, sample=256).collect()
    held(got)
    sums = [sum(r["size"] for r in got if r["shard"] == k) for k in range(16)]
    assert max(sums) < 1.2 * min(sums)
    slim = docs.select("doc_id", F.col("k").alias("key"), F.xxhash64("doc_id", "text").alias("hash"), F.col("doc_id").alias("tie"), F.lit(100).cast("long").alias("size"))
    _, ranges = sharding.splitters_of(slim, 32, 256)
    assert max(r["n"] for r in ranges.collect()) <= 2 * 2 * 600 / 32


def test_a_hot_group_of_equal_rows_is_cut(spark):
    rows = [(7, "the very same text", "en", "a", 1)] * 500 + [(None, None, None, None, None)] * 200 + [(k, t, "en", "a", 1) for k, t in enumerate(cases.filler(100, 4, 12))]
    docs = cases.docs(spark, rows)
    got = sharding.sharded(docs, ranges=32, sample=256).collect()
    held(got)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) > 2
    assert len(got) == len(rows) and len({(r["shard"], r["slot"]) for r in got}) == len(rows)
    slim = spark.range(800).select(F.lit(7).cast("long").alias("key"), F.lit(1).cast("long").alias("hash"), F.col("id").alias("tie"), F.lit(100).cast("long").alias("size"))
    _, ranges = sharding.splitters_of(slim, 32, 64)
    assert max(r["n"] for r in ranges.collect()) <= 2 * 800 / 32


def test_one_record_larger_than_all_ranges(spark):
    rows = [(k, "x" * (1_000_000 if k == 5 else 10), "en", "a", 1) for k in range(60)]
    got = sharding.sharded(cases.docs(spark, rows), ranges=32, sample=64).collect()
    held(got)
    assert len(got) == 60
