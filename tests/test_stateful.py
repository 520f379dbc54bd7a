"""Streams with state give what the batch gives, in any order of arrival and over replays."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import stateful

SCHEMA = "key string, id long, ts timestamp, value double"


def made(n, keys, seed=1):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys)}", k, 1_700_000_000 + r.randrange(40_000), r.random()) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, s long, value double").select("key", "id", F.timestamp_seconds("s").alias("ts"), "value")


def expected_means(rows, n):
    out, last = {}, {}
    for key, row_id, _, value in sorted(rows, key=lambda r: (r[2], r[1])):
        last[key] = [*last.get(key, []), value][-n:]
        out[row_id] = sum(last[key]) / len(last[key])
    return out


def expected_hits(rows, ttl):
    out, made_at = {}, {}
    for key, row_id, at, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        out[row_id] = key in made_at and at - made_at[key] <= ttl
        if not out[row_id]:
            made_at[key] = at
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_streams_equal_the_batch(spark, tmp_path, shuffled):
    rows = made(400, 5)
    order = sorted(rows, key=lambda r: r[2])
    if shuffled:
        random.Random(3).shuffle(order)
    source = str(tmp_path / "in")

    def run(kind):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        found = stateful.rolling_means(stream, "20 hours", 7) if kind == "means" else stateful.cache_hits(stream.drop("value"), "20 hours", 900)
        stateful.drained(found, f"{tmp_path}/{kind}", f"{tmp_path}/cp-{kind}")

    for part in range(4):  # each part in a file of its own; the stream is stopped and started again after each
        frame(spark, order[part::4] if shuffled else order[part * 100 : part * 100 + 100]).coalesce(1).write.mode("append").parquet(source)
        if part % 2:
            run("means")
            run("hits")
    stateful.flush(frame(spark, rows)).coalesce(1).write.mode("append").parquet(source)
    for kind in ("means", "hits", "means", "hits"):  # a stream that starts again adds nothing
        run(kind)
    means = {r["id"]: r["rolling"] for r in spark.read.parquet(f"{tmp_path}/means").filter("id >= 0").collect()}
    hits = [(r["id"], r["hit"]) for r in spark.read.parquet(f"{tmp_path}/hits").filter("id >= 0").collect()]
    want = expected_means(rows, 7)
    assert means.keys() == want.keys() and all(abs(means[k] - v) < 1e-12 for k, v in want.items())
    assert len(hits) == 400 and dict(hits) == expected_hits(rows, 900)
    assert 0 < sum(h for _, h in hits) < 400


def test_state_in_tables_equals_the_batch(spark, tmp_path):
    rows = made(400, 5)
    order = sorted(rows, key=lambda r: r[2])
    source = str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stateful.rolled(stream, f"{tmp_path}/means", f"{tmp_path}/cp", "1 hour", 7)

    for part in range(4):  # by time, with the rows of half an hour out of order
        lot = [r for k, r in enumerate(order) if min((k + 7 * (k % 2)) // 100, 3) == part]
        frame(spark, lot).coalesce(1).write.mode("append").parquet(source)
        if part % 2:
            run()
    stateful.flush(frame(spark, rows)).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = [(r["id"], r["rolling"]) for r in spark.read.parquet(f"{tmp_path}/means").filter("id >= 0").collect()]
    want = expected_means(rows, 7)
    assert len(got) == 400 and dict(got).keys() == want.keys() and all(abs(v - want[k]) < 1e-12 for k, v in got)
    assert len({r["batch"] for r in spark.read.parquet(f"{tmp_path}/means").select("batch").distinct().collect()}) > 2  # not all at the end


def test_the_end_of_a_stream_makes_no_part_late(spark, tmp_path):
    from tidewell.plans import catalog

    days = "timestamp_seconds(1700000000 + id * 50) ts"
    events = spark.range(4000).repartition(9).selectExpr("id event_id", days, "id user_id", "'k' || id % 2 event_type", "id * 0.5D value")
    events.write.parquet(f"{tmp_path}/events.parquet")  # nine files: a part is more of them than a trigger takes
    assert catalog.rolling_latency_stream(spark, str(tmp_path)).count() == 4000
    assert catalog.cache_expiry_stream(spark, str(tmp_path)).count() == 4000
