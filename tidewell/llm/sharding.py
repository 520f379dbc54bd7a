"""Sharding by sampled splitters; DataFrame operations only.

Records are put in the order of (key, hash, tie), where the hash of a record's id and text
tells records of one hot key apart, and the tie, a row number, equal records. A
size-weighted sample of records (weighted reservoir by hash, so it is the same at every
run, and bounded by ``SAMPLE``) gives quantile boundaries that cut the order into ranges of
about equal bytes. The exact bytes and rows of each range are summed; a range that turns out
overfull is sampled again by itself and subdivided, until none is that holds more than one
record.

Range offsets are prefix sums over the small table of ranges, positions within a range are
a window over that range alone, so no task orders more than a range. A record belongs to the shard in
which the middle of its bytes falls when the order is cut into equal parts: the law is
``bytes``, and shards differ by no more than the records at their ends.

``slot`` counts a shard's records from 0 without gaps: a record's place in the whole order
less the place of the shard's first.

Edge cases. A null text has no bytes, so size 1. Null ids come first. Ties: equal records,
however many, are told apart by their row numbers, each has its own slot, and they may be
cut between shards; which copy gets which slot makes no difference. A very long text may
make a shard larger by up to its own bytes, as no record is cut. Other columns are ignored.
No rows in, no rows out.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.storage import materialize, release

SHARDS = 16
RANGES = 1024
SAMPLE = 16 * RANGES
#: A range is overfull beyond so many times its share.
OVERFULL = 2.0
_COARSE = 32
_ORDER = ("key", "hash", "tie")
_PLACE = "struct<key:bigint,hash:bigint,tie:bigint>"

Place = tuple[int, int, int]


def _sample(rows: DataFrame, n: int, total: int) -> list[Place]:
    """(key, hash, tie) of n rows drawn by weight ``size`` without replacement, in order.

    ``total`` is the sum of weights. Rows whose exponential variates are too large to be
    among the n smallest are left out where they lie, so all tasks together hand on little
    more than n rows, however many tasks there are.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(*_ORDER, F.lit(7)), 11).cast("double") + 0.5) / float(1 << 53)
    drawn = rows.select(*_ORDER, (-F.log(uniform) / F.col("size")).alias("__p")).filter(F.col("__p") <= 2.0 * n / max(total, 1))
    got = drawn.orderBy("__p", *_ORDER).limit(n).collect()
    return sorted((r["key"], r["hash"], r["tie"]) for r in got)


def _quantiles(sample: list[Place], parts: int) -> list[Place]:
    return sorted({sample[k * len(sample) // parts] for k in range(1, parts)}) if sample else []


def _at_least(splitters: list[Place]) -> Column:
    """How many of a few sorted splitters are <= (key, hash, tie)."""
    literal = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(s, _ORDER)]) for s in splitters]) if splitters else None
    if literal is None:
        return F.lit(0)
    me = F.struct(*_ORDER)
    return F.size(F.filter(literal, lambda s: s <= me))


def range_number(splitters: list[Place]) -> Column:
    """Number of the range of (key, hash, tie): all splitters up to it, found in two levels."""
    if len(splitters) <= _COARSE:
        return _at_least(splitters)
    width = math.ceil(math.sqrt(len(splitters) + 1))
    heads = splitters[::width]
    nested = [[dict(zip(_ORDER, s)) for s in splitters[i : i + width]] for i in range(0, len(splitters), width)]
    blocks = F.from_json(F.lit(json.dumps(nested)), f"array<array<{_PLACE}>>")
    me = F.struct(*_ORDER)
    coarse = _at_least(heads)
    within = F.size(F.filter(F.element_at(blocks, F.greatest(coarse, F.lit(1))), lambda s: s <= me))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + within)


def splitters_of(rows: DataFrame, ranges: int, sample: int) -> tuple[list[Place], DataFrame]:
    """Splitters, and (range, bytes, n) of the ranges they make, none overfull that can be split."""
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    splitters = _quantiles(_sample(rows, sample, total), ranges)
    most = max(OVERFULL * total / ranges, 1)
    overfull = (F.col("bytes") > most) & (F.col("low") < F.col("high"))
    ends = F.struct(*_ORDER)
    while True:  # every round takes the largest record of each overfull range out of it and cuts the rest by quantiles
        placed = rows.withColumn("range", range_number(splitters))
        sums = materialize(placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(ends).alias("low"), F.max(ends).alias("high"), F.max_by(ends, "size").alias("largest")), "sharding-ranges")
        full = sums.filter(overfull).agg(F.count(F.lit(1)).alias("k"), F.sum("bytes").alias("b")).first()
        if not full["k"]:
            return splitters, sums
        over = sums.filter(overfull).select("range", "largest.*")  # at most ranges / OVERFULL rows
        parts = min(ranges, math.ceil(2 * full["b"] / most) + full["k"])
        drawn = _quantiles(_sample(placed.join(F.broadcast(over.select("range")), "range"), min(sample, 16 * parts), full["b"]), parts)
        alone = [(r["key"], r["hash"], r["tie"] + after) for r in over.collect() for after in (0, 1)]
        splitters = sorted({*splitters, *drawn, *alone})
        release(sums)


def sharded(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, key, size, text_crc32, shard, slot for every row; ``key`` is an integer column."""
    # rows are stored before anything is drawn from them, so their numbers stay
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.xxhash64("doc_id", "text").alias("hash"),
        F.monotonically_increasing_id().alias("tie"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = materialize(rows, "sharding-rows")
    splitters, sums = splitters_of(rows, ranges, sample)
    order = Window.orderBy("range")  # a row for each range
    before = sums.select("range", (F.sum("bytes").over(order) - F.col("bytes")).alias("bytes_before"), (F.sum("n").over(order) - F.col("n")).alias("rows_before"), F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("range", range_number(splitters)).withColumn("__bytes", F.sum("size").over(inside)).withColumn("__place", F.count(F.lit(1)).over(inside) - 1)
    placed = placed.join(F.broadcast(before), "range")
    middle = F.col("bytes_before") + F.col("__bytes") - F.col("size") + F.floor(F.col("size") / 2)
    shard = F.floor(middle.cast("decimal(38,0)") * shards / F.col("total")).cast("int")
    placed = materialize(placed.select("doc_id", "key", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("__place")).alias("place")), "sharding-placed")
    release(rows, sums)
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "key", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def op3_sharding(docs: DataFrame) -> DataFrame:
    out = sharded(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
