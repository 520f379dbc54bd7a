"""Mixing sources to target weights by a low-discrepancy schedule.

Every source has a target of words. Its documents, shuffled by hash, are one stream of
words, repeated as often as the target asks, and cut into blocks of ``BLOCK`` words whatever
documents they hold. The schedule has a slot for each block: slot i has the golden-ratio
point i * A mod M (consecutive Fibonacci numbers, so the points are exact integers of low
discrepancy), the points map through the cumulative numbers of blocks to a source, and
the r-th slot of a source takes its r-th block. A prefix of the schedule of any length
thereby holds every source in proportion up to a few blocks, and the whole schedule takes
each source's target to the word: slots beyond a source's last block are dropped, the few
that the points left out close the schedule, and the last block ends at the target.

Targets. Sources in order of code points, null last, have the weights 1, 2, 3, 1, ... and
share all words; none gets more than ``EPOCHS`` times its own, and what exceeds that is
shared again by weight until none does.

Order. Documents of a source are ordered by a hash of id and text, then id, size and row
number; rows that tie up to the row number are equal, so it makes no difference which is
which, and another run on other partitions gives the same mix. Positions in a stream are
running sums over range-sorted partitions, ranks of slots likewise, so a source with a third
of all rows is cut like the others. Points meet intervals in buckets of ``BUCKET`` blocks,
which hold at most so many points and so many sources.

Edge cases. A null or blank text has no words: it is never taken, and a source of such texts
has target 0. Null sources are one source, the last; an empty name is another. Null ids and
repeated rows are documents like others. A very long text spreads over many blocks. Other
columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.ordered import range_sorted, running
from tidewell.skew import attach
from tidewell.storage import materialize, release

#: Words in a block.
BLOCK = 256
#: Bytes of texts in which words are counted at once.
CHUNK = 1 << 22
#: A source gives its words at most so often.
EPOCHS = 3
#: Blocks in a bucket of the schedule.
BUCKET = 256
#: Consecutive Fibonacci numbers: the points i * STEP mod LATTICE are those of the golden ratio.
STEP, LATTICE = 591286729879, 956722026041
_HALF = 1 << 20  # i is multiplied in two halves, so that no product exceeds a long
#: Slots between two counts of a source's earlier slots.
_SPAN = 1 << 16


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def count_words(texts: pa.Array) -> np.ndarray:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in each text, counted on the bytes of all texts a chunk at a time."""
    data = texts.buffers()[2]
    starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    out = np.zeros(len(texts), np.int64)
    if data is None:
        return out
    letters = np.frombuffer(data, np.uint8)
    for at in range(int(starts[0]), int(starts[-1]), CHUNK):
        end = min(at + CHUNK, int(starts[-1]))
        blank = _BLANK[letters[at:end]]
        first = np.empty(end - at, bool)  # whether a text or a blank stands before
        first[1:] = blank[:-1]
        first[0] = at > 0 and _BLANK[letters[at - 1]]
        begun = starts[(starts >= at) & (starts < end)] - at
        first[begun] = True
        words = np.flatnonzero(first & ~blank) + at
        out += np.diff(np.searchsorted(words, starts))
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, g (the source as a key that sorts null last), size, hash and row number of every document."""
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    rows = docs.select(F.col("doc_id").cast("long"), key.alias("g"), F.xxhash64("doc_id", "text").alias("hash"), F.monotonically_increasing_id().alias("tie"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array(count_words(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sizes], names=["doc_id", "g", "hash", "tie", "size"])

    return rows.mapInArrow(run, "doc_id long, g string, hash long, tie long, size long")


def source_targets(rows: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """g, n, source_size, target, quota (the target in whole words), low and blocks of every source, stored."""
    sums = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")), "mixing-sums")
    placed = range_sorted(sums, ["g"], "mixing-sources", least=1)
    ranked = materialize(running(placed, [], F.lit(1), "rank").withColumn("weight", F.pmod("rank", F.lit(3)) + 1).drop("rank"), "mixing-ranked")
    release(sums, placed)
    cap = epochs * F.col("source_size")
    whole = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total, level, held = whole["s"] or 0, (whole["s"] or 0) / (whole["w"] or 1), -1
    while True:  # each round caps at least one more source, usually most of those to be capped
        above = F.col("weight") * F.lit(level) > cap
        got = ranked.agg(F.count_if(above).alias("k"), F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if got["k"] == held or not got["open"]:
            break
        held, level = got["k"], (total - (got["full"] or 0)) / got["open"]
    target = F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    quota = F.least(F.round(target).cast("long"), cap)
    wanted = ranked.withColumn("target", target).withColumn("quota", quota).withColumn("blocks", F.ceil(F.col("quota") / BLOCK).cast("long"))
    out = materialize(running(wanted, [], F.col("blocks"), "low").drop("part", "pos", "weight"), "mixing-targets")
    release(ranked)
    return out


def point(i: Column) -> Column:
    """i * STEP mod LATTICE."""
    i = F.pmod(i, F.lit(LATTICE))
    half = F.lit(_HALF).cast("long")
    high = F.pmod(F.pmod(F.shiftright(i, 20) * F.lit(STEP), F.lit(LATTICE)) * half, F.lit(LATTICE))
    return F.pmod(high + F.pmod(F.pmod(i, half) * F.lit(STEP), F.lit(LATTICE)), F.lit(LATTICE))


def schedule(sources: DataFrame) -> DataFrame:
    """slot, g and rank of every block to take: rank r is the source's r-th block, slots ascend in the order of the mix."""
    spark = sources.sparkSession
    n = sources.agg(F.sum("blocks")).first()[0] or 0
    points = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    spots = points.select("slot", F.expr(f"cast((cast(u as decimal(15,0)) * cast({n} as decimal(18,0))) div {LATTICE} as bigint)").alias("y")).withColumn("bucket", F.expr(f"y div {BUCKET}"))
    full = sources.filter("blocks > 0").select("g", "low", "blocks", (F.col("low") + F.col("blocks")).alias("high"))
    spread = full.withColumn("bucket", F.explode(F.expr(f"sequence(low div {BUCKET}, (high - 1) div {BUCKET})")))
    met = spots.join(spread, "bucket").filter((F.col("y") >= F.col("low")) & (F.col("y") < F.col("high"))).select("slot", "g", "blocks")
    met = materialize(met.withColumn("pos", F.col("slot")).withColumn("part", F.expr(f"slot div {_SPAN}")), "mixing-met")
    ranked = running(met, ["g"], F.lit(1).cast("long"), "rank")  # a source has at most _SPAN slots in a part
    given = met.groupBy("g").agg(F.count(F.lit(1)).alias("given"))
    short = full.join(given, "g", "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long"))).filter("given < blocks")
    closing = short.withColumn("rank", F.explode(F.expr("sequence(given, blocks - 1)"))).select((F.lit(n) + F.col("low") + F.col("rank")).alias("slot"), "g", "rank")
    return ranked.filter("rank < blocks").select("slot", "g", "rank").unionByName(closing)


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their sources' targets (stored, ``pos`` numbers them), and the mix:
    slot, pos, word (the first in the document) and words taken there."""
    rows = materialize(sized(docs), "mixing-rows")
    sources = source_targets(rows)
    placed = range_sorted(rows, ["g", "hash", "doc_id", "size", "tie"], "mixing-order")
    started = running(placed, ["g"], F.col("size"), "start").select("doc_id", "g", "size", "start", "pos")
    told = materialize(attach(started, sources.drop("low", "blocks"), ["g"], "n", rows.count(), ["pos"]), "mixing-documents")
    slots = schedule(sources)
    release(rows, placed)
    pieces = (
        told.filter("size > 0 and quota > 0")
        .withColumn("epoch", F.explode(F.expr("sequence(0L, (quota - 1) div source_size)")))
        .withColumn("from", F.expr("epoch * source_size + start"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
        .filter(F.col("from") < F.col("to"))
        .withColumn("rank", F.explode(F.expr(f"sequence(from div {BLOCK}, (to - 1) div {BLOCK})")))
        .withColumn("begin", F.greatest(F.col("from"), F.col("rank") * BLOCK))
        .withColumn("words", F.least(F.col("to"), (F.col("rank") + 1) * BLOCK) - F.col("begin"))
        .select("g", "rank", "pos", (F.col("begin") - F.col("from")).alias("word"), "words")
    )
    return told, pieces.join(slots, ["g", "rank"]).select("slot", "pos", "word", "words")


def op12_mixing(docs: DataFrame) -> DataFrame:
    told, mix = mixed(docs)
    taken = mix.groupBy("pos").agg(F.sum("words").alias("taken"))
    return told.join(taken, "pos", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
