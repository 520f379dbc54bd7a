"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Fingerprints that differ in at most ``distance`` bits are linked, and a
document's component is the smallest ``doc_id`` that links can reach.

Anchors. Two fingerprints that differ in 2 bits differ in at most 1 bit within one of
their 32-bit halves, so each half is covered by a code of its own: the words of the
perfect [31,26] Hamming code on 31 bits, times both values of the last bit. Its covering
radius is 1: every half has exactly one *home* anchor. If x and y differ in at most t bits
within a half, y lies within 1 + t of x's home. Each fingerprint is therefore replicated to
its homes and, as a *probe*, to every anchor within radius plus threshold, and comparing
probes with homes anchor by anchor finds every link. The 2**27 anchors of a half keep
groups small: what meets at an anchor agrees in all but a few bits of the half.

Equal fingerprints are folded together before anything is replicated, so copies cost
nothing. Within an anchor, links are reduced at once to a spanning forest, so what is
emitted is linear in the group; a run too long for pairwise comparison is linked through
the one-bit neighbours its members share, which is exact and linear too. An anchor crowded
with a thousandth of all fingerprints is taken apart: its members meet at their one-bit
neighbours instead, over all tasks.

Components come from tree contraction (:mod:`tidewell.llm.components`) on tables in the
shared folder; nothing is collected to the driver but row counts.

Edge cases. Null and empty texts, and texts of white space alone, have fingerprint 0 and
link like others. Repeated rows are kept: each gets the component of its fingerprint. A
null ``doc_id`` is carried but never names a component unless all ids reachable are null.
Very long texts are hashed whole. A bit set in exactly half the hashes is not set. Columns
of the input beyond ``doc_id`` and ``text`` are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import jaccard
from tidewell.llm.components import components
from tidewell.skew import attach, attach_counted, without
from tidewell.storage import hold, materialize, release, sliced

#: Shingles whose hash bits are unpacked at a time.
_SLICE = 1 << 16
#: Runs up to this length are compared pair by pair.
_PAIRWISE = 48
#: One-bit neighbours held at a time for a longer run.
_NEIGHBOURS = 4_000_000
#: An anchor is crowded with so many fingerprints, as a sample of one in so many has it.
CROWD, SAMPLED = 4096, 16


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of some 64-bit hashes."""
    votes = np.zeros(64, np.int64)
    for low in range(0, len(hashes), _SLICE):
        votes += np.unpackbits(hashes[low : low + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit majority fingerprint of one whole text; 0 for a text without words."""
    return majority(jaccard.shingle_hashes(text, shingle))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": _signed([fingerprint(t, shingle) for t in batch["text"]])})

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return slim.mapInPandas(run, "doc_id long, fp long")


def _syndrome_table() -> np.ndarray:
    """For 16-bit pieces of a 31-bit word: the XOR of the (1-based) places of its ones."""
    bits = (np.arange(1 << 16)[:, None] >> np.arange(16)) & 1
    return np.bitwise_xor.reduce(bits * (1 + np.arange(16)), axis=1).astype(np.int64), np.bitwise_xor.reduce(bits * (17 + np.arange(16)), axis=1).astype(np.int64)


_LOW, _HIGH = _syndrome_table()


def home_anchor(half: np.ndarray) -> np.ndarray:
    """The only anchor within 1 of each 32-bit half: the top bit is free, the lower 31 are decoded."""
    s = _LOW[half & 0xFFFF] ^ _HIGH[(half >> 16) & 0x7FFF]
    return np.where(s > 0, half ^ (np.int64(1) << np.maximum(s - 1, 0)), half)


def near_anchors(half: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into half, anchor) of every anchor within ``radius`` <= 2 of each half."""
    places = np.arange(31)
    home = home_anchor(half)
    off = home != half
    top = np.int64(1) << 31
    index, found = [np.arange(len(half))], [home]
    if radius >= 1:  # no coset leader but the home lies within 1 of the lower 31 bits; the free bit may differ where that is exact
        exact = np.flatnonzero(~off) if radius == 1 else np.arange(len(half))
        index.append(exact)
        found.append(home[exact] ^ top)
    if radius >= 2:  # two flips within the 31 bits whose places XOR to the syndrome
        s = _LOW[half & 0xFFFF] ^ _HIGH[(half >> 16) & 0x7FFF]
        who = np.flatnonzero(off)
        for p in places + 1:
            q = s[who] ^ p
            ok = q > p
            index.append(who[ok])
            found.append(half[who[ok]] ^ (np.int64(1) << np.int64(p - 1)) ^ (np.int64(1) << (q[ok] - 1)))
    return np.concatenate(index), np.concatenate(found)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of 0..n-1 by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _weight(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _long_run(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what lies within 2 bits in a run of distinct fingerprints.

    Fingerprints within ``distance`` <= 2 of each other share a fingerprint within 1 of
    both (or one is within 1 of the other), so equal one-bit neighbours link them. For
    ``distance`` 1 a member must itself be the neighbour.
    """
    passes = max(1, -(-len(fp) * 65 // _NEIGHBOURS))
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    a, b = [], []
    for k in range(passes):
        keys, who = [], []
        for flip in flips:
            key = fp.view(np.uint64) ^ flip
            mine = np.flatnonzero((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == k)
            keys.append(key[mine])
            who.append(mine)
        keys, who = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(keys, kind="stable")
        keys, who = keys[order], who[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        if distance < 2:  # the neighbour itself has to be a member: its flip is 0 and it sorts first
            member = keys[first] == fp.view(np.uint64)[who[first]]
            first, size = first[member], size[member]
        head = np.repeat(first, size)
        tail = head + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        a.append(who[head[tail != head]])
        b.append(who[tail[tail != head]])
    return np.concatenate(a), np.concatenate(b)


def _links(anchor: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each anchor; rows are sorted by (anchor, fp)."""
    keep = np.r_[True, (anchor[1:] != anchor[:-1]) | (fp[1:] != fp[:-1])] if len(fp) else np.zeros(0, bool)
    anchor, fp = anchor[keep], fp[keep]
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(fp) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(fp)])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    longest = size[size <= _PAIRWISE].max(initial=1)
    short = np.repeat(size <= _PAIRWISE, size)
    for gap in range(1, longest):
        i = np.flatnonzero((anchor[gap:] == anchor[:-gap]) & short[gap:])
        i = i[_weight(fp[i] ^ fp[i + gap]) <= distance]
        a.append(i)
        b.append(i + gap)
    for s, n in zip(start[size > _PAIRWISE], size[size > _PAIRWISE]):
        x, y = _long_run(fp[s : s + n], distance)
        a.append(x + s)
        b.append(y + s)
    a, b = np.concatenate(a), np.concatenate(b)
    root = _roots(len(fp), a, b)
    child = np.flatnonzero(root != np.arange(len(fp)))
    return fp[child], fp[root[child]]


def _replicated(fps: DataFrame, radius: int) -> DataFrame:
    """(anchor, fp): every fingerprint at every anchor within ``radius`` of either half."""

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch["fp"].to_numpy()
            for low in range(0, len(whole), 20_000):
                fp = whole[low : low + 20_000]
                for side in (0, 1):
                    half = (fp >> (32 * side)) & 0xFFFFFFFF
                    index, anchor = near_anchors(half, radius)
                    yield pd.DataFrame({"anchor": anchor | (np.int64(side) << 32), "fp": fp[index]})

    return fps.select("fp").mapInPandas(replicate, "anchor long, fp long")


def crowded_anchors(distinct: DataFrame, radius: int) -> DataFrame:
    """Anchors that hold many fingerprints, stored: a thousandth of all and ``CROWD`` at least, by a sample of one in ``SAMPLED``.

    A fingerprint is at 70 anchors at most, so there are 70,000 of these at most.
    """
    some = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0)
    n = some.count()
    return materialize(_replicated(some, radius).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") * SAMPLED >= CROWD) & (F.col("n") * 1000 >= n)).select("anchor"), "simhash-crowded")


def neighbour_links(fps: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect what lies within ``distance`` of some fingerprints, by the one-bit neighbours they share.

    At most 65 fingerprints share a neighbour, so no key is hot however close they lie.
    """
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    near = fps.select("fp", F.explode(flips).alias("flip")).select("fp", (F.col("fp").bitwiseXOR(F.col("flip"))).alias("key"))
    held = near.groupBy("key").agg(F.collect_set("fp").alias("fps"))
    centre = F.array_min("fps") if distance == 2 else F.col("key")  # within 1: the neighbour itself has to be one of them
    linked = held.filter(F.size("fps") > 1) if distance == 2 else held.filter((F.size("fps") > 1) & F.array_contains("fps", F.col("key")))
    return linked.select(centre.alias("a"), F.explode("fps").alias("b")).filter("a <> b")


def anchor_links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within ``distance`` <= 2 bits of each other.

    ``distinct`` has one row for each value of ``fp``. What meets at a crowded anchor is
    compared through shared one-bit neighbours instead, which spreads it over all tasks.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the two-half covering holds for distances 0 to 2")
    radius = 1 + distance // 2
    sent = _replicated(distinct, radius)
    crowded = crowded_anchors(distinct, radius)
    if crowded.isEmpty():
        release(crowded)
        return _met(sent, distance).distinct()
    there = F.broadcast(crowded)
    apart = neighbour_links(sent.join(there, "anchor", "left_semi").select("fp").distinct(), distance)
    return _met(sent.join(there, "anchor", "left_anti"), distance).unionByName(apart).distinct()


def _met(sent: DataFrame, distance: int) -> DataFrame:
    """Links of what meets at each anchor."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_anchor, held_fp = [], []
        for batch in batches:
            anchor, fp = batch["anchor"].to_numpy(), batch["fp"].to_numpy()
            if not len(anchor):
                continue
            last = np.searchsorted(anchor, anchor[-1])  # the last anchor may go on in the next batch
            held_anchor.append(anchor[:last])
            held_fp.append(fp[:last])
            if last:
                a, b = _links(np.concatenate(held_anchor), np.concatenate(held_fp), distance)
                yield pd.DataFrame({"a": a, "b": b})
                held_anchor, held_fp = [], []
            held_anchor.append(anchor[last:])
            held_fp.append(fp[last:])
        if held_fp:
            a, b = _links(np.concatenate(held_anchor), np.concatenate(held_fp), distance)
            yield pd.DataFrame({"a": a, "b": b})

    return sent.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``."""
    prints = materialize(fingerprints(docs, shingle).withColumn("__row", F.monotonically_increasing_id()), "simhash-prints")
    total = prints.count()
    each = materialize(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(anchor_links(each, distance), "simhash-links")
    linked = roots.select(F.col("node").alias("__node"), "root")
    rooted = hold(each.join(linked, each["fp"] == linked["__node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    least = hold(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")).filter("members > 1"))  # others name themselves
    named = attach(rooted, least, ["root"], "members", max(each.count(), 1)).select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    named = materialize(named, "simhash-named")
    release(each, roots, rooted, least)
    return attach(prints, named, ["fp"], "n", total, ["__row"]).drop("__row")


def op4_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 lower-case hex digits, component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component of near copies one row stays, that with the smallest ``doc_id``.

    Near copies have five-word shingles of Jaccard similarity 0.8 at least. Anchors propose
    the texts whose fingerprints over these shingles lie within two bits, MinHash bands what
    lies beyond, and whole shingle sets decide (:mod:`tidewell.llm.jaccard`). A null
    ``doc_id`` comes last. Rows are told apart by a key of their own, so repeated and null
    ids lose no text and keep no copy. Texts are stored once and filtered where they lie:
    everything else is decided on slim rows.
    """
    marked = docs.select("*", F.monotonically_increasing_id().alias("__row"), jaccard.sketch(F.col("text"), majority).alias("__sketch"))
    marked = materialize(marked, "simhash-marked")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col("__row").alias("row"))
    slim = marked.select(F.col("__sketch.node").alias("node"), first.alias("first"), F.col("__sketch.fp").alias("fp"), F.col("__sketch.bands").alias("bands"))
    folded = slim.groupBy("node").agg(F.min(F.struct("first", "fp", "bands")).alias("one"), F.count(F.lit(1)).alias("copies"))
    each = materialize(folded.select("node", "copies", "one.first", F.col("one.first.row").alias("row"), "one.fp", "one.bands"), "simhash-each")
    worded = each.filter(F.size("bands") > 0).select("node", "fp")
    same = hold(worded.groupBy("fp").agg(F.min("node").alias("a")))
    equal = attach_counted(worded, same, "fp").select("a", F.col("node").alias("b")).filter("a <> b")
    names = same.select(F.col("fp").alias("__fp"), F.col("a").alias("__name"))
    near = anchor_links(same.select("fp"))
    near = near.join(names, near["a"] == names["__fp"]).select(F.col("__name").alias("x"), "b")
    near = near.join(names, near["b"] == names["__fp"]).select(F.col("x").alias("a"), F.col("__name").alias("b"))
    proposed = materialize(equal.unionByName(near), "simhash-proposed")
    release(same)
    roots = jaccard.near_copy_roots(each, marked.select(F.col("__row").alias("row"), "text"), proposed)
    linked = roots.select(F.col("node").alias("__node"), "root")
    rooted = hold(each.join(linked, each["node"] == linked["__node"], "left").select("node", "copies", "first", F.coalesce("root", "node").alias("root")))
    stay = hold(rooted.groupBy("root").agg(F.min("first").alias("stay"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    kept = hold(attach(rooted, stay, ["root"], "members", rooted.count()).filter((F.col("copies") > 1) | F.col("stay").isNotNull()).select("node", "copies", F.coalesce("stay.row", "first.row").alias("stay")))
    rows = marked.select("__row", F.col("__sketch.node").alias("node"))
    gone = materialize(attach(rows, kept, ["node"], "copies", marked.count(), ["__row"]).filter(F.col("__row") != F.col("stay")).select("__row"), "simhash-gone")
    release(each, proposed, roots, rooted, stay, kept)
    return without(marked, gone, "__row").select(*[marked[c] for c in docs.columns])
