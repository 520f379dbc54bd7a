"""Near copies by the Jaccard similarity of word shingles.

A text's shingles are runs of ``SHINGLE`` words, ASCII case and white space folded as for
fingerprints; a shorter text is one shingle, a text without words has none. Texts of equal
shingle sets are one *node*. Two searches propose which nodes to compare: the anchors of
:mod:`tidewell.llm.simhash`, which find fingerprints within two bits for certain, and
MinHash bands for what lies beyond, since fingerprints at the threshold differ in about ten
of 64 bits, too many for any covering. A pair at similarity s shares a bucket but for a
chance of (1 - s**ROWS)**BANDS: 6e-5 at 0.8, less above.

What is proposed is compared by whole shingle sets, without ever listing the pairs of a
group. A shingle that no other proposed node holds cannot be shared, so a node with more
than a fifth of such shingles has no near copy and is dropped; this empties the buckets that
a common passage fills. The rest falls into coarse groups, connected by buckets and anchors.
A group is compared in one task through an inverted index, from its most ordinary member
outwards: nodes already linked are not compared again, and sizes and shared shingles at
most tell most others apart before the index is asked. A group of more than ``BLOCK``
shingles or ``NODES`` nodes is dealt over several tasks, each with a block of it, which all
its members pass. Only a spanning forest of the links leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.skew import attach, attach_counted, small
from tidewell.storage import hold, materialize, release, sliced

SHINGLE = 5
#: Similarity from which texts are near copies, as a fraction so that the comparison is exact.
THRESHOLD = (4, 5)
BANDS, ROWS = 32, 6
SEED = 42
#: Shingles, and nodes, that a task holds of a group at a time, about.
BLOCK, NODES = 4_000_000, 20_000
#: Shingles permuted at a time.
_SLICE = 2048
_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of one whole text's shingles, repeats included, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space is \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    at = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest, width = xxhash.xxh64_digest, min(shingle, len(words))
    return np.frombuffer(b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(at, at[width:])]), ">u8").astype(np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of one whole text's shingles."""
    return np.unique(shingle_hashes(text))


def bands_of(shingles: np.ndarray) -> list[int]:
    """A bucket for each band; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for low in range(0, len(shingles), _SLICE):
        np.minimum(least, ((shingles[low : low + _SLICE] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return [np.int64(xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63)) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def sketch(text: Column, majority) -> Column:
    """struct(node, n, fp, bands): texts of equal shingle sets have the same ``node``; ``n`` is the size of the set, ``fp`` the fingerprint by ``majority``."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t)
            distinct = np.unique(hashes)
            rows.append((xxhash.xxh64_intdigest(distinct.tobytes(), SEED) - (1 << 63), len(distinct), np.uint64(majority(hashes)).astype(np.int64), bands_of(distinct)))
        return pd.DataFrame(rows, columns=["node", "n", "fp", "bands"])

    return F.pandas_udf(run, "node long, n int, fp long, bands array<long>")(F.coalesce(text, F.lit("")))


def _shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).view(np.int64) for t in texts])


def shingles_of(text: Column) -> Column:
    return F.pandas_udf(_shingles, "array<long>")(F.coalesce(text, F.lit("")))


class Index:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        keys = np.concatenate(sets)
        order = np.argsort(keys, kind="stable")
        self.size = len(sets)
        self.keys = keys[order]
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]

    def shared(self, query: np.ndarray) -> np.ndarray:
        """How many shingles of ``query`` each set holds."""
        low, high = np.searchsorted(self.keys, query, "left"), np.searchsorted(self.keys, query, "right")
        count = high - low
        place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.owner[place], minlength=self.size)

    def alone(self) -> np.ndarray:
        """How many shingles of each set no other set holds."""
        first = np.r_[True, self.keys[1:] != self.keys[:-1]] if len(self.keys) else np.zeros(0, bool)
        once = first & np.r_[first[1:], True] if len(first) else first
        return np.bincount(self.owner[once], minlength=self.size)


def _may(n: np.ndarray, c: np.ndarray, size: int, core: int) -> np.ndarray:
    """Sets of ``n`` shingles, ``c`` of which can be shared, that may reach the threshold with one of ``size`` and ``core``."""
    over, under = THRESHOLD
    return (np.minimum(c, core) * (over + under) >= (n + size) * over) & (np.minimum(n, size) * under >= np.maximum(n, size) * over)


def _similar(shared: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    over, under = THRESHOLD
    return shared * (over + under) >= (n + size) * over


def forest(sets: list[np.ndarray], core: np.ndarray, index: Index | None = None) -> np.ndarray:
    """For each set the first one that similar sets connect it to."""
    n = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root
    index = index or Index(sets)
    order = np.argsort(-core / np.maximum(n, 1), kind="stable")  # the most ordinary first: it links the most
    place = np.empty(len(sets), np.int64)
    place[order] = np.arange(len(sets))
    for k in order:
        open_ = (place > place[k]) & (root != root[k]) & _may(n, core, n[k], core[k])
        if open_.any():
            near = open_ & _similar(index.shared(sets[k]), n, n[k])
            if near.any():
                merged = np.unique(np.r_[root[near], root[k]])
                root[np.isin(root, merged)] = merged[0]
    return root


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each (root, block): rows come in this order, those of the block itself first."""
    key, held, index, links = None, [], None, []

    def block() -> tuple[Index, np.ndarray]:
        return Index([s for *_, s in held]), np.array([c for _, c, _ in held], np.int64)

    def within(index: Index, core: np.ndarray) -> list[tuple[int, int]]:
        root = forest([s for *_, s in held], core, index)
        return [(held[k][0], held[r][0]) for k, r in enumerate(root) if k != r]

    def done() -> list[tuple[int, int]]:
        if index is None and len(held) > 1:  # nothing but the block: what only one of it holds cannot be shared
            found, core = block()
            return within(found, np.minimum(core, np.array([len(s) for *_, s in held]) - found.alone()))
        return links

    for batch in sliced(batches):
        for r in batch.itertuples(index=False):
            if key != (r.root, r.block):
                if key is not None and (out := done()):
                    yield pd.DataFrame(out, columns=["a", "b"])
                key, held, index, links = (r.root, r.block), [], None, []
            shingles = np.asarray(r.shingles, np.int64)
            if r.own:
                held.append((r.node, r.core, shingles))
                continue
            if not held:
                continue
            if index is None:
                index, core = block()
                sizes, links = np.array([len(s) for *_, s in held]), within(index, core)
            may = _may(sizes, core, len(shingles), r.core)
            if may.any():
                near = np.flatnonzero(may & _similar(index.shared(shingles), sizes, len(shingles)))
                links += [(r.node, held[k][0]) for k in near[:1]] + [(held[near[0]][0], held[k][0]) for k in near[1:]]
                if len(links) > 4 * len(held) + 100_000:
                    yield pd.DataFrame(links, columns=["a", "b"])
                    links = []
    if key is not None and (out := done()):
        yield pd.DataFrame(out, columns=["a", "b"])


def bucket_members(each: DataFrame) -> DataFrame:
    """(band, node) of every MinHash bucket with two nodes at least; stored. ``each`` is stored with one row a node."""
    rows = each.select("node", F.explode("bands").alias("band"))
    buckets = hold(rows.groupBy("band").agg(F.count(F.lit(1)).alias("weight")).filter("weight > 1").withColumn("met", F.lit(True)))
    out = materialize(attach(rows, buckets, ["band"], "weight", BANDS * each.count()).filter("met").select("band", "node"), "jaccard-members")
    release(buckets)
    return out


def _stars(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of each node with the smallest of its bucket, and what they are read from; ``members`` is held (band, node)."""
    buckets = hold(members.groupBy("band").agg(F.count(F.lit(1)).alias("weight"), F.min("node").alias("a")).filter("weight > 1"))
    return attach(members, buckets, ["band"], "weight", members.count()).filter("a < node").select("a", F.col("node").alias("b")), buckets


def near_copy_roots(each: DataFrame, texts: DataFrame, proposed: DataFrame) -> DataFrame:
    """(node, root) of every node with a near copy; stored.

    ``each`` is stored with one row a node: node, row, bands. ``texts`` is stored (row,
    text), and ``proposed`` stored edges (a, b) between nodes to compare beyond the buckets.
    """
    members = bucket_members(each)
    ends = members.select("node").unionByName(proposed.select(F.col("a").alias("node"))).unionByName(proposed.select(F.col("b").alias("node"))).distinct()
    met = hold(each.select("node", "row").join(ends, "node", "left_semi").select("node", F.col("row").alias("__row")))
    sets = materialize(texts.join(small(met), texts["row"] == F.col("__row")).select("node", shingles_of(F.col("text")).alias("shingles")), "jaccard-sets")
    release(met)
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    over, under = THRESHOLD
    core = sets.select("node", F.size("shingles").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("core"))
    open_ = materialize(core.filter(F.col("core").cast("long") * under >= F.col("n").cast("long") * over), "jaccard-open")
    still = hold(members.join(small(open_.select("node")), "node", "left_semi").select("band", "node"))
    stars, buckets = _stars(still)
    both = small(open_.select(F.col("node").alias("__open")))
    anchored = proposed.join(both, proposed["a"] == F.col("__open"), "left_semi")
    anchored = anchored.join(both, anchored["b"] == F.col("__open"), "left_semi")
    coarse = components(stars.unionByName(anchored), "jaccard-coarse")
    sized = hold(coarse.join(open_, "node").select("node", "root", "n", "core"))
    blocks = hold(sized.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK), F.count(F.lit(1)) / F.lit(NODES))).cast("int").alias("blocks")))
    placed = attach_counted(sized, blocks, "root").select(F.col("node").alias("__node"), "root", "core", "blocks")
    dealt = sets.join(placed, sets["node"] == F.col("__node")).select("root", "node", "core", "shingles", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    ready = dealt.select("root", "block", (F.col("home") == F.col("block")).alias("own"), "node", F.col("core").cast("long").alias("core"), "shingles")
    compared = ready.repartition("root", "block").sortWithinPartitions("root", "block", F.col("own").desc())
    roots = components(compared.mapInPandas(_compare, "a long, b long"), "jaccard-roots")
    release(members, sets, open_, still, buckets, coarse, sized, blocks)
    return roots
