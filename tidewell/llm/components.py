"""Connected components of a table of edges, by tree contraction.

Each round points every node at its smallest neighbour. These pointers form trees, whose
roots are found by pointer jumping: a jump doubles the length of every pointer, so a tree of
depth d takes log2(d) jumps, a chain of a thousand edges ten. Edges between trees then
become edges between their roots, of which there are at most half as many as nodes, and the
next round goes on with these. Both loops are logarithmic; every table is stored, and each
join is one in which a hub may have a third of all edges.

Edge cases. Loops (a = b) and repeated edges are left out; no edges in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.skew import attach_counted
from tidewell.storage import materialize, release


def _roots(pointers: DataFrame, label: str) -> DataFrame:
    """(node, root) of a forest given as stored (node, root = parent), which is released; stored."""
    while True:
        onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        jumped = attach_counted(pointers, onward, "root")
        if jumped.filter("onward <> root").isEmpty():
            return pointers
        after = materialize(jumped.select("node", F.coalesce("onward", "root").alias("root")), label)
        release(pointers)
        pointers = after


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node with an edge, stored: root is the smallest node of its component."""
    left = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    levels = []
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        pointers = materialize(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")), label)
        levels.append(_roots(pointers, label))
        ends = left
        for end in ("a", "b"):
            ends = attach_counted(ends, levels[-1].select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end)
        between = ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        if between.isEmpty():
            release(left)
            break
        after = materialize(between.distinct(), label)
        release(left)
        left = after
    found = levels.pop()
    while levels:  # from the last round back to the first: each is at least twice as large
        lower = levels.pop()
        onward = found.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        whole = materialize(attach_counted(lower, onward, "root").select("node", F.coalesce("onward", "root").alias("root")), label)
        release(lower, found)
        found = whole
    return found
