"""A Merkle manifest of a dataset, with a proof for every row.

Rows of a group are leaves in ascending order; every ``FANOUT`` consecutive nodes become
one until a single node, the group's subroot, remains, and the subroots of all groups, in
order, are the leaves of one more tree. A node's coordinate is (group, level, index).

Leaves are range-sorted and the sorted stretches are stored, so that partitions and places
stay the same in every pass, whatever executors are lost; a group's earlier stretches are
counted by (group, stretch), which tells every leaf its index. Each stretch builds, for each
group it holds, all runs that lie in it whole, level upon level. What is left are the ragged
nodes at its ends, at most 2 * (``FANOUT`` - 1) a level; they are shuffled by the coordinate
of their parent, and rounds over these few nodes finish the upper levels. Paths then go down
the same rounds, each stretch receives those of its own ragged nodes, and its leaves get
theirs by going down the runs it builds again. Only digests are sorted and shuffled, never
texts; no table of nodes reaches the driver, and a group with a third of all rows is cut as
any other.

A digest is lower-case hexadecimal SHA-256. A leaf hashes the row's fields one after the
other: ``-`` for null, otherwise the number of UTF-8 bytes, ``:`` and the value, integers in
decimal; a node hashes the text of its children's digests.

Edge cases. Null groups are one group, the first; an empty name is another. Null ids come
first in their group. Rows with equal ids are ordered by their leaves, and equal rows, which
have equal leaves, any way. A lone leaf is its group's subroot and a lone subroot the root;
the proof of a row without siblings hashes the empty text. Rows without an id are never
tampered with. Very long texts are hashed by the engine where they lie. Other columns are
ignored. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.ordered import offsets, range_sorted
from tidewell.storage import materialize, release

FANOUT = 8
_BITS = 3
#: Levels that one round over the ragged nodes finishes.
ROUND = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_KINDS = {"part": pa.int32(), "g": pa.string(), "level": pa.int32(), "idx": pa.int64(), "total": pa.int64(), "digest": pa.string(), "base": pa.int32(), "key": pa.int64(), "left": pa.string(), "right": pa.string(), "path": pa.list_(_STEP)}
_NODE = ("part", "g", "level", "idx", "total", "digest")
_CLIMBED = (*_NODE, "base", "key", "left", "right")
_PLACED = ("part", "g", "level", "idx", "path")
_PATH = "array<struct<left:string,right:string>>"


def _arrow(names: Sequence[str]) -> pa.Schema:
    return pa.schema([(n, _KINDS[n]) for n in names])


def _ddl(names: Sequence[str]) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.list_(_STEP): _PATH}
    return ", ".join(f"{n} {kinds[_KINDS[n]]}" for n in names)


def field(column: Column) -> Column:
    """``-`` for null, otherwise byte count, colon and value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _is_root() -> Column:
    """Whether a node is its tree's only one at its level: the tree has at most FANOUT ** level leaves."""
    return F.col("total") <= F.expr(f"shiftleft(1L, {_BITS} * level)")


def _width(total: int, level: int) -> int:
    """Nodes at a level of a tree of ``total`` leaves."""
    for _ in range(level):
        total = -(-total // FANOUT)
    return total


class Stretch:
    """The consecutive leaves of one group in one partition, from index ``start`` of ``total``."""

    def __init__(self, leaves: list[str], start: int, total: int):
        self.levels: list[tuple[int, list[str]]] = []  # (index of the first, digests), by level
        self.ragged: list[tuple[int, int]] = []  # (level, index) of nodes whose run is not whole here
        nodes, width = leaves, total
        while nodes:
            level = len(self.levels)
            self.levels.append((start, nodes))
            end = start + len(nodes)
            if width == 1:
                self.ragged.append((level, 0))  # the subroot
                return
            first = min(-(-start // FANOUT) * FANOUT, end)
            last = end if end == width else max(end // FANOUT * FANOUT, first)
            self.ragged += [(level, k) for k in (*range(start, first), *range(last, end))]
            nodes = [_digest("".join(nodes[k - start : min(k + FANOUT, last) - start])) for k in range(first, last, FANOUT)]
            start, width = first // FANOUT, -(-width // FANOUT)

    def digest(self, level: int, index: int) -> str:
        start, nodes = self.levels[level]
        return nodes[index - start]

    def leaves_below(self, level: int, index: int, path: tuple) -> Iterator[tuple[int, tuple]]:
        """(place here, path) of every leaf below a node; a path is (left, right, path of the parent)."""
        if level == 0:
            yield index - self.levels[0][0], path
            return
        start, nodes = self.levels[level - 1]
        run = nodes[index * FANOUT - start : (index + 1) * FANOUT - start]
        for k in range(len(run)):
            below = ("".join(run[:k]), "".join(run[k + 1 :]), path)
            yield from self.leaves_below(level - 1, index * FANOUT + k, below)


def _stretches(rows: pa.Table, counts: dict[str, tuple[int, int]]) -> Iterator[tuple[str, int, Stretch]]:
    """(group, place of its first row, stretch) of the sorted rows of a partition."""
    groups, leaves = rows.column("g").to_pylist(), rows.column("leaf").to_pylist()
    at = 0
    while at < len(groups):
        end = at
        while end < len(groups) and groups[end] == groups[at]:
            end += 1
        yield groups[at], at, Stretch(leaves[at:end], *counts[groups[at]])
        at = end


def _ragged(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """part, g, level, idx, total, digest of the nodes that a stretch cannot combine by itself, subroots included."""

    def build(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        known = {r["g"]: (r["offset"], r["total"]) for r in told.to_pylist()}
        part = told.column("part")[0].as_py()
        out = []
        for g, _, stretch in _stretches(rows, known):
            out += [{"part": part, "g": g, "level": level, "idx": k, "total": known[g][1], "digest": stretch.digest(level, k)} for level, k in stretch.ragged]
        return pa.Table.from_pylist(out, schema=_arrow(_NODE))

    return placed.select("part", "pos", "g", "leaf").groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(build, _ddl(_NODE))


def _climb(nodes: pa.Table) -> pa.Table:
    """The ragged nodes below one coordinate, with their siblings, and what follows above them.

    ``nodes`` holds all nodes of levels base to base + ``ROUND`` - 1 that no stretch could
    combine. Runs are combined level by level; the apex, at level base + ``ROUND`` or the
    group's subroot, comes without siblings.
    """
    rows = nodes.to_pylist()
    g, total, base, key = rows[0]["g"], rows[0]["total"], rows[0]["base"], rows[0]["key"]
    out = []
    held: dict[int, list[dict]] = defaultdict(list)
    for r in rows:
        held[r["level"]].append(r)
    for level in range(base, base + ROUND + 1):
        here = sorted(held[level], key=lambda r: r["idx"])
        if level == base + ROUND or _width(total, level) == 1:
            out += [r | {"left": None, "right": None} for r in here]
            break
        runs: dict[int, list[dict]] = defaultdict(list)
        for r in here:
            runs[r["idx"] // FANOUT].append(r)
        for run, members in runs.items():
            digests = [r["digest"] for r in members]
            out += [r | {"left": "".join(digests[:k]), "right": "".join(digests[k + 1 :])} for k, r in enumerate(members)]
            held[level + 1].append({"part": None, "g": g, "level": level + 1, "idx": run, "total": total, "digest": _digest("".join(digests)), "base": base, "key": key})
    return pa.Table.from_pylist(out, schema=_arrow(_CLIMBED))


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes of one round with their paths; ``above`` has the path of its apex."""
    apex = above.to_pylist()
    path = apex[0]["path"]
    known: dict[tuple[int, int], list] = {}
    out = []
    for r in sorted(nodes.to_pylist(), key=lambda r: -r["level"]):
        own = path if r["left"] is None else [{"left": r["left"], "right": r["right"]}, *known[r["level"] + 1, r["idx"] // FANOUT]]
        known[r["level"], r["idx"]] = own
        out.append({"part": r["part"], "g": r["g"], "level": r["level"], "idx": r["idx"], "path": own})
    return pa.Table.from_pylist(out, schema=_arrow(_PLACED))


class Forest:
    """The trees of all groups over range-sorted leaves: ``placed`` has g, part, pos and leaf."""

    def __init__(self, placed: DataFrame, label: str):
        self.placed, self.label = placed, label
        self.counts = offsets(placed, ["g"], F.lit(1).cast("long")).toDF("g", "part", "offset", "total")  # columns of its own, as cogroup asks
        self.ragged = materialize(_ragged(placed, self.counts), f"{label}-ragged")
        open_ = self.ragged.filter(~_is_root())
        top = open_.agg(F.max("total")).first()[0] or 0
        self.rounds: list[DataFrame] = []  # nodes of ROUND levels with their siblings, and the apexes above
        below = None
        base = 0
        while base == 0 or _width(top, base) > 1:
            if not top:
                break
            nodes = open_.filter(F.col("level").between(base, base + ROUND - 1)).select(*_NODE)
            nodes = nodes.unionByName(below) if below is not None else nodes
            keyed = nodes.withColumn("base", F.lit(base)).withColumn("key", F.expr(f"shiftright(idx, {_BITS} * ({base + ROUND} - level))"))
            self.rounds.append(materialize(keyed.groupBy("g", "key").applyInArrow(_climb, _ddl(_CLIMBED)), f"{label}-round"))
            base += ROUND
            below = self.rounds[-1].filter((F.col("level") == base) & ~_is_root()).select(*_NODE)
        whole = self.ragged.filter(_is_root()).select("g", "digest")
        for r in self.rounds:
            whole = whole.unionByName(r.filter(_is_root()).select("g", "digest"))
        self.subroots = whole

    def paths(self, base: DataFrame) -> DataFrame:
        """part, g, level, idx and path of the ragged nodes; ``base`` has the path of each group's subroot."""
        out = self.ragged.filter(_is_root()).join(base, "g").select("part", "g", "level", "idx", "path")
        above = None  # g, key and path of the apexes of a round
        for nodes in reversed(self.rounds):
            apexes = nodes.filter(_is_root()).join(base, "g").select("g", "key", "path")
            if above is not None:
                apexes = apexes.unionByName(above.select("g", F.col("idx").alias("key"), "path"))
            found = nodes.groupBy("g", "key").cogroup(apexes.toDF("g", "key", "path").groupBy("g", "key")).applyInArrow(_descend, _ddl(_PLACED))
            found = materialize(found, f"{self.label}-paths")
            out = out.unionByName(found.filter("part is not null"))
            first = nodes.first()["base"]
            above = found.filter(F.col("part").isNull() & (F.col("level") == first))
        return out


def _with_paths(rows: pa.Table, told: pa.Table) -> Iterator[tuple[int, tuple]]:
    """(place, path) of all leaves of a partition; ``told`` has counts (level -1) and paths of ragged nodes."""
    known, paths = {}, defaultdict(list)
    for r in told.to_pylist():
        if r["level"] < 0:
            known[r["g"]] = (r["idx"], r["total"])
        else:
            path = ()
            for step in reversed(r["path"]):
                path = (step["left"], step["right"], path)
            paths[r["g"]].append((r["level"], r["idx"], path))
    for g, at, stretch in _stretches(rows, known):
        for level, index, path in paths[g]:
            for place, own in stretch.leaves_below(level, index, path):
                yield at + place, own


def _steps(path: tuple) -> Iterator[tuple[str, str]]:
    while path:
        yield path[0], path[1]
        path = path[2]


def _told(forest: Forest, base: DataFrame) -> DataFrame:
    """What a partition has to know: the place of each of its groups (level -1, with the columns of ``base``), the paths of its ragged nodes."""
    counts = forest.counts.join(base.drop("path"), "g").withColumns({"level": F.lit(-1), "path": F.lit(None).cast(_PATH)}).withColumnRenamed("offset", "idx")
    return counts.unionByName(forest.paths(base.select("g", "path")), allowMissingColumns=True)


def with_paths(forest: Forest, base: DataFrame) -> DataFrame:
    """Every leaf with its path: siblings to its left and right, from the leaf up to the root."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        found: list = [None] * rows.num_rows
        for place, path in _with_paths(rows, told):
            found[place] = [{"left": a, "right": b} for a, b in _steps(path)]
        return rows.drop_columns(["part"]).append_column("path", pa.array(found, _KINDS["path"]))

    columns = [c for c in forest.placed.columns if c != "part"]
    schema = ", ".join(f"{c} {forest.placed.schema[c].dataType.simpleString()}" for c in columns)
    return forest.placed.select(*columns, "part").groupBy("part").cogroup(_told(forest, base).groupBy("part")).applyInArrow(run, f"{schema}, path {_PATH}")


def folded(start: str, path: tuple) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in _steps(path):
        start = _digest(left + start + right)
    return start


def _proofs(forest: Forest, base: DataFrame, root: str) -> DataFrame:
    """The result for every row; ``base`` has path and subroot of each group."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        leaves, changed, groups = (rows.column(c).to_pylist() for c in ("leaf", "changed", "g"))
        subroots = {r["g"]: r["subroot"] for r in told.select(["g", "level", "subroot"]).to_pylist() if r["level"] < 0}
        proofs: list = [None] * rows.num_rows
        roots: list = [None] * rows.num_rows
        last, text = None, ""  # the leaves of a run share the path above it, whose text is joined once
        for place, path in _with_paths(rows, told):
            above = path[2] if path else ()
            if above is not last:
                last, text = above, "".join(a + b for a, b in _steps(above))
            proofs[place] = _digest((path[0] + path[1] if path else "") + text)
            roots[place] = folded(changed[place] or leaves[place], path)
        n = rows.num_rows
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "leaf": rows.column("leaf"),
                "subroot": pa.array([subroots[g] for g in groups], pa.string()),
                "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(roots, pa.string()),
                "verified": pa.array([r == root for r in roots], pa.bool_()),
            }
        )

    placed = forest.placed.select("part", "pos", "g", "doc_id", "leaf", "changed")
    return placed.groupBy("part").cogroup(_told(forest, base).groupBy("part")).applyInArrow(run, RESULT)


def group_key(lang: Column) -> Column:
    """A group as a string that is never null and sorts null first."""
    return F.coalesce(F.concat(F.lit("1"), lang), F.lit("0"))


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, g, leaf, changed (the leaf of the tampered row, else null) of every document."""
    doc_id = F.col("doc_id").cast("long")
    own = [doc_id if c == "doc_id" else F.col(c) for c in FIELDS]
    other = [lowered(F.col("text")) if c == "text" else f for c, f in zip(FIELDS, own)]
    tampered = F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 0
    return docs.select(doc_id.alias("doc_id"), group_key(F.col("lang")).alias("g"), leaf(own).alias("leaf"), F.when(tampered, leaf(other)).alias("changed"))


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proofs of all documents, the subroots: of, the group as a key, and leaf, its digest, with the path to the root)."""
    rows = materialize(hashed(docs).withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    placed = range_sorted(rows, ["g", "doc_id", "leaf", "tie"], "merkle-sorted")
    release(rows)
    trees = Forest(placed, "merkle")
    # the subroots are the leaves of one more tree, built the same way
    subroots = trees.subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("digest").alias("leaf"))
    top = Forest(range_sorted(subroots, ["g", "of"], "merkle-groups", least=1), "merkle-top")
    root = top.subroots.first()
    if root is None:
        spark = docs.sparkSession
        return spark.createDataFrame([], RESULT), spark.createDataFrame([], f"of string, leaf string, path {_PATH}")
    empty = F.array().cast(_PATH)
    known = materialize(with_paths(top, top.subroots.select("g", empty.alias("path"))).select("of", "leaf", "path"), "merkle-subroots")
    return _proofs(trees, known.select(F.col("of").alias("g"), F.col("leaf").alias("subroot"), "path"), root["digest"]), known


def op13_manifest(docs: DataFrame) -> DataFrame:
    return manifest(docs)[0]
