"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame operations only.

A document is contaminated by a test item if it holds at least ``THRESHOLD`` of the item's
distinct word shingles. Items are short and documents long, so Jaccard similarity says
nothing; the search is for containment.

Items are partitioned by size: by the length of their shingles (five words, or the whole
item if it has fewer) and by the power of two below their shingle count. An item of n
shingles is sketched by its smallest hashes, n - ceil(THRESHOLD * n) + 1 of them: a
document that misses all of these misses too many, so sharing at least one is necessary and
no contaminated document is lost. A partition has a bound, the largest hash any of its
sketches holds, and a least size, the shingles that its easiest item asks of a document. A
document offers hashes only to partitions whose least size it has, hence only hashes below
the largest bound of these: a document shorter than every item offers none. There is one
scan for each length of shingles, and hashes go from the split words straight into the join.

Candidates are then verified by exact shingle containment on the words themselves. Both the
search and its verdict go by text, so copies are searched like one, and rows without an id
or with a repeated one are judged each by its own text.

The sketch is broadcast if it, once measured, fits; else it joins by a shuffle in which
hashes that many documents offer, by a sample of these, are dealt out. The same holds for
the candidates when they meet the texts. A document offers each hash once to the join, so a
passage in a third of all documents costs a row for each, never pairs of documents.

Words are runs of characters other than ``\\x20`` and ``\\x09-\\x0D``, compared in lower
case. Edge cases. Items without words match nothing, null texts have no words, items that
repeat an id are told apart by their text and reported under the id. Rows without doc_id
are reported without one, and removed like others. Repeated rows are reported once and
removed alike; a document that holds exactly ``THRESHOLD`` of an item is contaminated. Very
long texts are searched whole. Other columns are carried by :func:`remove_contaminated`. An
empty table on either side gives no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import table
from tidewell.skew import attach, attach_counted, fits, lookup, small
from tidewell.storage import materialize, release

SHINGLE = 5
THRESHOLD = 0.8
#: Where a sketch is too large to broadcast, common hashes are told by one text in so many.
SAMPLED = 256


def words_of(text: Column) -> Column:
    """The words of a text in lower case; empty for a null or blank text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingles(words: Column, width: Column) -> Column:
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))).otherwise(F.array().cast("array<string>"))


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that tell texts apart, null being one of its own."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def sketched(items: DataFrame) -> DataFrame:
    """(item_key, item_id, shingles, width, need, part, sketch) for each item with words; stored.

    ``need`` is how many distinct shingles a contaminated document holds at least.
    """
    worded = items.select(F.col("item_id").cast("long"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    wide = worded.withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    listed = wide.withColumn("shingles", F.array_distinct(_shingles(F.col("words"), F.col("width")))).select("item_id", "width", "shingles").distinct()
    n = F.size("shingles")
    codes = None
    for width in range(1, SHINGLE + 1):  # hashed as documents hash them, by words
        hashed = F.transform("shingles", lambda s: F.xxhash64(*[F.element_at(F.split(s, " "), k + 1) for k in range(width)]))
        codes = F.when(F.col("width") == width, hashed) if codes is None else codes.when(F.col("width") == width, hashed)
    sized = listed.withColumn("codes", codes).withColumn("need", F.ceil(n * F.lit(THRESHOLD) - F.lit(1e-9)).cast("int")).withColumn("part", F.floor(F.log2(n)).cast("int"))
    sketch = F.slice(F.array_sort("codes"), F.lit(1), n - F.col("need") + 1)
    return materialize(sized.select(F.xxhash64("item_id", "shingles").alias("item_key"), "item_id", "shingles", "width", "need", "part", sketch.alias("sketch")), "decontaminate-items")


def partitions(items: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """For each width the (least size, bound) of its partitions, at most 5 * 32 in all."""
    rows = items.groupBy("width", "part").agg(F.min("need").alias("least"), F.max(F.element_at("sketch", -1)).alias("bound")).collect()
    out: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(rows, key=lambda r: (r["width"], r["least"])):
        out.setdefault(r["width"], []).append((r["least"], r["bound"]))
    return out


def offered(docs: DataFrame, width: int, parts: list[tuple[int, int]]) -> DataFrame:
    """(t1, t2, held, code): what each text offers to the partitions it is long enough for."""
    held = F.size("words") - (width - 1)
    bound = None
    for k in range(len(parts) - 1, -1, -1):
        most = max(b for _, b in parts[: k + 1])
        bound = F.when(held >= parts[k][0], F.lit(most)) if bound is None else bound.when(held >= parts[k][0], F.lit(most))
    worded = docs.select(*[k.alias(n) for k, n in zip(text_key(F.col("text")), ("t1", "t2"))], words_of(F.col("text")).alias("words")).filter(held >= parts[0][0])
    runs = F.arrays_zip(*[F.slice("words", k + 1, held).alias(f"w{k}") for k in range(width)])
    each = worded.select("t1", "t2", held.alias("held"), bound.alias("bound"), F.inline(runs)).toDF("t1", "t2", "held", "bound", *[f"w{k}" for k in range(width)])
    return each.select("t1", "t2", "held", "bound", F.xxhash64(*[f"w{k}" for k in range(width)]).alias("code")).filter("code <= bound").drop("bound")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """Distinct (t1, t2, item_key) that share a sketched hash; ``items`` is :func:`sketched`."""
    found = None
    for width, parts in partitions(items).items():
        sketch = items.filter(F.col("width") == width).select("item_key", "need", F.explode("sketch").alias("code"))
        sketch = materialize(sketch.groupBy("code").agg(F.collect_set(F.struct("item_key", "need")).alias("items")), "decontaminate-sketch")
        offer = offered(docs, width, parts)
        if fits(sketch):
            met = offer.join(F.broadcast(sketch), "code")
        else:
            some = materialize(offered(docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0), width, parts).groupBy("code").agg(F.count(F.lit(1)).alias("w")), "decontaminate-sample")
            weighed = sketch.join(some, "code", "left").withColumn("w", F.coalesce("w", F.lit(0)))
            total = some.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
            met = lookup(offer, weighed, ["code"], "w", total, ["t1", "t2"]).filter("items IS NOT NULL")
        pairs = met.select("t1", "t2", "held", F.explode("items").alias("i")).filter("held >= i.need").select("t1", "t2", "i.item_key").distinct()
        found = pairs if found is None else found.unionByName(pairs)
    return found


_FOUND = "doc_id long, item_id long, n_shingles int, n_shared int, containment double"


def verified(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, item_id, n_shingles, n_shared) for each row of ``docs`` and each item it holds; stored."""
    items = sketched(benchmark)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    pairs = candidates(texts, items)
    if pairs is None:
        release(items)
        return docs.sparkSession.createDataFrame([], "doc_id long, t1 long, t2 long, item_id long, n_shingles int, n_shared int")
    pairs = materialize(pairs, "decontaminate-pairs")
    wanted = materialize(pairs.groupBy(F.col("t1").alias("t")).agg(F.collect_set("item_key").alias("keys")), "decontaminate-wanted")  # at most the benchmark's items for each
    t1, t2 = text_key(F.col("text"))
    keyed = texts.withColumn("t", t1)
    if fits(wanted):
        shared = keyed.join(F.broadcast(wanted), "t")
    else:
        shared = attach_counted(keyed, wanted, "t").filter("keys IS NOT NULL")
    spaced = F.concat(F.lit(" "), F.array_join(words_of(F.col("text")), " "), F.lit(" "))
    each = shared.select("doc_id", t1.alias("t1"), t2.alias("t2"), spaced.alias("spaced"), F.explode("keys").alias("item_key"))
    uses = pairs.groupBy("item_key").agg(F.count(F.lit(1)).alias("w"))
    asked = materialize(items.select("item_key", "item_id", "shingles", "need").join(uses, "item_key"), "decontaminate-asked")
    met = attach(each, asked, ["item_key"], "w", pairs.count(), ["t1", "t2"])
    held = F.size(F.filter("shingles", lambda s: F.contains(F.col("spaced"), F.concat(F.lit(" "), s, F.lit(" ")))))
    checked = met.select("doc_id", "t1", "t2", "item_id", F.size("shingles").alias("n_shingles"), held.alias("n_shared"), "need").filter("n_shared >= need").drop("need")
    out = materialize(checked, "decontaminate-verified")
    release(items, pairs, wanted, asked)
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for each contaminated document and item."""
    found = verified(docs, benchmark)
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")).distinct()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns.

    A row goes if its text is one that was verified to hold an item. Texts stay where they
    lie unless there are too many such texts to broadcast their keys.
    """
    found = verified(docs, benchmark)
    gone = materialize(found.select(F.col("t1").alias("__g1"), F.col("t2").alias("__g2")).distinct(), "decontaminate-gone")
    t1, t2 = text_key(docs["text"])
    out = docs.join(small(gone), (t1 == F.col("__g1")) & (t2 == F.col("__g2")), "left_anti")
    release(found)
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"
_RUNS = "unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p : p + k - 1], ' ')))"
ORACLE_SQL = f"""
WITH items AS (
  SELECT item_id, w, least(len(w), {SHINGLE}) AS k, row_number() OVER () AS item FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), asked AS (
  SELECT DISTINCT item, item_id, k, {_RUNS} AS s FROM items
), needs AS (
  SELECT item, item_id, k, count(*) AS n, ceil(count(*) * {THRESHOLD} - 1e-9) AS need FROM asked GROUP BY ALL
), texts AS (
  SELECT doc_id, w, row_number() OVER () AS row FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
), held AS (
  SELECT DISTINCT doc_id, row, k, {_RUNS} AS s FROM texts, (SELECT DISTINCT k FROM items) WHERE len(w) >= k
), shared AS (
  SELECT doc_id, row, item, count(*) AS n_shared FROM held JOIN asked USING (k, s) GROUP BY ALL
)
SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id, CAST(item_id AS BIGINT) AS item_id, CAST(n AS INTEGER) AS n_shingles, CAST(n_shared AS INTEGER) AS n_shared, n_shared / CAST(n AS DOUBLE) AS containment
FROM shared JOIN needs USING (item) WHERE n_shared >= need
"""
