"""Chat and log views: previous messages, tails, rolling means, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import strip

# Labels of the kinds of answer, and the answer that says there is none.
LABELS = {"vector": "Recherche sémantique", "sql": "Donnée chiffrée", "hybrid": "Recherche hybride", "meta": "Question système"}
NO_ANSWER = "Je ne dispose pas d'informations suffisantes pour répondre à cette question."


def previous_user_message(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each message with the last user message before it."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def tail(messages: DataFrame, n: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each conversation."""
    rank = F.row_number().over(Window.partitionBy(conv).orderBy(F.col(turn).desc()))
    return messages.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def rolling_mean(events: DataFrame, value: str, order: list[str], by: list[str], n: int = 20, slot: Column | None = None, block: int = 100_000) -> DataFrame:
    """Mean of the last n values, the present one included.

    With ``slot``, a column that never falls along ``order`` (an hour, a day), a group is
    cut into blocks of about ``block`` rows: rows are numbered within slots, slots by sums
    of their counts, and the last n - 1 rows of a block are handed on to the next. A group
    with a third of all rows is then as many tasks as it has blocks.
    """
    if slot is None:
        return events.withColumn("rolling", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)))
    slotted = events.withColumn("__slot", slot)
    counts = slotted.groupBy(*by, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__slot")) - F.col("__n")
    at = counts.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__slot").alias("__k_slot"), before.alias("__before"))
    placed = slotted.withColumn("__row", F.row_number().over(Window.partitionBy(*by, "__slot").orderBy(*order)))
    same = [placed[c].eqNullSafe(at[f"__k_{c}"]) for c in by] + [placed["__slot"].eqNullSafe(at["__k_slot"])]
    numbered = placed.join(at, same).withColumn("__at", F.col("__before") + F.col("__row") - 1).select(*events.columns, "__at")
    own = F.floor(F.col("__at") / block)
    homes = F.when(F.pmod("__at", F.lit(block)) > block - n, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = numbered.withColumn("__own", own).withColumn("__block", F.explode(homes))
    rolled = dealt.withColumn("rolling", F.avg(value).over(Window.partitionBy(*by, "__block").orderBy("__at").rowsBetween(1 - n, 0)))
    return rolled.filter(F.col("__block") == F.col("__own")).select(*events.columns, "rolling")


def of_level(logs: DataFrame, level: str, column: str = "type") -> DataFrame:
    """``all``, ``success``, or ``warning-error``, which are two."""
    wanted = {"success": ["success"], "warning-error": ["warning", "error"]}.get(level)
    return logs.filter(F.col(column).isin(wanted)) if wanted else logs


def query_label(kind: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, kind), kind)


def shown_sources(sources: Column, answer: Column, kind: Column) -> Column:
    """The sources of an answer; none where it is empty, an error, or says that there is no answer."""
    plain = strip(F.coalesce(answer, F.lit("")))
    return F.when((plain != "") & (plain != NO_ANSWER) & (F.coalesce(kind, F.lit("")) != "error"), sources)


def bar_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their share of the largest; the largest is one aggregated row, broadcast."""
    top = counts.agg(F.max(n).alias("__max"))
    return counts.join(F.broadcast(top)).withColumn("share", F.try_divide(F.col(n), F.col("__max"))).drop("__max")
