"""Keyed state on streams: rolling means, and a cache whose entries expire.

State lives with the stream's checkpoint, partitioned by key; a batch that is replayed after
a failure finds the state as it was before. Both operators sort a key's rows by event time,
hold what the watermark has not passed, and hand rows on in order once it has, so the result
is that of the batch over the same rows whatever order they arrive in, up to rows later than
the watermark allows, which Spark drops. A key's state is one row there; :func:`rolled` keeps
it in tables instead, for keys that hold a large part of all rows. ``flush`` ends a finite stream: a last row per key,
beyond all others, moves the watermark past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators import chatlog
from tidewell.storage import delete

#: Values that a rolling mean looks back on, and seconds that an answer is kept.
LAST, TTL = 20, 3600


def _seconds(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def _passed(rows: list[list], watermark: int) -> tuple[list[list], list[list]]:
    """(rows that the watermark has passed in order of time and id, rows still held)."""
    rows.sort()
    k = next((n for n, r in enumerate(rows) if r[0] > watermark * 1000), len(rows))
    return rows[:k], rows[k:]


def _wait(state: GroupState, held: list[list]) -> None:
    """Wake up again once the watermark may have passed the first held row."""
    if held:
        state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def rolling_means(events: DataFrame, late: str = "0 seconds", n: int = LAST) -> DataFrame:
    """(key, id, ts, rolling) of a stream (key string, id long, ts timestamp, value double): the mean of the last n values of the key, the present one included."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, times, ids, values = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        rows = [list(r) for r in zip(times, ids, values)]
        for batch in batches:
            rows += [list(r) for r in zip(_seconds(batch["ts"]), batch["id"].tolist(), batch["value"].tolist())]
        done, held = _passed(rows, state.getCurrentWatermarkMs())
        out = []
        for at, row_id, value in done:
            before = [*before, value][-n:]
            out.append((key[0], row_id, pd.Timestamp(at, unit="us"), sum(before) / len(before)))
        state.update((before, [r[0] for r in held], [r[1] for r in held], [r[2] for r in held]))
        _wait(state, held)
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "ts", "rolling"])

    kept = "before array<double>, times array<bigint>, ids array<bigint>, vals array<double>"
    keyed = events.withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(run, "key string, id long, ts timestamp, rolling double", kept, "append", GroupStateTimeout.EventTimeTimeout)


def rolled(events: DataFrame, path: str, checkpoint: str, late: str = "0 seconds", n: int = LAST) -> None:
    """:func:`rolling_means` of what there is, for keys of any number of rows, as a Parquet table below ``path``.

    The state is tables beside the checkpoint: rows that the watermark has not passed, and the
    last ``n - 1`` of each key that it has. A batch adds its rows; once some are passed, these
    are rolled by blocks (:func:`chatlog.rolling_mean`), so neither a task nor a state row ever
    holds a key. Every batch writes folders under its number, from those of the batch before:
    one that is replayed writes the same again.
    """
    spark, kept = events.sparkSession, f"{checkpoint}-state"
    micros = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {late})").first()[0]
    at, order = F.unix_micros("ts"), ["ts", "id"]
    marked = "newest bigint, oldest bigint, held array<string>, gone array<string>"

    def step(rows: DataFrame, batch: int) -> None:
        before = spark.read.schema(marked).parquet(f"{kept}/{batch - 1}/mark").first() if batch else None
        held = before["held"] if before else []
        fresh = rows.select("key", "id", "ts", "value", F.lit(False).alias("old"))
        if before and before["newest"] is not None:
            fresh = fresh.filter(at > before["newest"] - micros)
        own = f"{kept}/{batch}/rows"
        fresh.write.mode("overwrite").parquet(own)
        low, high = spark.read.schema(fresh.schema).parquet(own).agg(F.min(at), F.max(at)).first()
        newest, oldest = (of((x for x in pair if x is not None), default=None) for of, pair in ((max, (high, before and before["newest"])), (min, (low, before and before["oldest"]))))
        gone, now = [], [*held, own]
        if oldest is not None and oldest <= newest - micros:
            every = spark.read.schema(fresh.schema).parquet(*now)
            passed, rest = every.filter(F.col("old") | (at <= newest - micros)), every.filter(~F.col("old") & (at > newest - micros))
            means = chatlog.rolling_mean(passed, "value", order, ["key"], n, slot=F.date_trunc("hour", "ts"))
            means.filter(~F.col("old")).select("key", "id", "ts", "rolling").write.mode("overwrite").parquet(f"{path}/batch={batch}")
            last = F.row_number().over(Window.partitionBy("key").orderBy(*[F.col(c).desc() for c in order]))
            tail = passed.withColumn("__last", last).filter(F.col("__last") < n).drop("__last").withColumn("old", F.lit(True))
            rest.unionByName(tail).write.mode("overwrite").parquet(f"{kept}/{batch}/after")
            gone, now = now, [f"{kept}/{batch}/after"]
            oldest = spark.read.schema(fresh.schema).parquet(*now).filter(~F.col("old")).agg(F.min(at)).first()[0]
        spark.createDataFrame([(newest, oldest, now, gone)], marked).write.mode("overwrite").parquet(f"{kept}/{batch}/mark")
        for folder in before["gone"] if before else []:  # no batch that may be replayed reads these
            delete(spark, folder)

    events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cache_hits(asked: DataFrame, late: str = "0 seconds", ttl: int = TTL) -> DataFrame:
    """(key, id, ts, hit) of a stream (key string, id long, ts timestamp) of questions: whether an answer not older than ``ttl`` seconds was there.

    An answer is made where none is, and is ``ttl`` seconds old at most when it is served;
    being served does not renew it. State whose answer has expired goes.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        made, times, ids = (list(x) if k else x for k, x in enumerate(state.get)) if state.exists else (None, [], [])
        rows = [list(r) for r in zip(times, ids)]
        for batch in batches:
            rows += [list(r) for r in zip(_seconds(batch["ts"]), batch["id"].tolist())]
        watermark = state.getCurrentWatermarkMs()
        done, held = _passed(rows, watermark)
        out = []
        for at, row_id in done:
            hit = made is not None and at - made <= ttl * 1_000_000
            made = made if hit else at
            out.append((key[0], row_id, pd.Timestamp(at, unit="us"), hit))
        if made is not None and watermark * 1000 - made > ttl * 1_000_000:
            made = None
        if made is None and not held:
            if state.exists:
                state.remove()
        else:
            state.update((made, [r[0] for r in held], [r[1] for r in held]))
            if held:
                _wait(state, held)
            else:
                state.setTimeoutTimestamp(max(made // 1000 + ttl * 1000 + 1, watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "ts", "hit"])

    keyed = asked.withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(run, "key string, id long, ts timestamp, hit boolean", "made bigint, times array<bigint>, ids array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def flush(rows: DataFrame, ts: str = "ts", after: str = "3650 days") -> DataFrame:
    """One row for each key, later than all of a batch's by ``after``, with a null id; its results are to be left out."""
    last = rows.agg(F.max(ts).alias("__last")).first()["__last"]
    ends = rows.select("key").distinct().withColumn(ts, F.lit(last) + F.expr(f"INTERVAL {after}"))
    return ends.select(*[F.col(c) if c in ends.columns else F.lit(-1 if c == "id" else 0).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


def drained(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Write what there is to a Parquet table and end."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
