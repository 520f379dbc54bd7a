"""Joins that stay even when a third of all rows share one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it holds at least one row in so many; hence there are at most so many hot keys.
HOT_SHARE = 1000
#: Hot rows are dealt over so many salts.
SALTS = 1024
#: Tables of up to so many bytes, once measured, are broadcast whole.
BROADCAST_BYTES = 16 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: fixed columns by eight bytes, others by what they hold."""
    total = F.lit(32)
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(column) + 16
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            size = 8 * F.size(column) + 32
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = 2 * F.octet_length(F.to_json(F.struct(column)))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(8)).cast("long")
    return total


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether a (stored) table is small enough to broadcast: it is measured, not guessed."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if it fits."""
    return F.broadcast(df) if fits(df, most) else df


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int, salt: Sequence[str] = ()) -> DataFrame:
    """Left outer join of ``left`` to ``right``, which has one row for each key.

    ``weight`` is a column of ``right`` with the number of left rows of that key and
    ``total`` their sum. Keys with ``weight * HOT_SHARE >= total`` number ``HOT_SHARE`` at
    most, so they are broadcast; every other key is small and joins by a shuffle in which
    the hot rows take part under a salt drawn from the columns ``salt``, all of ``left`` by
    default. Keys join null-safely. ``weight`` is not part of the result.
    """
    keys = list(keys)
    extra = [c for c in right.columns if c not in (*keys, weight)]
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(max(total, 1))
    hot = right.filter(is_hot).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot"), *[F.col(c).alias(f"__h_{c}") for c in extra])
    rest = right.filter(~is_hot).select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.lit(0).alias("__r_salt"), *[F.col(c).alias(f"__r_{c}") for c in extra])
    on_hot = [left[k].eqNullSafe(hot[f"__h_{k}"]) for k in keys]
    tagged = left.join(F.broadcast(hot), on_hot, "left")
    dealt = F.xxhash64(*(salt or left.columns))
    salted = tagged.withColumn("__salt", F.when(F.col("__hot"), 1 + F.pmod(dealt, F.lit(SALTS)).cast("int")).otherwise(0))
    on_rest = [salted[k].eqNullSafe(rest[f"__r_{k}"]) for k in keys] + [salted["__salt"] == rest["__r_salt"]]
    both = salted.join(rest, on_rest, "left")
    return both.select(*left.columns, *[F.when(F.col("__hot"), F.col(f"__h_{c}")).otherwise(F.col(f"__r_{c}")).alias(c) for c in extra])


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, total: int, salt: Sequence[str] = ()) -> DataFrame:
    """:func:`lookup`, or a plain broadcast if ``right``, once measured, fits."""
    if not fits(right):
        return lookup(left, right, keys, weight, total, salt)
    return _attached(left, right.drop(weight), keys)


def _attached(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left outer join with ``right`` broadcast; keys join null-safely."""
    extra = [c for c in right.columns if c not in keys]
    known = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[F.col(c).alias(f"__r_{c}") for c in extra])
    both = left.join(F.broadcast(known), [left[k].eqNullSafe(known[f"__r_{k}"]) for k in keys], "left")
    return both.select(*left.columns, *[F.col(f"__r_{c}").alias(c) for c in extra])


def attach_counted(left: DataFrame, right: DataFrame, key: str, salt: Sequence[str] = ()) -> DataFrame:
    """:func:`attach` where nothing has counted the keys of ``left`` yet; both are stored tables."""
    if fits(right):
        return _attached(left, right, [key])
    uses = left.groupBy(F.col(key).alias("__used")).agg(F.count(F.lit(1)).alias("__w"))
    weighed = right.join(uses, right[key] == uses["__used"]).drop("__used")
    return lookup(left, weighed, [key], "__w", left.count(), salt)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone`` (stored, one column); rows stay where they lie if that is small."""
    listed = gone.toDF("__gone")
    return rows.join(small(listed), rows[key] == F.col("__gone"), "left_anti")
