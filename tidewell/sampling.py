"""Bounded samples that are the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hashes of ``key``.

    Once counted, rows are thinned by their hash where they lie, so that all tasks together
    hand on little more than ``n`` rows, however many tasks there are.
    """
    total = rows.count()
    code = F.shiftrightunsigned(F.xxhash64(key), 1)
    if total > 2 * n:
        rows = rows.filter(code < F.lit(int((n + 10 * n**0.5) / total * (1 << 63))))
    return rows.orderBy(code, key).limit(n)
