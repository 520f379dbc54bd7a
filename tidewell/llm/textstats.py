"""Statistics of one whole text, shared by the quality operators.

Words are runs of characters other than ``\\x20`` and ``\\x09-\\x0D``; a null text has none.
"""

from __future__ import annotations

from collections.abc import Sequence
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    code = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = code[:n] * _MIX[0]
    for k in range(1, WINDOW):
        mixed = mixed + code[k : n + k] * _MIX[k]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal hashes, so there are none
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    width = 1
    while width < WINDOW:  # ranks of windows of 2, 4, 8 words: exact, by sorting pairs
        pair = rank[: len(rank) - width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The values of FIELDS: n_lines are lines with a word, n_echoes words equal to the one before."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0, 0, 0)
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            seen.add(line)
    return (len(words), chars, sum(map(text.count, SYMBOLS)), lines, lines - len(seen), repeated_words(words), sum(map(text.count, "0123456789")), sum(map(text.count, ".!?")), sum(map(eq, words, words[1:])))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_digits", "n_stops", "n_echoes")


def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in texts], columns=FIELDS)


def with_statistics(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The columns ``carry`` and the statistics of ``text`` for every row."""
    statistics = F.pandas_udf(_statistics, ", ".join(f"{f} long" for f in FIELDS))
    found = docs.select(*carry, statistics(F.coalesce("text", F.lit(""))).alias("__stats"))
    return found.select(*carry, *[F.col(f"__stats.{f}").alias(f) for f in FIELDS])
