"""Embedding behind a protocol, with a deterministic offline default."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


WORD = re.compile("[0-9A-Za-zÀ-ɏ]+")


class Embedder(Protocol):
    """What the engine asks of a model; instances travel to the executors and load there."""

    dimension: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Pieces that are hashed side by side, and the most bytes of one that fits MD5's first block.
_BESIDE, _SHORT = 16_384, 55


def _md5(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of pieces of ``data`` (bytes, 64 more at the end) of at most ``_SHORT`` bytes: one block each, all side by side."""
    blocks = np.lib.stride_tricks.sliding_window_view(data, 64)[starts]
    blocks[np.arange(64) >= lengths[:, None]] = 0
    blocks[np.arange(len(blocks)), lengths] = 0x80
    words = np.ascontiguousarray(blocks.view("<u4").T)
    words[14] = lengths * 8
    a, b, c, d = (np.full(len(blocks), v, np.uint32) for v in _START)
    for k in range(64):
        lot = k // 16
        if lot == 0:
            mixed, at = d ^ (b & (c ^ d)), k
        elif lot == 1:
            mixed, at = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif lot == 2:
            mixed, at = b ^ c ^ d, (3 * k + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * k % 16
        mixed += a
        mixed += words[at]
        mixed += _SINES[k]
        turn = _TURNS[lot, k % 4]
        a, d, c, b = d, c, b, b + ((mixed << turn) | (mixed >> (np.uint32(32) - turn)))
    return a + _START[0], b + _START[1]


def hashed(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place (the MD5's first eight hex digits) and sign (its ninth) of pieces of ``data``."""
    places, signs = np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)
    padded = np.frombuffer(data + bytes(64), np.uint8)
    short = np.flatnonzero(lengths <= _SHORT)
    for k in range(0, len(short), _BESIDE):
        some = short[k : k + _BESIDE]
        first, second = _md5(padded, starts[some], lengths[some])
        places[some], signs[some] = first.byteswap(), np.where(second & np.uint32(0x80), -1, 1)
    for k in np.flatnonzero(lengths > _SHORT):
        h = hashlib.md5(data[starts[k] : starts[k] + lengths[k]], usedforsecurity=False).digest()
        places[k], signs[k] = int.from_bytes(h[:4], "big"), -1 if h[4] & 0x80 else 1
    return places, signs


class HashingEmbedder:
    """Signed feature hashing of words and word pairs, L2-normalised: no model file, same everywhere.

    Words are runs of Latin letters and digits. A feature's MD5 gives its place (first eight
    hex digits) and its sign (the ninth), so any engine can compute the same vector.
    """

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        found = [WORD.findall(text) for text in texts]
        words = [w.encode() for own in found for w in own]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts, row = np.cumsum(sizes + 1) - sizes - 1, np.repeat(np.arange(len(found)), [len(own) for own in found])
        pairs = np.flatnonzero(row[1:] == row[:-1])  # joined by a space, words and pairs are pieces of one text
        begins, lengths = np.concatenate([starts, starts[pairs]]), np.concatenate([sizes, sizes[pairs] + 1 + sizes[pairs + 1]])
        places, signs = hashed(b" ".join(words), begins, lengths)
        cells = np.concatenate([row, row[pairs]]) * self.dimension + places % self.dimension
        out = np.bincount(cells, signs, len(found) * self.dimension).reshape(len(found), self.dimension)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=np.zeros(out.shape), where=length > 0).astype(np.float32)


def embed_column(docs: DataFrame, text: str, embedder: Embedder, into: str = "embedding", sub_batch: int = 64) -> DataFrame:
    """Add embeddings, computed partition by partition in Arrow batches."""
    def run(texts: pd.Series) -> pd.Series:
        values = list(texts)
        parts = [embedder.embed(values[k : k + sub_batch]) for k in range(0, len(values), sub_batch)]
        return pd.Series([row for part in parts for row in part])

    return docs.withColumn(into, F.pandas_udf(run, "array<float>")(F.coalesce(F.col(text), F.lit(""))))


@lru_cache(maxsize=1024)
def _query(embedder: Embedder, question: str) -> tuple[float, ...]:
    return tuple(float(x) for x in embedder.embed([question])[0])


def embed_question(embedder: Embedder, question: str) -> list[float]:
    """One question's vector, lower-cased and collapsed first, remembered on the driver."""
    return list(_query(embedder, " ".join(question.strip().lower().split())))
