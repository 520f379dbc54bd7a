"""Packing by power-of-two decomposition.

A document of n tokens (its end mark included) is cut into as many full pieces of
``length`` tokens as it holds and then into the binary digits of the rest, longest first.
Every piece is a sequence of its own whose length is a power of two: no sequence crosses
documents and none is padded. Pieces of equal length share a bucket; within its bucket a
sequence has a dense number, so a trainer reads batches of one shape.

Tokenizing is byte-level BPE. Texts are encoded from the vocabulary's rank table, which
gives the ids of the tokenizer file in a fraction of its time; a text that spells a special
token, or hold a run of more than ``LONG_BLANK`` blanks, go through the tokenizer file
itself. Tests hold both against each other.

Numbers. ``sequence_id`` is ``rank * 64 + bucket``, where rank counts a bucket's pieces
from 0 in (salt, doc_id, start) order. The salt is drawn from a piece's document, start,
ids and row number, and ranks are summed in two levels, over salts and within them, so
neither a bucket nor a long document nor the rows without an id meet in one task.

Edge cases. A null text counts as empty; an empty text is its end mark alone. A very long
text is tokenized whole, and only its ids are held beside it. Repeated rows and null ids
are documents like others; ties among equal pieces are broken by their row numbers, which
makes no difference to what is packed. Other columns are ignored by :func:`pack` and carried
by no sequence. No rows in, no rows out.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.storage import materialize, sliced

END_ID = 1
LENGTH = 2048
SALTS = 4096
#: Blanks in a row up to which the rank table encodes; it fails near a million.
LONG_BLANK = 50_000
_BLANKS = re.compile(r"\s+")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or has_long_blank(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return array("I", ids).tobytes()


def has_long_blank(text: str, most: int = LONG_BLANK) -> bool:
    """Whether a text has a run of blanks for which the rank table's pattern would need too deep a stack."""
    return len(text) > most and any(len(run.group()) > most for run in _BLANKS.finditer(text))


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, ranks_path: str) -> Encoder:
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = Encoder(path, ranks_path)
    return _encoders[path, ranks_path]


def binary_pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, size) of the pieces of n tokens: full ones, then the binary digits of the rest."""
    full, rest = divmod(n, length)
    out = [(k * length, length) for k in range(full)]
    at = full * length
    size = length
    while rest:
        size >>= 1
        if rest & size:
            out.append((at, size))
            at += size
            rest -= size
    return out


def tokenized_pieces(docs: DataFrame, path: str, ranks_path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row for each piece, with its ids if asked for."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path, ranks_path)
        for batch in sliced(batches):
            rows, ids = [], []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"]):
                code = encoder.encode(text) + end
                n = len(code) // 4
                for start, size in binary_pieces(n, length):
                    piece = code[4 * start : 4 * (start + size)]
                    rows.append((doc_id, start, size, zlib.crc32(piece), n, size.bit_length() - 1))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int64))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]).astype({"doc_id": "Int64"})
            yield out.assign(ids=ids) if with_ids else out

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInPandas(run, PIECES + (", ids array<long>" if with_ids else ""))


def number_sequences(pieces: DataFrame) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (with ``row``, a number of each); every piece is a sequence."""
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(SALTS)).cast("int"))
    sizes = pieces.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", "salt", (F.sum("n").over(Window.partitionBy("bucket").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "start", "ids_crc32", "row"))
    ranked = pieces.withColumn("__rank", rank)
    joined = ranked.join(F.broadcast(before), ["bucket", "salt"])  # at most 32 buckets times SALTS rows
    return joined.withColumn("sequence_id", (F.col("__rank") - 1 + F.col("before")) * 64 + F.col("bucket")).withColumn("offset", F.lit(0).cast("long")).drop("__rank", "before", "salt", "row")


def pack(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids].

    Pieces are stored once, so that numbering does not tokenize again.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    stored = materialize(tokenized_pieces(docs, path, ranks_path, length, with_ids).withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    return number_sequences(stored).select(*columns, *(["ids"] if with_ids else []))


def op7_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
