import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import cases
from tidewell.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_are_those_of_the_tokenizer():
    encoder = packing.Encoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = Tokenizer.from_file(PATH)
    r = random.Random(1)
    texts = ["".join(r.choice("ab 'sé\n\t1!   \x1c\x85") for _ in range(r.randrange(16))) for _ in range(1500)]
    texts += [t for _, t, *_ in cases.ROWS if t] + ["x <|endoftext|> y"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pieces_are_powers_of_two_that_tile():
    for n in [1, 2, 3, 7, 2047, 2048, 2049, 5000]:
        at = 0
        for start, size in packing.binary_pieces(n):
            assert start == at and size & (size - 1) == 0 and size <= 2048
            at += size
        assert at == n


def test_edge_cases_round_trip(spark):
    rows = packing.pack(cases.docs(spark), with_ids=True).collect()
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] and r["offset"] == 0
        by.setdefault(r["doc_id"], []).append(r)
    texts = {d: t for d, t, *_ in cases.ROWS if d is not None and d != 1}
    for doc_id, text in texts.items():
        pieces = sorted(by[doc_id], key=lambda r: r["start"])
        assert sum((r["ids"] for r in pieces), []) == ids_of(text)
        assert {r["doc_tokens"] for r in pieces} == {len(ids_of(text))}
    assert sum(r["length"] for r in by[1]) == 2 * len(ids_of(cases.BASE))
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for bucket in {r["bucket"] for r in rows}:
        assert sorted(r["sequence_id"] // 64 for r in rows if r["bucket"] == bucket) == list(range(sum(r["bucket"] == bucket for r in rows)))
    assert packing.pack(cases.docs(spark, [])).count() == 0


def test_rows_without_an_id_are_dealt_over_salts(spark, monkeypatch):
    rows = [(None, "the same text", "en", "a", 1)] * 300
    pieces = packing.tokenized_pieces(cases.docs(spark, rows), PATH, public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumn("row", packing.F.monotonically_increasing_id())
    got = packing.number_sequences(pieces.persist())
    windows = got._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(doc_id" in windows and "row#" in windows
    assert len({r["sequence_id"] for r in got.collect()}) == got.count() >= 300


def test_long_runs_are_packed_as_the_tokenizer_file_has_them(spark):
    n = 3_000_000
    texts = [" " * n, "\n" * n, "a" * n, "x" + "\t \n" * (n // 3) + "y"]
    rows = packing.pack(cases.docs(spark, [(k, t, "en", "a", 1) for k, t in enumerate(texts)]), with_ids=True).select("doc_id", "start", "ids_crc32", "length").collect()
    for k, text in enumerate(texts):
        ids = np.array(ids_of(text), "<u4")
        got = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        assert sum(r["length"] for r in got) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got)
