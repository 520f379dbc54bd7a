"""WARC archives, index first.

Writing streams each partition into gzip members, one per record, and yields an index row
per record: archive, offset, length, URL, digest. The index is stored as a table before
anything is read, so a reader never scans an archive: it takes the index rows it wants,
sorts them by archive and offset, coalesces ranges that nearly touch, and reads each
coalesced range once.

Records with equal payloads (by digest, of ``min_bytes`` or more) are one ``response``, the
one of the smallest ``page_id``, and ``revisit`` records that refer to it and hold no
payload. The groups are found from digests alone. Where the table of shared digests, once
measured, fits, it is broadcast and payloads never move before they are written; beyond
that they join it by one shuffle, in which a hot digest is broadcast as one row and its
pages are dealt over salts, so no task gathers it.

Lost executors. A task writes to files named after its own attempt and the index holds only
what succeeded, so a second attempt leaves an orphan file but never a wrong row. Archives
lie in the folder the cluster shares; a folder without a scheme is resolved by the cluster's
default file system, as Spark resolves it, before any task opens it.

Edge cases. Null html is an empty payload; an empty payload is a payload like others. Null
URLs leave the target header out. Rows without ``page_id`` are written as responses. Ties:
rows that repeat a ``page_id`` and payload share their verdict, so if theirs is the smallest
id each of them is a response. Very long payloads are written and read whole, one record at
a time; an archive is closed by size between records. URLs are percent-encoded where they
hold white space or control characters. Other columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.skew import SALTS, attach
from tidewell.storage import delete, materialize, new_path, qualified, release, sliced

#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Ranges with a gap of at most so many bytes are read as one, up to so many bytes at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, stored_bytes long, payload string, intact boolean"

_HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")
_PAGE = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a UTF-8 string, without Python."""
    digest = F.sha1(payload)
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(8):
        bits = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [digits.substr(F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_bytes(page_id, url, kind, refers_to, digest: str, size: int, payload: bytes) -> bytes:
    """One whole WARC record."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0], safe=""), url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html;charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Header fields (lower-case names) and payload of one whole record."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(head + b"\r\n")}
    return fields | {"payload": body[: int(fields["content-length"])]}


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response), one row per page."""
    base = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("payload"))
    keyed = base.withColumn("digest", base32_sha1(F.col("payload")))
    slim = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    shared = materialize(slim.filter("n > 1"), "warc-shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = attach(keyed, shared, ["digest"], "n", total, ["page_id", "url"])
    revisits = (F.octet_length("payload") >= min_bytes) & (F.col("page_id") > F.col("first"))
    return out.select("page_id", "url", "payload", "digest", F.when(revisits, F.col("first")).alias("refers_to"))


def _opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a qualified folder."""
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", folder)
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` below ``folder`` and return the stored index."""
    folder = qualified(pages.sparkSession, folder)
    planned = plan_records(pages, min_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _opened(folder)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        out, at, number = None, 0, 0
        try:
            for batch in sliced(batches, 500):
                rows = []
                for page_id, url, payload, digest, refers_to in zip(*(batch[c].array for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                    page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                    body = payload.encode("utf-8", "surrogatepass")
                    kind = "response" if refers_to is None else "revisit"
                    member = gzip.compress(record_bytes(page_id, url, kind, refers_to, digest, len(body), body if refers_to is None else b""), 6, mtime=0)
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                            number += 1
                        store.create_dir(root, recursive=True)
                        archive, at = f"{name}-{number:04d}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{archive}", compression=None)
                    out.write(member)
                    rows.append((archive, at, len(member), url, digest, page_id, kind))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["archive", "offset", "length", "url", "digest", "page_id", "record_type"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return materialize(planned.mapInPandas(run, INDEX), "warc-index")


def coalesced(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int, int]]:
    """(offset, length, first row, end row) of the reads that cover sorted (offset, length) rows."""
    out: list[list[int]] = []
    for k, (offset, length) in enumerate(rows):
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length - out[-1][0])
            out[-1][3] = k + 1
        else:
            out.append([offset, length, k, k + 1])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Read the records of (a selection of) an index, in coalesced ranges.

    ``intact`` tells whether a response's payload has the digest and length its header
    and its index row give.
    """
    folder = qualified(index.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _opened(folder)
        for batch in sliced(batches, 500):
            for archive, rows in batch.groupby("archive", sort=False):
                with store.open_input_file(f"{root}/{archive}") as source:
                    ranges, digests = list(zip(rows["offset"], rows["length"])), rows["digest"].array
                    for start, length, low, high in coalesced(ranges):
                        source.seek(int(start))
                        block = source.read(int(length))
                        yield _parsed([(block[o - start : o - start + n], d) for (o, n), d in zip(ranges[low:high], digests[low:high])], with_payload)

    slim = index.select("archive", "offset", "length", "digest")
    parts = F.pmod(F.floor(F.col("offset") / F.lit(READ_BYTES * 8)), F.lit(SALTS))  # a large archive is read by several tasks
    return slim.repartition("archive", parts).sortWithinPartitions("archive", "offset").mapInPandas(run, RECORD)


def _parsed(records: list[tuple[bytes, str]], with_payload: bool) -> pd.DataFrame:
    rows = []
    for member, digest in records:
        r = parse_record(zlib.decompress(member, 31))
        page, refers = (re.sub(r"^<urn:page:|>$", "", r[k]) if k in r else "" for k in ("warc-record-id", "warc-refers-to"))
        size, said, body = int(r["warc-payload-length"]), r["warc-payload-digest"].removeprefix("sha1:"), r["payload"]
        response = r["warc-type"] == "response"
        found = base64.b32encode(hashlib.sha1(body).digest()).decode() if response else said
        rows.append((int(page) if page else None, r.get("warc-target-uri"), r["warc-type"], int(refers) if refers else None, len(body) if response else size, found, len(member), body.decode("utf-8", "surrogatepass") if with_payload else None, found == said == digest and (not response or len(body) == size)))
    return pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "stored_bytes", "payload", "intact"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def op10_warc(pages: DataFrame) -> DataFrame:
    """Write every page, read every record back, and tell what the archives hold.

    The read-back rows are stored, after which the archives of this query are deleted, as
    they are if it fails.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    try:
        index = write_archives(pages, folder)
        back = materialize(read_records(index, folder).drop("payload"), "warc-records")
        release(index)
    finally:
        delete(spark, folder)
    if not back.filter("NOT intact").isEmpty():
        raise ValueError("a record read back differs from what was written")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v // {0}) % 32 AS INTEGER), 1)"
ORACLE_SQL = f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digested AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: list_transform([CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT)], lambda v: {" || ".join(_DIGIT.format(32**k) for k in (3, 2, 1, 0))})[1]), '') AS payload_digest FROM hashed
), grouped AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM digested
)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CAST(CASE WHEN page_id > first THEN first END AS BIGINT) AS refers_to FROM grouped
"""
