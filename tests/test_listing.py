"""Stores as data sources: listed by prefix and page, pruned, streamed, and ingested from."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_plans import MODEL, tables  # noqa: F401  a fixture
from tidewell.plans import ingest
from tidewell.sources import listing

ASKED = "/asked"


class Counting(listing.FolderStore):
    """Notes which prefixes are listed, and how."""

    def page(self, prefix, after, most):
        with open(self.root + ASKED, "a") as out:
            out.write(f"{prefix}|{most}\n")
        return super().page(prefix, after, most)

    def prefixes(self):
        return [p for p in super().prefixes()]


def asked(folder):
    return {line.split("|")[0] for line in (folder / "asked").read_text().split()} if (folder / "asked").exists() else set()


def cells(content, key):
    return [("S", r, c, v, "str") for r, row in enumerate([["Indicateur", "2022", "2023"], ["Inflation au Gabon", "2,5", "3"]]) for c, v in enumerate(row)]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "store"
    for d in range(30):
        (root / f"d{d:02d}" / "sub").mkdir(parents=True)
        for k in range(100):
            (root / f"d{d:02d}" / ("sub" if k % 2 else "") / f"f{k}.pdf").write_bytes(f"{d} {k}".encode())
    (root / "top.pdf").write_bytes(b"top")
    (root / "d00" / f"f0.pdf{listing.SIDECAR}").write_text(json.dumps({"lien": "https%3A%2F%2Fx", "module": "m"}))
    (root / "d01" / "book.xlsx").write_bytes(b"x")
    return root


def source(spark, folder, kind="objects"):
    listing.register(spark)
    return spark.read.format(kind).option("path", str(folder)).option("store", "tests.test_listing:Counting")


def test_thousands_of_keys_page_by_page(spark, folder):
    rows = source(spark, folder).option("page", 30).option("prefixes", 4).load()
    assert rows.rdd.getNumPartitions() == 8
    got = {r["key"]: r for r in rows.collect() if r["key"] != "asked"}
    assert len(got) == 3002 and got["d05/sub/f1.pdf"]["size"] == 3 and got["top.pdf"]["metadata"] == {}
    assert got["d00/f0.pdf"]["metadata"] == {"lien": "https%3A%2F%2Fx", "module": "m"}
    assert len(asked(folder)) == 31 and "|30" in (folder / "asked").read_text()


def test_prefixes_are_left_out(spark, folder):
    assert source(spark, folder).option("prefix", "d07/sub/").load().count() == 50
    assert asked(folder) == {"d07/"}
    (folder / "asked").unlink()
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        assert source(spark, folder).option("pushdown", "true").load().filter(F.col("key").startswith("d1")).count() == 1000
        assert asked(folder) == {"", *(f"d1{k}/" for k in range(10))}  # a file at the top may start so too
        (folder / "asked").unlink()
        assert source(spark, folder).option("pushdown", "true").load().filter("key = 'd03/f2.pdf'").count() == 1 and asked(folder) == {"d03/"}
        (folder / "asked").unlink()
        assert source(spark, folder).option("pushdown", "true").load().filter("key IN ('d03/f2.pdf', 'top.pdf')").count() == 2 and asked(folder) == {"", "d03/"}
    finally:
        spark.conf.set(key, before)


def test_cells_of_workbooks(spark, folder):
    got = source(spark, folder, "cells").option("reader", "tests.test_listing:cells").load().collect()
    assert len(got) == 6 and {(r["key"], r["sheet"]) for r in got} == {("d01/book.xlsx", "S")} and got[1]["raw"] == "2022"


def test_a_stream_lists_what_arrives(spark, tmp_path):
    root = tmp_path / "store"
    (root / "a").mkdir(parents=True)
    listing.register(spark)

    def run():
        stream = spark.readStream.format("objects").option("path", str(root)).load()
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["key"] for r in spark.read.schema(listing.OBJECTS).parquet(f"{tmp_path}/out").collect())

    (root / "a" / "1.pdf").write_bytes(b"1")
    assert run() == ["a/1.pdf"]
    (root / "2.pdf").write_bytes(b"2")
    assert run() == ["2.pdf", "a/1.pdf"] and run() == ["2.pdf", "a/1.pdf"]


def test_ingest_from_a_store(spark, tables, folder):  # noqa: F811
    def pages(content):
        return [f"Le rapport annuel {content.decode()} décrit la politique monétaire. " * 4]

    for d in folder.iterdir():
        if d.name not in ("d00", "d01", "top.pdf"):
            d.rename(folder.parent / d.name)
    options = {"pdf_reader": pages, "sheet_reader": cells, "store": "tests.test_listing:Counting", "files_per_job": 150}
    got = ingest.ingest_folder(spark, str(folder), tables, MODEL, **options)
    assert (got.processed, got.skipped, got.stat_rows) == (202, 0, 2)
    docs = {r["r2_key"]: r for r in ingest.stored(spark, tables["documents"]).collect()}
    assert docs["d00/f0.pdf"]["source_url"] == "https://x" and docs["d01/book.xlsx"]["file_type"] == "excel" and len(docs) == 202
    again = ingest.ingest_folder(spark, str(folder), tables, MODEL, **options)
    assert (again.processed, again.skipped) == (0, 202)
