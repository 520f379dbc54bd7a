"""Idempotent ingest: new objects to documents, chunks and statistics.

A batch is one version of the library (:mod:`tidewell.versions`): its documents, chunks and
statistics are there together or not at all, and what a document's key already names is left
out, so running a batch again adds nothing. The keys of a batch are sent to the stored ones,
never the other way. A library with indexes (:mod:`tidewell.plans.indexes`) gets the batch's
entries in the same version. A failed file fails alone. Only files that are not ingested yet are
opened, each once for every reader that needs it. What is counted is observed while it is
written; no job only counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.detect import detect_country, document_country, document_year
from tidewell.functions.embedding import Embedder, embed_column
from tidewell.functions.text import basename, strip, suffix
from tidewell.operators.chunking import chunked
from tidewell.operators.tabular import markdown, statistics
from tidewell.plans import indexes, summaries
from tidewell.schemas import TABLES, checked_periods
from tidewell.sources.extract import NATIVE_CHARS, chosen_text, extract_cells, extract_pdfs, extracted_images, joined_pages, pdf_pages, recognised_pages, sheet_cells
from tidewell.sources.listing import list_store, read_store
from tidewell.sources.objects import list_objects, of_kind, read_paths
from tidewell.skew import small, without
from tidewell.storage import exists, materialize, scratch
from tidewell.versions import Change, current, read


@dataclass
class Ingested:
    processed: int = 0
    skipped: int = 0
    failed: int = 0
    chunks: int = 0
    stat_rows: int = 0

    def add(self, other: Ingested) -> None:
        for name in ("processed", "skipped", "failed", "chunks", "stat_rows"):
            setattr(self, name, getattr(self, name) + getattr(other, name))


def document_id(key: str = "key"):
    """A surrogate that needs no sequence; two keys that share one are an error, see :func:`checked_ids`."""
    return F.xxhash64(key)


def checked_ids(documents: DataFrame, there: DataFrame) -> None:
    """Fail if a new document (id, r2_key) has the id of another key, new or stored, rather than lose one of them."""
    both = documents.select("id", "r2_key").unionByName(there.join(small(documents.select("id")), "id", "left_semi").select("id", "r2_key"))
    clash = both.groupBy("id").agg(F.min("r2_key").alias("a"), F.max("r2_key").alias("b")).filter("a <> b").first()
    if clash:
        raise ValueError(f"{clash['a']} and {clash['b']} have the same id")


def known(rows: DataFrame, key: str, table: DataFrame, of: str) -> DataFrame:
    """The keys of ``rows`` (stored) that ``table`` has, as one column; the few keys go to the table, which stays where it lies."""
    asked = rows.select(F.col(key).alias("__asked")).distinct()
    return table.join(small(asked), table[of] == F.col("__asked"), "left_semi").select(of).distinct()


def new_objects(objects: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Objects not ingested yet. The limit comes first, as a bound on objects looked at."""
    listed = looked_at(objects, limit)
    return without(listed, known(listed, "key", documents, "r2_key"), "key")


def looked_at(objects: DataFrame, limit: int | None = None) -> DataFrame:
    return objects if limit is None else objects.orderBy("key").limit(limit)


def document_rows(extracted: DataFrame) -> DataFrame:
    """documents from (key, metadata, file_type, text, method, page_count)."""
    meta = F.col("metadata")
    name, published = F.try_element_at(meta, F.lit("nom_pdf")), F.try_element_at(meta, F.lit("date_publication"))
    return extracted.select(
        document_id().alias("id"),
        F.col("key").alias("r2_key"),
        basename(F.col("key")).alias("filename"),
        "file_type",
        F.try_element_at(meta, F.lit("module")).alias("category"),
        F.try_element_at(meta, F.lit("section")).alias("subcategory"),
        document_country(name, F.col("key")).alias("country"),
        document_year(name, published, F.col("key")).alias("year"),
        F.try_element_at(meta, F.lit("type_document")).alias("type_document"),
        published.alias("date_publication"),
        F.col("method").alias("extraction_method"),
        F.col("page_count").cast("int").alias("page_count"),
        F.length("text").alias("char_count"),
        meta.alias("doc_metadata"),
        F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
        F.try_element_at(meta, F.lit("lien")).alias("source_url"),
    )


def chunk_rows(extracted: DataFrame, embedder: Embedder, **options) -> DataFrame:
    """chunks of extracted texts; image paths only on a document's first chunk."""
    rows = chunked(extracted.withColumn("document_id", document_id()), "text", ("document_id", "key", "metadata", "image_paths"), **options)
    meta = F.col("metadata")
    described = F.struct(
        F.try_element_at(meta, F.lit("module")).alias("category"),
        F.try_element_at(meta, F.lit("section")).alias("subcategory"),
        basename(F.col("key")).alias("source"),
        F.try_element_at(meta, F.lit("lien")).alias("lien"),
        F.when(F.col("chunk_index") == 0, F.col("image_paths")).alias("image_paths"),
    )
    embedded = embed_column(rows.select("document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content", "token_count", described.alias("chunk_metadata")), "content", embedder)
    return embedded.select(F.xxhash64("document_id", "chunk_index").alias("id"), "document_id", "chunk_index", "content", "token_count", "embedding", "chunk_metadata", F.current_timestamp().cast("timestamp_ntz").alias("created_at"))


def written(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` stored, and what was counted of its rows while they were written."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), label)
    got = seen.get
    return out, {n: got.get(n) or 0 for n in counts}


def ingest_batch(spark: SparkSession, extracted: DataFrame, tables: dict[str, str], embedder: Embedder, series: DataFrame | None = None, keep_chunkless: bool = False, **options) -> Ingested:
    """Add one batch to the library as a version (documents, chunks, statistics).

    Documents without a chunk fail with their statistics, unless ``keep_chunkless`` keeps
    workbooks of numbers.
    """
    rows = F.count(F.lit(1))
    root, names = library_of(tables), {n: tables[n].rstrip("/").rsplit("/", 1)[1] for n in ("documents", "chunks", "statistics")}
    with scratch(), Change(spark, root) as change:
        whole, all_ = written(extracted.dropDuplicates(["key"]), "ingest-extracted", n=rows)  # extraction runs here, once
        there = read(spark, root, names["documents"], TABLES["documents"], change.base)
        has_text = strip(F.col("text")) != ""
        fresh, new = written(without(whole, known(whole, "key", there, "r2_key"), "key"), "ingest-batch", n=rows, usable=F.count_if(has_text))
        usable = fresh.filter(has_text)
        chunks, pieces = written(chunk_rows(usable, embedder, **options), "ingest-chunks", n=rows)
        documents = document_rows(usable)
        if not keep_chunkless:
            documents = documents.join(small(chunks.select(F.col("document_id").alias("__has")).distinct()), documents["id"] == F.col("__has"), "left_semi")
        done, made = written(documents, "ingest-documents", n=rows)
        checked_ids(done, there)
        out = Ingested(processed=made["n"], skipped=all_["n"] - new["n"], failed=new["usable"] - made["n"], chunks=pieces["n"])
        if out.processed:
            change.append(names["documents"], done)
            change.append(names["chunks"], chunks)
            summaries.add(change, done)
            centroids = indexes.centroids_of(spark, root, change.base)
            if centroids is not None:
                indexes.add(change, chunks.withColumnRenamed("id", "chunk_id"), done, centroids)
            if series is not None:
                of_done = series.withColumn("document_id", F.xxhash64("key"))
                of_done = of_done.join(small(done.select(F.col("id").alias("__id"))), of_done["document_id"] == F.col("__id"), "left_semi")
                points, n = written(of_done.select(*[c.split()[0] for c in TABLES["statistics"].split(", ")]), "ingest-statistics", n=rows)
                out.stat_rows = n["n"]
                if out.stat_rows:
                    change.append(names["statistics"], points)
    return out


def extracted_files(bodies: DataFrame, pdf_reader=pdf_pages, sheet_reader=sheet_cells, page_splitter=None, recogniser=None, image_saver=None) -> tuple[DataFrame, DataFrame]:
    """(documents to chunk, statistics) of files (path, key, metadata, content).

    PDFs with fewer than ``NATIVE_CHARS`` native characters are recognised page by page if
    ``page_splitter`` and ``recogniser`` are given, and their images kept by ``image_saver``.
    """
    pdf = suffix(F.col("key")) == ".pdf"
    named = bodies.select("path", "key", "metadata")
    contents = bodies.select("path", "content", "key")
    native = materialize(extract_pdfs(contents.filter(pdf), pdf_reader), "ingest-native")
    scanned = contents.join(native.filter(F.length("native_text") < NATIVE_CHARS).select("path"), "path", "left_semi")
    texts = native.join(named, "path")
    if page_splitter and recogniser:
        read = materialize(joined_pages(recognised_pages(scanned, page_splitter, recogniser)), "ingest-recognised").withColumnRenamed("key", "path")
        texts = texts.join(read, "path", "left")
    else:
        texts = texts.withColumn("ocr_text", F.lit(""))
    if image_saver:
        texts = texts.join(materialize(extracted_images(scanned, image_saver), "ingest-images"), "path", "left")
    else:
        texts = texts.withColumns({"n_images": F.lit(0), "image_paths": F.lit(None).cast("array<string>")})
    chosen = chosen_text()
    documents = texts.select("key", "metadata", F.lit("pdf").alias("file_type"), chosen["text"].alias("text"), chosen["method"].alias("method"), "page_count", F.coalesce("image_paths", F.array().cast("array<string>")).alias("image_paths"))
    cells = materialize(extract_cells(contents.filter(~pdf), sheet_reader), "ingest-cells").withColumnRenamed("key", "path").join(named.select("path", "key"), "path").drop("path")
    blocks = markdown(cells).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("block")), "\n\n").alias("text"))
    books = blocks.join(named, "key").select("key", "metadata", F.lit("excel").alias("file_type"), "text", F.lit("excel").alias("method"), F.lit(None).cast("int").alias("page_count"), F.array().cast("array<string>").alias("image_paths"))
    files = named.select("key", detect_country(basename(F.col("key"))).alias("file_country"))
    series = statistics(cells.join(files, "key"), "file_country").select("key", F.xxhash64("key", "sheet", "row", "col").alias("id"), "indicator", "country", "period", "year", "value", "unit", "raw_label", "source_sheet")
    return documents.unionByName(books), checked_periods(series)


#: Files whose paths the driver holds at a time; each lot is a batch of its own.
FILES_PER_JOB = 10_000


def ingest_folder(spark: SparkSession, folder: str, tables: dict[str, str], embedder: Embedder, metadata: DataFrame | None = None, only: str | None = None, limit: int | None = None, files_per_job: int = FILES_PER_JOB, pdf_reader=pdf_pages, sheet_reader=sheet_cells, page_splitter=None, recogniser=None, image_saver=None, store: str | None = None, **options) -> Ingested:
    """List, leave out what is known, and extract and ingest what is left of a folder, lot by lot.

    What is known counts as skipped and is never opened. ``store`` names a store
    (:mod:`tidewell.sources.listing`) to list and fetch from in place of Spark's file reader.
    """
    readers = {"pdf_reader": pdf_reader, "sheet_reader": sheet_reader, "page_splitter": page_splitter, "recogniser": recogniser, "image_saver": image_saver}
    out = Ingested()
    with scratch():
        found = list_objects(spark, folder, metadata) if store is None else list_store(spark, folder, store)
        listed = materialize(looked_at(of_kind(found, only), limit), "ingest-listed")
        fresh = materialize(new_objects(listed, stored(spark, tables["documents"])), "ingest-fresh")
        out.skipped = listed.count() - fresh.count()
        paths = [r["path"] for r in fresh.select("path").orderBy("path").limit(files_per_job).collect()]
        while paths:
            with scratch():
                if store is None:
                    bodies = read_paths(spark, paths).join(fresh, "path")
                else:
                    bodies = materialize(read_store(fresh.filter((F.col("path") >= paths[0]) & (F.col("path") <= paths[-1])), folder, store), "ingest-contents")
                documents, series = extracted_files(bodies, **readers)
                out.add(ingest_batch(spark, documents, tables, embedder, series, **options))
            paths = [r["path"] for r in fresh.filter(F.col("path") > paths[-1]).select("path").orderBy("path").limit(files_per_job).collect()]
    return out


def library_of(tables: dict[str, str]) -> str:
    """The folder that holds the tables that change together."""
    roots = {tables[n].rstrip("/").rsplit("/", 1)[0] for n in ("documents", "chunks", "statistics")}
    if len(roots) != 1:
        raise ValueError(f"tables of one library lie in one folder, not in {sorted(roots)}")
    return roots.pop()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A table's rows in the newest version of its library, none if it is not there yet.

    A table that no version names, such as feedback, which its stream appends to, is read as it lies.
    """
    root, name = path.rstrip("/").rsplit("/", 1)
    version = current(spark, root)
    if name in version.tables:
        return read(spark, root, name, TABLES[name], version)
    if version.number and name in ("documents", "chunks", "statistics") or not exists(spark, path):
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(path)
