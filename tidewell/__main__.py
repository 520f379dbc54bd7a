"""Commands over a folder of tables:

    python -m tidewell --tables DIR ingest FOLDER [--only pdf|excel] [--limit N]
    python -m tidewell --tables DIR search TEXT [--type T] [--country C] [--sort recent|oldest]
    python -m tidewell --tables DIR ask QUESTION --generate module:function [--document ID]
    python -m tidewell --tables DIR evaluate OUT --generate module:function [--samples N] [--seed S]
    python -m tidewell --tables DIR backfill-keys FOLDER [--dry-run]
    python -m tidewell --tables DIR backfill-links CSV [--dry-run]
    python -m tidewell --tables DIR index [--cells N]
    python -m tidewell --tables DIR vacuum
    python -m tidewell --tables DIR health
    python -m tidewell query NAME SF_DIR

``--generate`` names a function that answers a prompt (and, for ``ask``, a model's key);
``--embedder`` a class or object with ``embed``; ``--settings`` a file for Config.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell.config import Config
from tidewell.functions.embedding import HashingEmbedder, embed_question
from tidewell.operators import evaluation, library
from tidewell.plans import catalog, indexes, maintenance, summaries
from tidewell.plans.ask import Engine
from tidewell.plans.ingest import ingest_folder, library_of, stored
from tidewell.sources.objects import list_objects, read_links
from tidewell.versions import current, vacuum


def named(reference: str):
    """``module:name`` as the object it names; a class is called."""
    module, _, name = reference.partition(":")
    found = getattr(importlib.import_module(module), name)
    return found() if isinstance(found, type) else found


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidewell", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("--tables", default="tables", help="folder of the tables documents, chunks, statistics, feedback")
    out.add_argument("--settings")
    out.add_argument("--embedder")
    commands = out.add_subparsers(dest="command", required=True)
    c = commands.add_parser("ingest")
    c.add_argument("folder")
    c.add_argument("--only", choices=["pdf", "excel"])
    c.add_argument("--limit", type=int)
    c = commands.add_parser("search")
    c.add_argument("text")
    c.add_argument("--type")
    c.add_argument("--country")
    c.add_argument("--sort", default="recent")
    c.add_argument("--limit", type=int, default=50)
    c.add_argument("--offset", type=int, default=0)
    c = commands.add_parser("ask")
    c.add_argument("question")
    c.add_argument("--generate", required=True)
    c.add_argument("--model")
    c.add_argument("--document", type=int)
    c = commands.add_parser("evaluate")
    c.add_argument("out")
    c.add_argument("--generate", required=True)
    c.add_argument("--samples", type=int, default=20)
    c.add_argument("--seed", type=int, default=0)
    for name, of in (("backfill-keys", "folder"), ("backfill-links", "csv")):
        c = commands.add_parser(name)
        c.add_argument(of)
        c.add_argument("--dry-run", action="store_true")
    commands.add_parser("health")
    commands.add_parser("vacuum")
    c = commands.add_parser("index")
    c.add_argument("--cells", type=int, default=16)
    c = commands.add_parser("query")
    c.add_argument("name", choices=sorted(catalog.QUERIES))
    c.add_argument("folder")
    return out


def passages(spark: SparkSession, tables: dict[str, str]):
    """Chunks as retrieval reads them: with the columns of their documents that it filters by."""
    docs = stored(spark, tables["documents"]).select(F.col("id").alias("document_id"), "category", "country", "year", "type_document")
    chunks = stored(spark, tables["chunks"]).select(F.col("id").alias("chunk_id"), "document_id", "content", "embedding")
    return chunks.join(docs, "document_id")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None):
    """Run a command, print its result as JSON, and return it."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tidewell").getOrCreate()
    config = Config.read(a.settings) if a.settings else Config.load()
    embedder = named(a.embedder) if a.embedder else HashingEmbedder()
    tables = {n: f"{a.tables.rstrip('/')}/{n}" for n in ("documents", "chunks", "statistics", "feedback")}
    if a.command == "query":
        catalog.QUERIES[a.name](spark, a.folder).show(50, truncate=80)
        return None
    if a.command == "ingest":
        out = vars(ingest_folder(spark, a.folder, tables, embedder, only=a.only, limit=a.limit, **config.chunking()))
    elif a.command == "search":
        out = library.search(stored(spark, tables["documents"]), a.text, a.type, a.country, a.sort, a.limit, a.offset, passages(spark, tables), lambda text: embed_question(embedder, text))
        out = {**out, "items": [r.asDict() for r in out["items"]]}
    elif a.command in ("ask", "evaluate"):
        generate = named(a.generate)
        stored(spark, tables["statistics"]).createOrReplaceTempView("statistics")
        engine = Engine(spark, passages(spark, tables), stored(spark, tables["documents"]), embedder, lambda prompt, model: generate(prompt), config=config)
        if a.command == "ask":
            out = vars(engine.ask(a.question, a.model, a.document))
        else:
            sampled = evaluation.passages(stored(spark, tables["chunks"]), stored(spark, tables["documents"]))
            rows = evaluation.evaluate(spark, sampled, engine.ask, generate, a.samples, a.seed).cache()
            evaluation.write_report(rows, a.out)
            out = evaluation.summary(rows).first().asDict()
            rows.unpersist()
    elif a.command == "backfill-keys":
        out = maintenance.backfill_keys(spark, tables["documents"], list_objects(spark, a.folder), a.dry_run)
    elif a.command == "backfill-links":
        out = maintenance.backfill_links(spark, tables["documents"], read_links(spark, a.csv), a.dry_run)
    elif a.command == "index":
        documents = stored(spark, tables["documents"])
        chunks = stored(spark, tables["chunks"]).select(F.col("id").alias("chunk_id"), "embedding")
        indexes.build(spark, library_of(tables), chunks, documents, a.cells)
        summaries.build(spark, library_of(tables), documents)
        out = {"version": current(spark, library_of(tables)).number}
    elif a.command == "vacuum":
        out = {"folders": vacuum(spark, library_of(tables), ["documents", "chunks", "statistics", "graph", "postings", "centroids", "summary"])}
    else:
        out = maintenance.health(spark, tables)
    print(json.dumps(out, ensure_ascii=False, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
