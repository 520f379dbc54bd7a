"""A question to its answer: routing, retrieval, generated SQL, cache and retries.

The model and the embedder are handed in; everything around them runs here.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.config import Config
from tidewell.functions.embedding import Embedder, embed_question
from tidewell.operators import retrieval, routing, statements
from tidewell.operators.chatlog import NO_ANSWER

EXPLORATORY_TOP_K, DOCUMENT_TOP_K = 12, 10
#: Vectors of so many dimensions are scored in Arrow batches.
BATCHED_DIMENSIONS = 256
#: Characters of a question.
QUESTION_CHARS = (2, 2000)
META_ANSWER = "Je réponds aux questions sur les documents et les statistiques de la bibliothèque."
UNAVAILABLE = "Le service est momentanément indisponible."
INTERRUPTED = "\n[La réponse a été interrompue.]"
PROMPT = "Contexte :\n{context}\n\nQuestion : {question}\nSans réponse dans le contexte, réponds exactement : {no_answer}\nRéponse :"
EXPLORATORY_PROMPT = "Contexte :\n{context}\n\nPrésente de façon structurée ce que le contexte dit du sujet.\nQuestion : {question}\nSans réponse dans le contexte, réponds exactement : {no_answer}\nRéponse :"


@dataclass
class Response:
    answer: str
    query_type: str
    sources: list[dict] = field(default_factory=list)
    sql: str | None = None
    context: str = ""


class ResponseCache:
    """LRU with a time to live. ``by_document`` keeps answers about one document apart."""

    def __init__(self, size: int = 100, ttl: float = 3600, clock: Callable[[], float] = time.time, by_document: bool = True):
        self.size, self.ttl, self.clock, self.by_document = size, ttl, clock, by_document
        self.entries: OrderedDict[str, tuple[float, Response]] = OrderedDict()

    def key(self, model: str | None, question: str, document_id: int | None = None) -> str:
        scope = f"::{document_id if document_id is not None else ''}" if self.by_document else ""
        return hashlib.sha256(f"{model or 'primary'}::{question.strip().lower()}{scope}".encode()).hexdigest()

    def get(self, model: str | None, question: str, document_id: int | None = None) -> Response | None:
        key = self.key(model, question, document_id)
        if key not in self.entries:
            return None
        created, response = self.entries[key]
        if self.clock() - created > self.ttl:
            del self.entries[key]
            return None
        self.entries.move_to_end(key)
        return response

    def set(self, model: str | None, question: str, response: Response, document_id: int | None = None) -> None:
        if len(self.entries) >= self.size:
            self.entries.popitem(last=False)
        key = self.key(model, question, document_id)
        self.entries[key] = (self.clock(), response)
        self.entries.move_to_end(key)

    def clear(self) -> None:
        self.entries.clear()


class RateLimited(Exception):
    """Raised by a client when the service asks to wait."""


def with_retries(call: Callable[[str], str], models: list[str], attempts: int = 4, wait: Callable[[float], None] = time.sleep) -> str:
    """Try a model up to ``attempts`` times, then the next; other errors are raised at once."""
    for model in dict.fromkeys(models):
        for n in range(attempts):
            try:
                return call(model)
            except RateLimited:
                wait(3 * 2**n)
            except ConnectionError:
                wait(3)
    raise RuntimeError("no model answered")


@dataclass(frozen=True)
class Plan:
    """What routing decided about one question."""

    kind: str
    filters: dict[str, object]
    top_k: int
    exploratory: bool


@dataclass
class Engine:
    """``generate`` answers a prompt with a model; ``config`` sets limits, models and the defaults of sources."""

    spark: SparkSession
    chunks: DataFrame
    documents: DataFrame
    embedder: Embedder
    generate: Callable[..., str]
    generate_sql: Callable[[str], str] = statements.offline_sql
    config: Config = field(default_factory=Config)
    cache: ResponseCache | None = None
    synonyms: DataFrame | None = None
    apply_expansion: bool = False
    fold_router_accents: bool = False

    def __post_init__(self):
        if self.cache is None:
            self.cache = ResponseCache(self.config.cache_entries, self.config.cache_seconds)

    def route(self, question: str, document_id: int | None = None) -> Plan:
        """One small job for each question; a question about one document is never routed."""
        if document_id is not None:
            return Plan("vector", {"document_id": document_id}, DOCUMENT_TOP_K, False)
        asked = self.spark.range(1).select(F.lit(question).alias("q"))
        r = asked.select(routing.routed(F.col("q"), fold_accents=self.fold_router_accents).alias("r")).first()["r"]
        return Plan(r["query_type"], {"country": r["filter_country"], "year": r["filter_year"]}, EXPLORATORY_TOP_K if r["exploratory"] else self.config.top_k, r["exploratory"])

    def context(self, question: str, plan: Plan) -> tuple[str, list[dict], str | None]:
        """(context, sources, sql) of a routed question."""
        sql = sql_text = None
        if plan.kind in ("sql", "hybrid"):
            answer = statements.ask(self.spark, question, self.generate_sql, max_rows=self.config.sql_max_rows)
            sql, sql_text = answer.sql, statements.context(answer)
        text, sources = None, []
        if plan.kind in ("vector", "hybrid"):
            wording = question
            if self.apply_expansion and self.synonyms is not None:
                wording = routing.expanded(self.spark.createDataFrame([(0, question)], "qid long, question string"), self.synonyms).first()["expanded"]
            hits = retrieval.retrieve(self.chunks, embed_question(self.embedder, wording), plan.top_k, plan.filters, self.config.min_similarity, self.config.metric, self.embedder.dimension >= BATCHED_DIMENSIONS).select("chunk_id", "document_id", "content", "score")
            ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*retrieval.best_first()))).cache()  # top_k rows
            items = retrieval.enriched(ranked, self.documents).cache()
            try:
                found = retrieval.context_text(items).first()
                text = found["context"] if found else retrieval.NO_CONTEXT
                sources = [r.asDict() for r in retrieval.distinct_sources(items, self.config.default_url).orderBy("rank").collect()]
            finally:
                items.unpersist()
                ranked.unpersist()
        return retrieval.joined_context(sql_text, text), sources, sql

    def prompt(self, question: str, context: str, plan: Plan) -> str:
        return (EXPLORATORY_PROMPT if plan.exploratory else PROMPT).format(context=context, question=question, no_answer=NO_ANSWER)

    def ask(self, question: str, model: str | None = None, document_id: int | None = None) -> Response:
        least, most = QUESTION_CHARS
        if not least <= len(question) <= most:
            raise ValueError(f"a question has {least} to {most} characters")
        plan = self.route(question, document_id)
        if plan.kind == "meta":
            return Response(META_ANSWER, "meta")
        known = self.cache.get(model, question, document_id)
        if known:
            return known
        context, sources, sql = self.context(question, plan)
        answer = self.generate(self.prompt(question, context, plan), self.config.resolve_model(model))
        response = Response(answer, plan.kind, [] if answer.strip() == NO_ANSWER else sources, sql, context)
        self.cache.set(model, question, response, document_id)
        return response

    def stream(self, question: str, tokens: Callable[..., Iterator[str]], model: str | None = None, document_id: int | None = None) -> Iterator[str]:
        """One JSON line with type and sources, then the answer's tokens.

        An error before that line gives one that says so, and a text; a later one only a text.
        """

        def head(kind: str, sources: list[dict] = (), sql: str | None = None, **more) -> str:
            return json.dumps({"type": "meta", "query_type": kind, "sources": list(sources), "sql": sql, **more}, ensure_ascii=False, default=str) + "\n"

        headed = started = False
        try:
            plan = self.route(question, document_id)
            if plan.kind == "meta":
                yield head("meta")
                yield META_ANSWER
                return
            context, sources, sql = self.context(question, plan)
            yield head(plan.kind, sources, sql)
            headed = True
            for token in tokens(self.prompt(question, context, plan), self.config.resolve_model(model)):
                started = True
                yield token
        except Exception:  # noqa: BLE001  the protocol has no other place for it
            if not headed:
                yield head("error", error=True)
            yield INTERRUPTED if started else UNAVAILABLE
