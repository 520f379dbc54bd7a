"""Library search: filters, substring search, order, pages, and the semantic fallback."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import basename, strip
from tidewell.operators import retrieval

# The choice that filters nothing, columns that are searched, content types.
ALL = "Tous"
SEARCHED = ("filename", "subcategory", "category", "country")
POOL, FLOOR = 200, 0.35
CONTENT_TYPES = {"pdf": "application/pdf", "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
PAGE_SIZE = 50


def structural(documents: DataFrame, doc_type: str | None = None, country: str | None = None, type_column: str = "type_document") -> DataFrame:
    """Type and country filters; the sentinel and None mean no filter."""
    if doc_type not in (None, "", ALL):
        documents = documents.filter(F.col(type_column) == doc_type)
    if country not in (None, "", ALL):
        documents = documents.filter(F.col("country") == country)
    return documents


def contains_text(search: str, columns: Sequence[str] = SEARCHED, year: str | None = "year") -> Column:
    """Case-insensitive substring in any column (``%`` and ``_`` work as wildcards), or the year if all digits."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{search}%")
    if year and search.strip().isascii() and search.strip().isdigit():
        hit = hit | (F.col(year) == F.lit(int(search.strip())))
    return hit


def ordering(sort: str = "recent", key: str = "id") -> list[Column]:
    """``recent`` or ``oldest``, unknown dates and years last, the key breaks ties."""
    if sort not in ("recent", "oldest"):
        raise ValueError("sort is recent or oldest")
    if sort == "recent":
        return [F.col("date_publication").desc_nulls_last(), F.col("year").desc_nulls_last(), F.col("created_at").desc(), F.col(key)]
    return [F.col("date_publication").asc_nulls_last(), F.col("year").asc_nulls_last(), F.col("created_at").asc(), F.col(key)]


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_count(total: Column | int, size: int = PAGE_SIZE) -> Column:
    return F.ceil((F.lit(total) if isinstance(total, int) else total) / size)


def listed(documents: DataFrame, uncategorised: str = "Non classe") -> DataFrame:
    """What a result list shows of a document."""
    return documents.select(
        "id",
        F.col("filename").alias("title"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit(uncategorised)).alias("type"),
        F.upper("file_type").alias("fileType"),
        F.coalesce("date_publication", F.lit("")).alias("date"),
        F.coalesce("subcategory", F.lit("")).alias("description"),
        "country",
        "year",
        F.concat(F.lit("/api/documents/"), F.col("id").cast("string"), F.lit("/view")).alias("url"),
    )


def view_target(documents: DataFrame, default_url: str = "") -> DataFrame:
    """Where a document is viewed: its object if it has one, else its page, else a default; and its content type."""
    kinds = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    has_key = F.coalesce("r2_key", F.lit("")) != ""
    return documents.select(
        "id",
        F.when(has_key, "object").otherwise("redirect").alias("kind"),
        F.when(has_key, F.col("r2_key")).otherwise(F.coalesce(F.nullif("source_url", F.lit("")), F.lit(default_url))).alias("target"),
        F.coalesce(F.try_element_at(kinds, F.lower("file_type")), F.lit("application/octet-stream")).alias("content_type"),
        basename(F.col("r2_key")).alias("download_name"),
    )


def semantic_fallback(chunks: DataFrame, query: Sequence[float], doc_type: str | None = None, country: str | None = None, pool: int = POOL, floor: float = FLOOR) -> DataFrame:
    """Best chunk of each document among the nearest chunks under the structural filters."""
    hits = retrieval.similarity_search(structural(chunks, doc_type, country), query, pool, None, floor)
    return retrieval.best_chunk_per_document(hits)


def search(documents: DataFrame, text: str = "", doc_type: str | None = None, country: str | None = None, sort: str = "recent", limit: int = 50, offset: int = 0, chunks: DataFrame | None = None, embed=None) -> Mapping[str, object]:
    """One page of the library: total, search mode and rows.

    If nothing matches and the trimmed text has three characters or more, the semantic
    fallback answers in score order and ``sort`` is not regarded.
    """
    found = structural(documents, doc_type, country)
    if text:
        found = found.filter(contains_text(text))
    found = found.cache()
    try:
        total = found.count()
        if total == 0 and chunks is not None and embed is not None and len(text.strip()) >= 3:
            pool = semantic_fallback(chunks, embed(text), doc_type, country).select("document_id", "score", "chunk_id").cache()
            try:  # POOL rows at most: documents are filtered where they lie
                rows = page(documents.join(F.broadcast(pool), documents["id"] == pool["document_id"]), retrieval.best_first(), limit, offset)
                return {"total": pool.count(), "searchMode": "semantic", "items": listed(rows).collect()}
            finally:
                pool.unpersist()
        return {"total": total, "searchMode": "text", "items": listed(page(found, ordering(sort), limit, offset)).collect()}
    finally:
        found.unpersist()


def trimmed_length(text: Column) -> Column:
    return F.length(strip(text))
