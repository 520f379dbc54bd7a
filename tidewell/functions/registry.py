"""The functions that SQL cannot spell, by name in a session.

Scalar ones are pandas UDFs, passages are a table function:

    register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL chunk_text(text) c")
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell.functions.embedding import Embedder, HashingEmbedder
from tidewell.operators.chunking import chunks_of, estimate_tokens


def register(spark: SparkSession, embedder: Embedder | None = None, count: Callable[[str], int] = estimate_tokens, **options) -> list[str]:
    """Register ``chunk_text``, ``count_tokens`` and ``embed_text``; ``options`` are those of chunking."""
    model = embedder or HashingEmbedder()

    class Passages:
        def eval(self, text: str):
            for k, (content, tokens) in enumerate(chunks_of(text, count=count, **options)):
                yield k, content, tokens

    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t or "") for t in texts], dtype="int32")

    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.embed([t or "" for t in texts])))

    spark.udtf.register("chunk_text", F.udtf(Passages, returnType="chunk_index int, content string, token_count int"))
    spark.udf.register("count_tokens", F.pandas_udf(tokens, "int"))
    spark.udf.register("embed_text", F.pandas_udf(embed, "array<float>"))
    return ["chunk_text", "count_tokens", "embed_text"]
