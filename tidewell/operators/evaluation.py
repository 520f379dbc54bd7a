"""Evaluation: sampling, parsing of judged answers, means, and the report files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import flat_csv, half_even

METRICS = ("context_recall", "faithfulness", "answer_relevance")
REPORT = ("chunk_id", "document_id", "filename", "category", "country", "year", "question", "expected_answer", "generated_answer", "query_type", *METRICS, "sources", "context_used", "chunk_content")


def sample(chunks: DataFrame, n: int, seed: int = 0, key: str = "chunk_id", content: str = "content", min_chars: int = 200) -> DataFrame:
    """n random long chunks, the same for a seed however the data is partitioned: those with the smallest digests of key and seed."""
    return chunks.filter(F.length(content) > min_chars).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def passages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What :func:`evaluate` samples from: chunks (id, document_id, content) with their documents."""
    docs = documents.select(F.col("id").alias("__id"), "filename", "category", "country", "year")
    joined = chunks.join(docs, chunks["document_id"] == docs["__id"])
    return joined.select(F.col("id").alias("chunk_id"), "document_id", "filename", "category", "country", "year", "content")


def _braces(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def judged(text: Column) -> Column:
    """struct of the three scores in a judge's answer; all 0 if any is no number or there is no JSON."""
    parsed = F.from_json(_braces(text), ", ".join(f"{m} string" for m in METRICS))
    number = {m: F.coalesce(parsed[m], F.lit("0")).try_cast("double").cast("int") for m in METRICS}
    valid = parsed.isNotNull()
    for m in METRICS:
        valid = valid & number[m].isNotNull()
    return F.struct(*[F.when(valid, number[m]).otherwise(0).alias(m) for m in METRICS])


def question_pair(text: Column) -> Column:
    """struct(question, expected_answer) of a generated pair, NULL if either is missing."""
    parsed = F.from_json(_braces(text), "question string, expected_answer string")
    return F.when((F.coalesce(parsed["question"], F.lit("")) != "") & (F.coalesce(parsed["expected_answer"], F.lit("")) != ""), parsed)


def summary(rows: DataFrame) -> DataFrame:
    """Counts, the three means to two digits, and the mean of these rounded means."""
    means = rows.agg(F.count(F.lit(1)).alias("n_samples"), *[half_even(F.avg(m), 2).alias(f"avg_{m}") for m in METRICS])
    total = sum((F.col(f"avg_{m}") for m in METRICS[1:]), F.col(f"avg_{METRICS[0]}"))
    return means.withColumn("avg_global", half_even(total / len(METRICS), 2))


JUDGE_PROMPT = """Note de 1 à 5 la réponse obtenue.
Question : {question}
Réponse attendue : {expected}
Réponse obtenue : {answer}
Contexte : {context}
context_recall : le contexte contient-il l'information ? faithfulness : la réponse s'y tient-elle ? answer_relevance : répond-elle à la question ?
Réponds par un objet JSON avec ces trois clés."""
QUESTION_PROMPT = """Écris une question dont la réponse est dans ce passage, et cette réponse, en JSON avec les clés question et expected_answer.
Passage : {content}"""


def evaluate(spark, chunks: DataFrame, ask, generate, n: int = 20, seed: int = 0) -> DataFrame:
    """Report rows for n sampled passages (chunk_id, document_id, filename, category, country, year, content).

    ``generate`` answers a prompt and ``ask`` a question; both are services called from the
    driver, one sampled passage at a time.
    """
    made = []
    for r in sample(chunks, n, seed).collect():
        made.append({**r.asDict(), "pair": generate(QUESTION_PROMPT.format(content=r["content"]))})
    kind = "chunk_id long, document_id long, filename string, category string, country string, year int, content string, pair string"
    pairs = spark.createDataFrame([tuple(m.get(c.split()[0]) for c in kind.split(", ")) for m in made], kind)
    rows = []
    for r in pairs.withColumn("qa", question_pair(F.col("pair"))).filter("qa IS NOT NULL").collect():
        answer = ask(r["qa"]["question"])
        judged_text = generate(JUDGE_PROMPT.format(question=r["qa"]["question"], expected=r["qa"]["expected_answer"], answer=answer.answer, context=answer.context))
        rows.append((r["chunk_id"], r["document_id"], r["filename"], r["category"], r["country"], r["year"], *r["qa"], answer.answer, answer.query_type, json.dumps(answer.sources, ensure_ascii=False, default=str), answer.context, r["content"], judged_text))
    schema = "chunk_id long, document_id long, filename string, category string, country string, year int, question string, expected_answer string, generated_answer string, query_type string, sources string, context_used string, chunk_content string, judged string"
    return spark.createDataFrame(rows, schema).withColumn("j", judged(F.col("judged"))).select("*", "j.*").select(*REPORT)


def write_report(rows: DataFrame, folder: str) -> None:
    """CSV of the fixed columns, texts on one line each, and the summary as JSON."""
    flat = rows.select(*[flat_csv(F.col(c).cast("string")).alias(c) for c in REPORT])
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{folder}/rows")
    summary(rows).write.mode("overwrite").json(f"{folder}/summary")
