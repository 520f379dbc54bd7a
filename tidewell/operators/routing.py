"""Question routing and synonym expansion as Column expressions, for one question or a table of them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.detect import detect_country, detect_year
from tidewell.functions.text import fold, let, strip

# Substrings that route a question.
DATA_KEYWORDS = ("taux", "inflation", "masse monetaire", "reserves", "statistique", "montant", "valeur", "evolution", "combien", "chiffre", "pourcentage", "balance", "emission")
META_PATTERNS = ("que sais-tu faire", "que peux-tu faire", "qui es-tu", "qui êtes-vous", "que sais tu faire", "c'est quoi ton rôle", "à quoi sers-tu", "comment tu marches", "comment fonctionnes-tu", "tes capacités", "que peux tu faire", "aide-moi", "comment t'utiliser", "quelles questions", "que peux-tu m'aider")
EXPLORATORY_PATTERNS = ("parle-moi de", "parle moi de", "que peux-tu me dire sur", "que peux tu me dire sur", "qu'est-ce que", "qu'est ce que", "explique-moi", "explique moi", "présente-moi", "présente moi", "dis-moi tout sur", "résume", "vue d'ensemble", "qui est")
PERSON_KEYWORDS = ("qui est", "qui sont", "gouverneur", "directeur", "président", "responsable", "chef", "nommé", "nomination", "poste")


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def routed(question: Column, data_keywords: Sequence[str] = DATA_KEYWORDS, fold_accents: bool = False) -> Column:
    """struct(query_type, country, year, filter_country, filter_year, exploratory).

    Keywords are compared with the lower-cased question as it is; ``fold_accents`` also
    finds them under accents.
    """
    low = F.lower(question)
    flags = F.struct(
        let(strip(low), lambda t: F.struct(contains_any(t, META_PATTERNS).alias("meta"), contains_any(t, PERSON_KEYWORDS).alias("person"), contains_any(t, EXPLORATORY_PATTERNS).alias("exploratory"))).alias("t"),
        let(fold(question) if fold_accents else low, lambda t: contains_any(t, data_keywords)).alias("data"),
        detect_country(question).alias("country"),
        detect_year(question).alias("year"),
    )

    def decided(f: Column) -> Column:
        meta, data, country, year = f["t"]["meta"], f["data"], f["country"], f["year"]
        kind = F.when(meta, "meta").when(data & (country.isNotNull() | year.isNotNull()), "hybrid").when(data, "sql").otherwise("vector")
        return F.struct(
            kind.alias("query_type"),
            F.when(~meta, country).alias("country"),
            F.when(~meta, year).alias("year"),
            F.when(~meta, country).alias("filter_country"),
            F.when(~meta & data & ~f["t"]["person"], year).alias("filter_year"),
            (~meta & f["t"]["exploratory"]).alias("exploratory"),
        )

    return let(flags, decided)


#: A small sample of our own; production hands in its table (ord, key, terms).
SAMPLE_SYNONYMS = (
    (0, "taux directeur", ("TIAO", "taux d'intérêt aux opérations", "taux repo")),
    (1, "inflation", ("hausse des prix", "indice des prix à la consommation")),
    (2, "masse monétaire", ("agrégat M2", "liquidité")),
    (3, "réserves", ("avoirs extérieurs", "liquidité")),
    (4, "gouverneur", ("gouvernement de la banque", "organes de direction")),
)


def synonym_table(spark, synonyms=SAMPLE_SYNONYMS) -> DataFrame:
    return spark.createDataFrame([(o, k, list(t)) for o, k, t in synonyms], "ord int, key string, terms array<string>")


def read_synonyms(spark, path: str) -> DataFrame:
    """A dictionary file: JSON lines with ``key`` and ``terms``, in the order of the file, or one JSON object of keys to lists.

    Keys that fold alike count once, the last one's terms under the first one's place.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    one = F.from_json("text", "map<string, array<string>>")
    entries = whole.select(F.posexplode(F.when(F.ltrim("text").rlike(r'(?s)^\{(?!\s*"(key|terms)"\s*:)'), F.map_entries(one)).otherwise(
        F.transform(F.filter(F.split("text", "\n"), lambda l: F.trim(l) != ""), lambda l: F.struct(F.get_json_object(l, "$.key").alias("key"), F.from_json(F.get_json_object(l, "$.terms"), "array<string>").alias("value")))
    )).alias("ord", "e")).select("ord", "e.key", F.col("e.value").alias("terms")).filter("key IS NOT NULL")
    kept = entries.groupBy(fold(F.col("key")).alias("__folded")).agg(F.min("ord").alias("ord"), F.min_by("key", "ord").alias("key"), F.max_by("terms", "ord").alias("terms"))
    return kept.select(F.col("ord").cast("int").alias("ord"), "key", "terms")


#: Keys of one automaton and questions of one task, about.
KEYS, QUESTIONS = 50_000, 20_000


def _automaton(keys: Sequence[str]):
    """All keys as one automaton; each leads to the places of the rows that have it. Empty ones are not in it."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for k, key in enumerate(keys):
        if key:
            places.setdefault(key, []).append(k)
    out = ahocorasick.Automaton()
    for key, rows in places.items():
        out.add_word(key, rows)
    if places:
        out.make_automaton()
    return out if places else None


def matched_synonyms(questions: DataFrame, synonyms: DataFrame, qid: str = "qid", question: str = "question", keys: int = KEYS, block: int = QUESTIONS) -> DataFrame:
    """(qid, ord, key, terms) for every key that the folded question contains, for any number of questions and keys.

    Keys are dealt into parts by hash, each an automaton that is built in the task that uses
    it, and questions into blocks; every block meets every part, and a question is passed
    over once in each. Neither side goes through the driver.
    """
    parts = max(1, -(-synonyms.count() // keys))
    blocks = max(1, -(-questions.count() // block))
    folded = fold(F.col("key"))
    right = synonyms.select("ord", "key", "terms", folded.alias("__key"), F.pmod(F.xxhash64(folded), F.lit(parts)).cast("int").alias("__part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block"))
    left = questions.select(F.col(qid).alias("__qid"), fold(F.col(question)).alias("__q"), F.pmod(F.xxhash64(qid, question), F.lit(blocks)).cast("int").alias("__block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))

    def match(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        automaton = _automaton(known["__key"].tolist())
        always = [k for k, key in enumerate(known["__key"]) if key == ""]  # an empty key is in every question
        rows, hits = [], []
        for n, text in enumerate(asked["__q"]):
            if text is None:
                continue
            found = sorted({*always, *(k for _, places in (automaton.iter(text) if automaton else ()) for k in places)})
            rows += [n] * len(found)
            hits += found
        out = known.iloc[hits][["ord", "key", "terms"]].reset_index(drop=True)
        out.insert(0, qid, asked["__qid"].iloc[rows].to_numpy())
        return out

    kind = questions.schema[qid].dataType.simpleString()
    schema = f"`{qid}` {kind}, ord {synonyms.schema['ord'].dataType.simpleString()}, key string, terms array<string>"
    return left.groupBy("__part", "__block").cogroup(right.groupBy("__part", "__block")).applyInPandas(match, schema)


def expanded(questions: DataFrame, synonyms: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """(qid, expanded): the question and the distinct terms of its keys, in dictionary order."""
    found = matched_synonyms(questions, synonyms, qid, question).groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("ord", "terms"))).alias("__m"))
    terms = found.select(F.col(qid).alias("__qid"), F.array_distinct(F.flatten("__m.terms")).alias("__terms"))
    out = questions.join(terms, questions[qid] == terms["__qid"], "left")
    return out.select(qid, F.when(F.size("__terms") > 0, F.concat(question, F.lit(" "), F.array_join("__terms", " "))).otherwise(F.col(question)).alias("expanded"))
