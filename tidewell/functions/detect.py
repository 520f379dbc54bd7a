"""Country, year, period and number detection as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import let, strip, transliterate

# Countries in order of precedence, and substrings of the transliterated text.
COUNTRIES = (
    ("Cameroun", ("cameroun", "cameroon")),
    ("Congo", ("congo",)),
    ("Gabon", ("gabon",)),
    ("Tchad", ("tchad", "chad")),
    ("Centrafrique", ("centrafrique", "rca", "centrafricaine", "central african")),
    ("Guinee Equatoriale", ("guinee equatoriale", "guinea ecuatorial", "equatorial guinea")),
)

# Tokens that mark a column heading as a period.
PERIOD_TOKENS = ("janv", "fevr", "mars", "avril", "mai", "juin", "juil", "aout", "sept", "oct", "nov", "dec", "trim", "t1", "t2", "t3", "t4")

_YEAR = r"(?<![\p{L}\p{N}_])(199\d|20[0-3]\d)(?![\p{L}\p{N}_])"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def detect_country(text: Column) -> Column:
    """The first country, in order of precedence, of which any spelling occurs anywhere."""
    def first(low: Column) -> Column:
        found = F
        for country, spellings in COUNTRIES:
            hit = F.lit(False)
            for s in spellings:
                hit = hit | F.contains(low, F.lit(s))
            found = found.when(hit, F.lit(country))
        return found

    return let(transliterate(text), first)


def detect_year(text: Column) -> Column:
    """The last free-standing year 1990 to 2039."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(_YEAR), 1), F.lit(-1)).cast("int")


def looks_like_period(label: Column) -> Column:
    def named(low: Column) -> Column:
        hit = F.lit(False)
        for token in PERIOD_TOKENS:
            hit = hit | F.contains(low, F.lit(token))
        return hit

    return detect_year(strip(label)).isNotNull() | let(F.lower(strip(label)), named)


def to_number(raw: Column) -> Column:
    """A cell's text as DOUBLE: comma decimals, spaces as separators, (x) negative, % dropped; else NULL."""
    s = F.replace(F.translate(strip(raw), "  ", ""), F.lit(","), F.lit("."))
    negative = F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))
    bare = F.regexp_replace(F.regexp_replace(s, r"^[()%]+|[()%]+$", ""), r"(?<=\d)_(?=\d)", "")
    special = F.lower(F.regexp_extract(bare, r"^[+-]?(?i:(nan|inf|infinity))$", 1))
    value = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    value = F.when(special == "nan", F.lit(float("nan"))).when(special != "", F.lit(float("inf")) * F.when(F.startswith(bare, F.lit("-")), -1).otherwise(1)).otherwise(value)
    return F.when(negative, -value).otherwise(value)


def document_country(*texts: Column) -> Column:
    return F.coalesce(*[detect_country(t) for t in texts])


def document_year(*texts: Column) -> Column:
    return F.coalesce(*[detect_year(t) for t in texts])
