import hashlib
import math
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import detect, embedding, text, vectors
from tidewell.functions.embedding import HashingEmbedder, embed_column, embed_question


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("function", "given", "expected"),
    [
        (detect.detect_year, "Rapport 2019-2023", 2023),
        (detect.detect_year, "rapport_2023.pdf", None),
        (detect.detect_year, "1989 2040", None),
        (detect.detect_year, "é2024", None),
        (detect.detect_country, "Rapport CIRCA", "Centrafrique"),
        (detect.detect_country, "Guinée Équatoriale", "Guinee Equatoriale"),
        (detect.detect_country, "Gabon et Cameroun", "Cameroun"),
        (detect.detect_country, None, None),
        (detect.to_number, "(12,5)", -12.5),
        (detect.to_number, "(12%)", -12.0),
        (detect.to_number, "(12)%", 12.0),
        (detect.to_number, "1 234,5", 1234.5),
        (detect.to_number, "1 234", 1234.0),
        (detect.to_number, "1.234,5", None),
        (detect.to_number, "1d", None),
        (detect.to_number, "-inf", -math.inf),
        (detect.looks_like_period, "janv-2023", True),
        (detect.looks_like_period, "maison", True),
        (detect.looks_like_period, "février", False),
        (text.fold, "L’Été à Œuvre", "l'ete a œuvre"),
        (text.transliterate, "L’Été à Œuvre ß", "l'ete a oeuvre ss"),
        (text.clean, " a \t b\n\n\n\nc\n ", "a b\n\nc"),
        (text.scrub, "a\x00b\x07", "a b "),
        (text.normalize_question, "  Quel\n Taux ? ", "quel taux ?"),
        (text.titled, "GÉNÉRAL-ADJOINT D'ETAT", "Général-Adjoint D'Etat"),
        (text.basename, "a/b/c.PDF", "c.PDF"),
        (text.suffix, "a.b/c.PDF", ".pdf"),
        (text.suffix, "a/.hidden", ""),
        (text.stem, "a/b.c.xlsx", "b.c"),
        (text.flat_csv, None, ""),
        (text.flat_csv, "a\r\nb\nc", "a b c"),
        (text.escape_html, "<a&'b\">", "&lt;a&amp;&#39;b&quot;&gt;"),
        (text.inline_markdown, "**x** *y* [n](https://a.b/c) http://d.e <i>", '<strong>x</strong> *y* <a href="https://a.b/c">n</a> <a href="http://d.e">http://d.e</a> &lt;i&gt;'),
        (text.inline_markdown, "[n](javascript:x)", "[n](javascript:x)"),
        (text.month_label, "2024-03", "Mar 24"),
        (text.is_number, " 2024 ", True),
        (text.table_cells, "| a | b c |", ["a", "b c"]),
        (text.is_table_rule, "|---|:-:|", True),
        (text.list_item, " 2. deux", (True, "deux")),
        (text.list_item, "- un", (False, "un")),
        (text.list_item, "2) deux", None),
        (text.list_item, "deux", None),
        (text.is_title_line, "GOUVERNEUR ADJOINT", True),
        (text.is_title_line, "Gouverneur", False),
        (text.is_name_line, "Yvon SANA BANGUI", True),
        (text.is_name_line, "SANA BANGUI", False),
        (text.is_entry_line, "Titre : Nom.", True),
    ],
)
def test_functions(spark, function, given, expected):
    assert one(spark, given, function) == expected


def test_rounding_is_that_of_the_exact_value(spark):
    import random

    r = random.Random(1)
    values = [2.675, 0.0625, 0.5, 1.5, 2.5, -2.675, -0.125, 1e300, -0.0, 66.65, 1.005, 0.285, 4.35, math.inf]
    values += [r.uniform(-1000, 1000) for _ in range(3000)] + [k / 1000 + 0.0005 for k in range(3000)] + [k / 2000 for k in range(2000)]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3):
        got = [row[0] for row in frame.select(text.half_even(F.col("x"), digits)).collect()]
        assert got == [v if math.isinf(v) else float(round(v, digits)) for v in values]
    assert math.isnan(spark.range(1).select(text.half_even(F.lit(float("nan")), 2)).first()[0])
    assert spark.range(1).select(text.half_even(F.lit(None).cast("double"), 2)).first()[0] is None


def test_pieces_of_a_text(spark):
    assert one(spark, "abcab\nÀx", lambda c: text.grams(c, 3)) == ["abc", "bca", "cab", "ab\n", "b\nÀ", "\nÀx"]
    assert one(spark, "ab", lambda c: text.grams(c, 3)) == []


def test_percent_decoding_keeps_plus_and_malformed(spark):
    frame = spark.createDataFrame([({"a": "x+y%20z", "b": "100%", "c": None},)], "m map<string,string>")
    assert frame.select(text.percent_decode(F.col("m")).alias("m")).first()["m"] == {"a": "x+y z", "b": "100%", "c": None}


def test_lists_and_numbers(spark):
    assert one(spark, " a, ,b ", text.split_list) == ["a", "b"]
    assert one(spark, 1234, text.compact_number, "long") == "1.2k" and one(spark, 12, text.compact_number, "long") == "12"


def test_cache_key_can_tell_documents_apart(spark):
    frame = spark.createDataFrame([(" Q ", 1), ("q", 2)], "q string, d long")
    plain = {r[0] for r in frame.select(text.cache_key(F.lit(None), F.col("q"))).collect()}
    scoped = {r[0] for r in frame.select(text.cache_key(F.lit(None), F.col("q"), F.col("d"))).collect()}
    assert len(plain) == 1 and len(scoped) == 2


def test_distances(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    got = frame.select(*[vectors.distance(m, F.col("a"), F.col("b")).alias(m) for m in (*vectors.METRICS, "other")]).first()
    assert got["cosine"] == pytest.approx(0.04) and got["l2"] == pytest.approx(2**0.5) and got["ip"] == -24 and got["other"] == got["cosine"]


def test_embedding_is_normalised_and_the_same_everywhere(spark):
    model = HashingEmbedder(32)
    rows = embed_column(spark.createDataFrame([("taux directeur",), (None,)], "t string"), "t", model).collect()
    assert sum(x * x for x in rows[0]["embedding"]) == pytest.approx(1, abs=1e-5) and not any(rows[1]["embedding"])
    assert embed_question(model, "  Taux\nDIRECTEUR ") == pytest.approx(rows[0]["embedding"])


def test_features_are_hashed_by_md5_and_not_one_by_one(monkeypatch):
    r, calls = random.Random(5), []
    words = ["".join(r.choice("abcXYZ019éÿɏ") for _ in range(r.choice([1, 3, 8, 27, 54, 55, 56, 90]))) for _ in range(400)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, 400, 40)] + ["", "...", "un"]

    def md5(text, of=hashlib.md5):
        h = of(text.encode()).hexdigest()
        return int(h[:8], 16), 1 if h[8] < "8" else -1

    want = np.zeros((len(texts), 48))
    for row, text in zip(want, texts):
        own = text.split() if text != "..." else []
        for place, sign in map(md5, own + [f"{a} {b}" for a, b in zip(own, own[1:])]):
            row[place % 48] += sign
        row /= np.linalg.norm(row) or 1
    monkeypatch.setattr(embedding.hashlib, "md5", lambda data, of=hashlib.md5, **k: calls.append(data) or of(data))
    got = HashingEmbedder(48).embed(texts)
    assert np.allclose(got, want, atol=1e-6) and HashingEmbedder(48).embed([]).shape == (0, 48)
    assert calls and all(len(c) > 55 for c in calls)  # the others go side by side


def test_fold_is_the_definition_over_all_code_points(spark):
    def definition(text):
        plain = text.replace("\u2019", "'").replace("\u2018", "'")
        return "".join(c for c in unicodedata.normalize("NFD", plain) if unicodedata.category(c) != "Mn").lower()

    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = [*letters, "x\ud55c\uae00y \u00e9\u8a9e \u09cb", ""]
    rows = spark.createDataFrame(pd.DataFrame({"s": texts})).select("s", text.fold(F.col("s")).alias("f")).collect()
    assert [r["s"] for r in rows if r["f"] != definition(r["s"])] == []
