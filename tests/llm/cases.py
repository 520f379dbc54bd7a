"""Small tables with every awkward row, and plain-Python references."""

from __future__ import annotations

CLASHING = "fp string, n string, host string, path string, range string, key string, hash string, p string, score string, shard string, words string, salt string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of great strength under the pale autumn moon tonight"
LONG = " ".join(f"word{k % 977}x{k % 13}" for k in range(30_000))

ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE, "en", "a", 1),
    (3, BASE.upper(), "en", "b", 1),
    (4, "  " + BASE.replace(" ", "\t \n") + "\n", None, "b", None),
    (5, None, "en", None, None),
    (6, "", None, None, 0),
    (7, " \t\n", "fr", "c", 3),
    (8, "one", "fr", "c", 3),
    (9, "one two", "fr", "c", 7),
    (10, LONG, "en", "a", len(LONG)),
    (11, "é ü ñ œuvre   naïve #*$ |x| <|im_end|> <|endoftext|> \x0b\x0c end", "de", "c", 1),
    (12, "line one is here\nline one is here\nline one is here\n\nother", "de", "c", 1),
    (None, BASE + " indeed", "en", "a", 1),
    (None, None, None, None, None),
    (1, BASE, "en", "a", 1),  # a repeated row
]


def docs(spark, rows=None, clash: bool = True):
    """The rows as a documents table; ``clash`` adds columns with names that operators use inside."""
    frame = spark.createDataFrame(ROWS if rows is None else rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        for part in CLASHING.split(", "):
            frame = frame.withColumn(part.split()[0], F.lit("clash"))
    return frame


def filler(n: int, seed: int, words: int = 60) -> list[str]:
    """n unlike texts."""
    import random

    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    return [" ".join(r.choice(vocabulary) for _ in range(words)) + "." for _ in range(n)]
