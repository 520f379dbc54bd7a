"""Passages from texts.

Lines of a directory, a title in capitals over a name, become sentences of their own and
are grouped by four; all else is split recursively at the coarsest separator that works.
The token counter and the affiliation in rewritten titles are parameters; the default counter
is an offline estimate, :class:`VocabularyCounter` that of a vocabulary file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as text_patterns

CHUNK_TOKENS, OVERLAP_TOKENS, MIN_CHARS = 400, 90, 50
ENTRIES = 4
# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
AFFILIATION = "de la Banque"

_TITLE = re.compile(text_patterns.TITLE)
_GIVEN = re.compile(text_patterns.GIVEN_NAME)
_FAMILY = re.compile(text_patterns.FAMILY_NAME)
_ENTRY = re.compile(text_patterns.ENTRY)
_TOKEN = re.compile(r"\w{1,4}|[^\w\s]")


def estimate_tokens(text: str) -> int:
    """Offline estimate: one token per four word characters begun, one per other sign."""
    return sum(1 for _ in _TOKEN.finditer(text))


@lru_cache(maxsize=4)
def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class VocabularyCounter:
    """Counts tokens of a byte-pair vocabulary given as a rank table; it is loaded once a worker."""

    ranks_path: str
    pattern: str

    def __call__(self, text: str) -> int:
        encoding = _encoding(self.ranks_path, self.pattern)
        return sum(len(encoding.encode_ordinary(part)) for part in _within_stack(text))


#: Blanks in a row that the pattern may meet at once; it fails near a million.
LONG_BLANK = 50_000


def _within_stack(text: str) -> list[str]:
    """A text in parts that have no longer run of blanks; such a run counts a few tokens more where it is cut."""
    if len(text) <= LONG_BLANK or not any(len(r.group()) > LONG_BLANK for r in re.finditer(r"\s+", text)):
        return [text]
    out, at = [], 0
    for run in re.finditer(r"\s+", text):
        while run.end() - max(at, run.start()) > LONG_BLANK:
            cut = max(at, run.start()) + LONG_BLANK
            out.append(text[at:cut])
            at = cut
    return [*out, text[at:]]


def _is_name(line: str) -> bool:
    words = line.split()
    kinds = [bool(_GIVEN.fullmatch(w)) for w in words]
    return 1 <= len(words) <= 5 and any(kinds) and all(given or _FAMILY.fullmatch(w) for given, w in zip(kinds, words))


def join_titles(text: str, affiliation: str = AFFILIATION) -> str:
    """A title line and the name below it as ``Title affiliation : Name.``"""
    lines, out = iter(text.split("\n")), []
    held = next(lines, None)
    while held is not None:
        below = next(lines, None)
        title, name = held.strip(), (below or "").strip()
        if _TITLE.fullmatch(title) and len(title.split()) <= 6 and _is_name(name):
            out.append(f"{title.title()} {affiliation} : {name}.")
            held = next(lines, None)
        else:
            out.append(held)
            held = below
    return "\n".join(out)


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that keep the separator at their start."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def split_recursive(text: str, size: int, overlap: int, count: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` tokens where separators allow, with tails of at most ``overlap`` repeated."""
    which = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[which + 1 :]
    out: list[str] = []
    fitting: list[tuple[str, int]] = []

    def flush() -> None:
        window: list[tuple[str, int]] = []
        total = 0
        for piece, tokens in fitting:
            if window and total + tokens > size:
                out.append("".join(p for p, _ in window).strip())
                while window and (total > overlap or total + tokens > size):
                    total -= window.pop(0)[1]
            window.append((piece, tokens))
            total += tokens
        if window:
            out.append("".join(p for p, _ in window).strip())
        fitting.clear()

    for piece in _cut(text, separators[which]):
        tokens = count(piece)
        if tokens < size:
            fitting.append((piece, tokens))
        else:
            flush()
            out.extend(split_recursive(piece, size, overlap, count, finer) if finer else [piece])
    flush()
    return [p for p in out if p]


def chunks_of(text: str | None, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, min_chars: int = MIN_CHARS, count: Callable[[str], int] = estimate_tokens, affiliation: str = AFFILIATION) -> list[tuple[str, int]]:
    """(content, tokens) of a text's passages in order; pieces under ``min_chars`` are dropped."""
    count = lru_cache(maxsize=4096)(count)  # pieces come again at finer separators and in the result
    cleaned = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text or "")).strip()
    out: list[str] = []
    run: list[str] = []
    entries = False

    def flush() -> None:
        if run and entries:
            out.extend("\n".join(run[k : k + ENTRIES]) for k in range(0, len(run), ENTRIES))
        elif run:
            out.extend(split_recursive("\n".join(run), size, overlap, count))
        run.clear()

    if cleaned:
        for line in join_titles(cleaned, affiliation).split("\n"):
            is_entry = bool(_ENTRY.fullmatch(line.strip()))
            if is_entry != entries:
                flush()
                entries = is_entry
            run.append(line.strip() if is_entry else line)
        flush()
    return [(p, count(p)) for p in (x.strip() for x in out) if len(p) >= min_chars]


def chunked(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """A row per passage: carried columns, chunk_index, content, token_count. No shuffle."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"content": c, "token_count": n} for c, n in chunks_of(t, **options)] for t in texts])

    parts = F.pandas_udf(run, "array<struct<content: string, token_count: int>>")(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(*carry, F.posexplode(parts).alias("chunk_index", "c"))
    return rows.select(*carry, "chunk_index", "c.content", "c.token_count")


def entry_lots(lines: DataFrame, doc: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """Runs of entry lines in lots of four, as gaps and islands: (doc, run, lot, content)."""
    from pyspark.sql import Window

    inside = Window.partitionBy(doc).orderBy(order)
    entry = text_patterns.is_entry_line(F.trim(F.col(line)))
    marked = lines.withColumn("__e", entry).withColumn("__new", (F.coalesce(F.lag("__e").over(inside), ~F.col("__e")) != F.col("__e")).cast("int"))
    runs = marked.withColumn("run", F.sum("__new").over(inside)).filter("__e")
    placed = runs.withColumn("lot", F.floor((F.row_number().over(Window.partitionBy(doc, "run").orderBy(order)) - 1) / ENTRIES))
    lots = placed.groupBy(doc, "run", "lot").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(F.col(line)).alias("t")))).alias("l"))
    return lots.select(doc, "run", "lot", F.array_join("l.t", "\n").alias("content")).filter(F.length("content") >= MIN_CHARS)
