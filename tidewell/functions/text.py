"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


_HANGUL = (0xAC00, 0xD7A4)


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """What every code point is without its marks, from the Unicode tables themselves.

    Letters with one base and their bases, then all non-spacing marks, which go; and the few
    letters of several parts that are no marks. Hangul is left to arithmetic.
    """
    one, bases, marks, several = [], [], [], []
    for code in (*range(0x80, 0x32400), *range(0xE0000, 0xE0200)):  # all planes with letters or marks
        if 0xD800 <= code < 0xF900 or _HANGUL[0] <= code < _HANGUL[1]:
            continue
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base == "":
            marks.append(ch)
        elif base != ch and len(base) == 1:
            one.append(ch)
            bases.append(base)
        elif base != ch:
            several.append((ch, base))
    return "".join(one) + "".join(marks), "".join(bases), several


_ACCENTED, _BASES, _SEVERAL = _fold_table()
_QUOTES = "’‘"
#: Letters without a decomposition, spelled in ASCII.
_SPELLED = (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("«", "<<"), ("»", ">>"), ("…", "..."), ("€", "EUR"), ("–", "-"), ("—", "--"), (" ", " "), ("“", '"'), ("”", '"'))

BLANK = r"\s\x1c-\x1f\x85  -     　 "


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def grams(text: Column, length: int) -> Column:
    """Distinct pieces of ``length`` letters, found in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), 1))


def unify_quotes(text: Column) -> Column:
    return F.translate(text, _QUOTES, "''")


def _taken_apart(letter: Column) -> Column:
    """A letter of several parts as these: Hangul syllables by arithmetic, the others by name."""
    n = F.ascii(letter) - _HANGUL[0]
    part = lambda first, k: F.substr(F.lit("".join(map(chr, range(*first)))), (k + 1).cast("int"), F.lit(1))
    lead, vowel, tail = part((0x1100, 0x1113), F.floor(n / 588)), part((0x1161, 0x1176), F.floor(n % 588 / 28)), F.when(n % 28 > 0, part((0x11A8, 0x11C3), n % 28 - 1)).otherwise("")
    named = F.create_map(*[F.lit(x) for pair in _SEVERAL for x in pair])
    return F.when((n >= 0) & (n < _HANGUL[1] - _HANGUL[0]), F.concat(lead, vowel, tail)).otherwise(F.coalesce(F.try_element_at(named, letter), letter))


_APART = "[가-힣" + "".join(ch for ch, _ in _SEVERAL) + "]"


def fold(text: Column) -> Column:
    """Lower case without diacritics, over all of Unicode; typographic apostrophes made plain, ligatures stay."""
    plain = F.translate(unify_quotes(text), _ACCENTED, _BASES)
    letters = F.array_join(F.transform(F.split(plain, ""), _taken_apart), "")
    ascii_only = F.octet_length(plain) == F.length(plain)  # most texts are by now, and need no search
    return F.lower(F.when(ascii_only, plain).when(F.rlike(plain, F.lit(_APART)), letters).otherwise(plain))


def transliterate(text: Column) -> Column:
    """Lower-case ASCII spelling: diacritics dropped, ligatures spelled out."""
    out = unify_quotes(text)
    for letter, spelled in _SPELLED:
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return F.lower(F.translate(out, _ACCENTED, _BASES))


def clean(text: Column) -> Column:
    """Runs of blanks to one, three or more line breaks to two, no white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def scrub(text: Column) -> Column:
    """NUL and BEL become spaces."""
    return F.translate(text, "\x00\x07", "  ")


def normalize_question(text: Column) -> Column:
    """Lower case, white space collapsed: the form in which a question is embedded."""
    return strip(F.regexp_replace(F.lower(text), f"[{BLANK}]+", " "))


def cache_key(model: Column, question: Column, document_id: Column | None = None) -> Column:
    """SHA-256 of model and question; with ``document_id`` answers are told apart by scope."""
    parts = [F.coalesce(model, F.lit("primary")), F.lit("::"), F.lower(strip(question))]
    if document_id is not None:
        parts += [F.lit("::"), F.coalesce(document_id.cast("string"), F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def basename(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def suffix(key: Column) -> Column:
    """Lower-case extension with its dot, empty if there is none; a leading dot is no extension."""
    return F.lower(F.regexp_extract(basename(key), r"^.+(\.[^.]+)$", 1))


def stem(key: Column) -> Column:
    return F.regexp_replace(basename(key), r"(?<=.)\.[^.]+$", "")


def drop_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^/.]+$", "")


def percent_decode(values: Column) -> Column:
    """Decode every value of a map; plus signs stay, malformed values stay as they are."""
    return F.transform_values(values, lambda _, v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v))


def flat_csv(text: Column) -> Column:
    """NULL as empty, line breaks as spaces."""
    return F.coalesce(F.regexp_replace(text, "\r\n|\n|\r", " "), F.lit(""))


def titled(text: Column) -> Column:
    """Every run of letters capitalised, what follows a hyphen or apostrophe included."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1), lambda run: F.initcap(run)), "")


# The capitals of title lines and names, and the forms of a title, of the words of a name, and of an entry.
CAPITAL = "A-ZÀÂÄÉÈÊËÎÏÔÖÙÛÜÇ"
TITLE = f"[{CAPITAL}][{CAPITAL} '\\-]{{2,60}}"
GIVEN_NAME = f"[{CAPITAL}][a-zà-ÿ'\\-]+"
FAMILY_NAME = f"[{CAPITAL}]{{2,}}"
ENTRY = r".+ : .+\."


def is_title_line(line: Column) -> Column:
    return line.rlike(f"^{TITLE}$") & (F.size(F.split(strip(line), f"[{BLANK}]+")) <= 6)


def is_name_line(line: Column) -> Column:
    """One to five words, each capitalised or all capitals, at least one capitalised."""
    words = F.split(strip(line), f"[{BLANK}]+")
    given = f"^{GIVEN_NAME}$"
    return F.size(words).between(1, 5) & F.forall(words, lambda w: w.rlike(given) | w.rlike(f"^{FAMILY_NAME}$")) & F.exists(words, lambda w: w.rlike(given))


def is_entry_line(line: Column) -> Column:
    return line.rlike(f"^{ENTRY}$")


def escape_html(text: Column) -> Column:
    out = text
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def inline_markdown(text: Column) -> Column:
    """Bold, named links and bare addresses of one line, escaped first; only http(s) becomes a link."""
    out = F.regexp_replace(escape_html(text), r"\*\*(.*?)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\((https?://[^\s)]+)\)", '<a href="$2">$1</a>')
    return F.regexp_replace(out, r'(?<!")(https?://[^\s<]+)', '<a href="$1">$1</a>')


def is_table_row(line: Column) -> Column:
    return strip(line).rlike(r"^\|.*\|$")


def is_table_rule(line: Column) -> Column:
    return strip(line).rlike(r"^\|[\s:|-]+\|$")


def table_cells(line: Column) -> Column:
    """Trimmed cells of ``| a | b |``."""
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\||\|$", ""), r"\|"), lambda c: strip(c))


def list_item(line: Column) -> Column:
    """struct(ordered, text) of a ``- item`` or ``1. item`` line; NULL for other lines."""
    text = F.regexp_extract(line, r"^\s*(?:-|\d+\.)\s+(.*)$", 1)
    return F.when(line.rlike(r"^\s*(?:-|\d+\.)\s+"), F.struct(line.rlike(r"^\s*\d").alias("ordered"), strip(text).alias("text")))


_MONTHS = ("Jan", "Fév", "Mar", "Avr", "Mai", "Juin", "Juil", "Août", "Sep", "Oct", "Nov", "Déc")


def month_label(month: Column) -> Column:
    """``2024-03`` as ``Mar 24``."""
    return F.concat(F.get(F.array(*map(F.lit, _MONTHS)), F.substring(month, 6, 2).cast("int") - 1), F.lit(" "), F.substring(month, 3, 2))


def compact_number(n: Column) -> Column:
    """1234 as ``1.2k``, 2500000 as ``2.5M``."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fk", n / 1_000)).otherwise(n.cast("string"))


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda v: strip(v)), lambda v: v != "")


def is_number(text: Column) -> Column:
    return strip(text).rlike("^[0-9]+$")


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two of half its digits."""
    scaled = x * F.lit(134217729.0)
    high = scaled - (scaled - x)
    return high, x - high


def half_even(x: Column, digits: int) -> Column:
    """The exact binary value rounded to ``digits`` decimals, halves to even: 2.675 is below its half and gives 2.67.

    The product with the power of ten is rounded; what it misses is computed exactly, from
    halves of both factors, and decides with the fraction on which side of a half it lies.
    """
    scale = 10.0**digits
    split = scale * 134217729.0
    scale_high = split - (split - scale)
    scale_low = scale - scale_high
    size = F.abs(x.cast("double"))
    high, low = _halves(size)
    product = size * F.lit(scale)
    missed = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product).cast("double")
    beyond = (product - whole - 0.5) + missed
    up = (beyond > 0) | ((beyond == 0) & (F.pmod(whole, F.lit(2.0)) == 1))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(product < 2.0**51, rounded * F.when(x < 0, -1.0).otherwise(1.0)).otherwise(x.cast("double"))
