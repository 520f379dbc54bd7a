"""URL filters by a bit-parallel wildcard automaton.

Every rule becomes a glob over a canonical URL, and all globs are packed side by side into
the bits of a multiword Shift-And automaton: one bit per state, a mask per byte that lets
states advance and a mask per byte for states that wait in a wildcard. One step per
character advances all rules at once, over all URLs of a batch together.

A canonical URL is ``.host/path?query#fragment`` with the host's A-Z in lower case and every
byte outside printable ASCII percent-encoded. Site rules read it up to the path; keyword
globs read all of it, with A-Z in lower case throughout. In globs ``*`` stands for any
characters, ``+`` for any but ``/`` (so a host part never matches inside a path) and ``?``
for one character.

A site rule ``net/`` is the glob ``+.net/*``: the host itself, as the canonical URL starts
with a dot, or any subdomain. Of the site rules that match, the longest decides (the first
of equals). Without one, the keyword globs do: one that matches blocks, the rest is allowed.
Rules are data: :func:`rules_of` reads them from a table.

Edge cases. A null URL, or one without ``://``, has empty host and path, matches no rule and
is allowed. An empty path matches no site rule, as rules' paths start with ``/``. Very long
URLs are read whole. Ties: see above. Repeated rows are judged alike, other columns are
ignored, and no rows in gives no rows out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote_from_bytes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The production site rules: (verdict, rule).
SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules that a table may hold; its automaton travels to every task.
MAX_RULES = 50_000
#: Globs that block what no site rule decides; lower case.
KEYWORD_GLOBS = ("*casino*", "*free-bets*", "*adult-*", "*porn*", "*xxx*", "*warez*", "*viagra*", "*-pills*", "*spam*", "*ads-track*", "*/cgi-bin/*")

#: URLs whose automata advance together, and words that their states take at most.
_TOGETHER, _STATE_WORDS = 8192, 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
_SAFE = "".join(chr(c) for c in range(33, 127))


_ANY_BYTE, _BUT_SLASH, _NO_BYTE = np.arange(256), np.array([k for k in range(256) if k != ord("/")]), np.arange(0)


class ShiftAnd:
    """All globs in one multiword Shift-And automaton."""

    def __init__(self, globs: Sequence[str]):
        states = []  # [bytes that lead in, bytes it waits on], a glob's states in order
        self.final = []
        for glob in globs:
            states.append([_NO_BYTE, _NO_BYTE])
            for ch in glob:
                if ch == "*":
                    states[-1][1] = _ANY_BYTE
                elif ch == "+":
                    states[-1][1] = _ANY_BYTE if states[-1][1] is _ANY_BYTE else _BUT_SLASH
                else:
                    states.append([_ANY_BYTE if ch == "?" else ord(ch), _NO_BYTE])
            self.final.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.wait = np.zeros((256, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        ends = set(self.final)
        for k, (lead, stay) in enumerate(states):
            bit = np.uint64(1) << np.uint64(k % 64)
            for table, chars in ((self.enter, lead), (self.wait, stay)):
                if chars is not _NO_BYTE:
                    table[chars, k // 64] |= bit
            if k == 0 or k - 1 in ends:
                self.first[k // 64] |= bit

    def _blocks(self, urls: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(first of some URLs, their (urls, globs) booleans): as many at a time as their states leave room for."""
        step = max(1, min(_TOGETHER, _STATE_WORDS // self.words))
        for low in range(0, len(urls), step):
            yield low, self._match(urls[low : low + step])

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """(urls, globs) booleans, for a few globs."""
        out = np.zeros((len(urls), len(self.final)), bool)
        for low, found in self._blocks(urls):
            out[low : low + len(found)] = found
        return out

    def first_match(self, urls: Sequence[bytes]) -> np.ndarray:
        """Place of the first glob that each URL matches, -1 if none does."""
        out = np.full(len(urls), -1)
        if self.final:
            for low, found in self._blocks(urls):
                out[low : low + len(found)] = np.where(found.any(axis=1), found.argmax(axis=1), -1)
        return out

    def _match(self, urls: Sequence[bytes]) -> np.ndarray:
        length = np.array([len(u) for u in urls])
        order = np.argsort(-length, kind="stable")  # the longest first: those still running are a prefix
        length = length[order]
        text = np.frombuffer(b"".join(urls[k] for k in order), np.uint8)
        start = np.cumsum(length) - length
        state = np.tile(self.first, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        running = len(urls)
        for at in range(int(length.max(initial=0))):
            while running and length[running - 1] <= at:
                running -= 1
            now = state[:running]
            char = text[start[:running] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:running] = (moved & self.enter[char]) | (now & self.wait[char])
        final = np.array(self.final)
        found = (state[:, final // 64] >> (final % 64).astype(np.uint64)) & one
        out = np.empty(found.shape, bool)
        out[order] = found.astype(bool)
        return out


def canonical(*parts: str) -> bytes:
    return b"." + quote_from_bytes("".join(parts).encode("utf-8", "surrogatepass"), safe=_SAFE).encode()


class Filter:
    """Site rules and keyword globs, judged together."""

    def __init__(self, site_rules=SITE_RULES, block_globs=KEYWORD_GLOBS):
        def literal(text: str) -> str:
            if re.search(r"[*+?]", text):
                raise ValueError(f"a site rule holds no wildcards: {text}")
            return canonical(text).decode()[1:]

        ranked = sorted(enumerate(site_rules), key=lambda x: (-len(x[1][1]), x[0]))
        self.rules = [rule for _, (_, rule) in ranked]
        self.verdicts = [verdict for _, (verdict, _) in ranked]
        self.sites = ShiftAnd(["+." + literal(r) + "*" for r in self.rules])
        self.keywords = ShiftAnd([g.lower() for g in block_globs])

    def judge(self, hosts: Sequence[str], paths: Sequence[str], rests: Sequence[str]) -> tuple[list[str | None], list[str]]:
        """The deciding rule (or None) and the verdict for the parts of each URL."""
        if not len(hosts):
            return [], []
        best = self.sites.first_match([canonical(h, p) for h, p in zip(hosts, paths)])
        verdicts = [self.verdicts[k] if k >= 0 else "allow" for k in best]
        open_ = np.flatnonzero(best < 0)
        blocked = self.keywords.first_match([canonical(hosts[k], paths[k], rests[k]).lower() for k in open_]) >= 0
        for k in open_[blocked]:
            verdicts[k] = "block"
        return [self.rules[k] if k >= 0 else None for k in best], verdicts


def rules_of(rules: DataFrame) -> Filter:
    """The filter of a table (kind, verdict, rule): ``site`` rules with their verdicts, ``keyword`` globs that block.

    At most ``MAX_RULES``, which is checked; rules keep the order of their text.
    """
    rows = rules.select("kind", "verdict", "rule").distinct().orderBy("rule", "kind", "verdict").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return Filter([(r["verdict"], r["rule"]) for r in rows if r["kind"] == "site"], [r["rule"] for r in rows if r["kind"] == "keyword"])


def judged(pages: DataFrame, rules: Filter | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    rules = rules or Filter()
    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url, _SPLIT, 2).alias("path"), F.regexp_extract(url, _SPLIT, 3).alias("rest"))

    def run(hosts: pd.Series, paths: pd.Series, rests: pd.Series) -> pd.DataFrame:
        rule, verdict = rules.judge(list(hosts), list(paths), list(rests))
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    verdict = F.pandas_udf(run, "rule string, verdict string")
    return parts.select("page_id", "host", "path", verdict("host", "path", "rest").alias("__v")).select("page_id", "host", "path", "__v.rule", "__v.verdict")


def op6_url_filter(pages: DataFrame) -> DataFrame:
    return judged(pages)


_RULE_SQL = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{r}'"
    for r, h, p in sorted(((r, r[: r.index("/")], r[r.index("/") :]) for _, r in SITE_RULES), key=lambda x: -len(x[0]))
)
_VERDICT_SQL = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in SITE_RULES)
_KEYWORD_SQL = " OR ".join(f"contains(whole, '{g.strip('*')}')" for g in KEYWORD_GLOBS)
ORACLE_SQL = f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         translate('.' || regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1), '{_UPPER}', '{_LOWER}') AS whole
  FROM pages
), ruled AS (
  SELECT page_id, host, path, whole, CASE {_RULE_SQL} END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE {_VERDICT_SQL} WHEN {_KEYWORD_SQL} THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
