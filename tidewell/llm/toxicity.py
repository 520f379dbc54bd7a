"""Toxicity by a weighted finite-state pattern grammar.

Four layers are composed. The *lexical* transducer reads words, several at a time where it
has an arc for a phrase, and writes one symbol with a weight: insult, threat, target,
negation, report, intent, or nothing. The *scope* transducers read these symbols, some from
the left and some from the right, and mark each insult and threat that lies in their reach:
negated (a negation up to ``REACH`` symbols before it), reported (speech reported on either
side), aimed (a target on either side) and meant (an intent before it). Composed, they are
one transducer for each direction, whose marks are joined. The *clause* layer multiplies
the weight of every insult and threat by the factors of its marks and sums the clause. The
*text* layer scores a text by its worst clause, with what the other clauses add as a lesser
term, calibrated to a probability.

Learning. Labelled rows outside fold 1, at most ``SAMPLE`` chosen by hash, teach three
things. (1) Arcs: words, word beginnings and pairs of neighbouring words that are far more
common in toxic rows than chance allows, picked as long as they explain toxic rows that no
arc before explains, so that the copies of one toxic text teach no more than the text; a
pair or word with a threat word in it is a threat, any other an insult. (2) Weights: the
log-odds of every arc, those of seed words too, which shrink towards their prior weight
where rows are few. (3) Scope factors: each is chosen from ``FACTOR_GRID`` by the likelihood
of the labels, with a prior at its default, so that labels which say nothing about a scope
leave it as it is. Only candidates, at most ``CANDIDATES``, their numbers in sampled toxic
rows, and a few numbers per sampled row reach the driver. Language, source and id are no
inputs.

Scoring is one pass: an Aho-Corasick automaton finds texts with any insult or threat, and
only these are parsed into clauses. There is no shuffle.

Edge cases. Null and empty texts score as texts without a match. Very long texts are read
whole, clause by clause; what is held is one text. Ties: candidates of equal merit are taken
in the order of length, then of significance, then of spelling; labels that repeat a
document count once, toxic if any is; null labels are left out. A row without doc_id is
never held out. With labels of one kind only, the seed words work under a fixed
calibration. Repeated rows are scored alike. Further columns are carried by
:func:`keep_clean` and ignored by :func:`scored`. No rows in, no rows out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.quality import fit_logistic
from tidewell.llm.tables import fold, table
from tidewell.sampling import hash_sample
from tidewell.storage import materialize, release, sliced

#: Labelled rows that the grammar learns from, at most.
SAMPLE = 20_000
#: Candidate patterns, at most; the surest come first.
CANDIDATES = 4_000
THRESHOLD = 0.7
#: A pattern has to occur in so many toxic rows and to exceed chance by so many standard deviations.
MIN_ROWS, MIN_SIGMA = 8, 7.0
#: A pattern has to explain so many toxic texts that no earlier one does.
MIN_NEW = 4
#: Patterns that a task counts before it hands them on.
FLUSH = 200_000
#: Lengths of word beginnings that can be learned.
BEGINNINGS = range(3, 9)

# Seed words of each class.
INSULT = ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "scum", "trash", "garbage", "loser", "losers", "pathetic", "worthless", "disgusting", "clown", "fool", "imbecile")
THREAT = ("kill", "hurt", "destroy", "murder", "attack", "beat", "beat up", "break your", "come after")
TARGET = ("you", "your", "he", "she", "they", "them", "him", "her", "these", "those", "du", "ihr", "sie", "tu", "vous", "ils", "usted", "ellos")
NEGATION = ("not", "no", "never", "nobody", "without", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "sin")
REPORT = ("said", "says", "quoted", "reported", "called", "according to", "sagte", "dit", "dijo")
INTENT = ("will", "shall", "gonna", "going to", "want to", "werde", "vais", "voy a")
#: Prior weights of seeds, in log-odds, and how many rows a prior counts for.
SEED_INSULT, SEED_THREAT, PRIOR_ROWS = 2.0, 2.0, 20.0
#: Symbols that a scope reaches.
REACH = {"negated": 3, "reported": 8, "aimed": 4, "meant": 3}
#: Factors of the marks before labels are asked; ``bare`` is that of a threat which is neither aimed nor meant.
FACTORS = {"negated": 0.5, "reported": 0.5, "aimed": 1.25, "meant": 1.25, "bare": 0.25}
#: What a factor may become.
FACTOR_GRID = {"negated": (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), "reported": (0.0, 0.1, 0.25, 0.5, 0.75, 1.0), "aimed": (1.0, 1.25, 1.5, 2.0, 3.0), "meant": (1.0, 1.25, 1.5, 2.0, 3.0), "bare": (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)}
#: Log-likelihood that leaving a default costs, for each step of the grid.
PRIOR_COST = 1.0
#: Log-odds = CALIBRATION . (1, log1p of the worst clause, log1p of the other clauses) where labels cannot set them.
FIXED_CALIBRATION = (-4.0, 3.0, 0.5)

SYMBOLS = ("insult", "threat", "target", "negation", "report", "intent")
MARKS = ("negated", "reported", "aimed", "meant")
_BIT = {m: 1 << k for k, m in enumerate(MARKS)}
_WORD = re.compile(r"\w+", re.UNICODE)
_CLAUSE = re.compile(r"[.!?;\n]+")


@dataclass
class Transducer:
    """A deterministic transducer over symbols that writes marks; a missing arc passes the symbol on unmarked.

    ``arcs[state, symbol] = (next state, marks)``; ``decay[state]`` is where a state goes
    after a symbol without an arc.
    """

    start: int
    arcs: dict[tuple[int, str], tuple[int, int]]
    decay: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        found = self.arcs.get((state, symbol))
        return found if found else (self.decay.get(state, state), 0)


def compose(*parts: Transducer) -> Transducer:
    """The product transducer: all parts read every symbol, their marks are joined."""
    start = tuple(p.start for p in parts)
    number, arcs, decay, todo = {start: 0}, {}, {}, [start]

    def known(state: tuple[int, ...]) -> int:
        if state not in number:
            number[state] = len(number)
            todo.append(state)
        return number[state]

    while todo:
        state = todo.pop()
        here = number[state]
        for symbol in (*SYMBOLS, ""):
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            to, marks = known(tuple(s for s, _ in steps)), 0
            for _, m in steps:
                marks |= m
            if symbol:
                arcs[here, symbol] = (to, marks)
            else:
                decay[here] = to
    return Transducer(0, arcs, decay)


def scope(trigger: str, mark: str) -> Transducer:
    """Insults and threats among the REACH symbols after the trigger get the mark."""
    reach = REACH[mark]
    arcs = {}
    for state in range(reach + 1):
        arcs[state, trigger] = (reach, 0)
        if state:
            for symbol in ("insult", "threat"):
                arcs[state, symbol] = (state - 1, _BIT[mark])
    return Transducer(0, arcs, {s: s - 1 for s in range(1, reach + 1)})


def scopes() -> tuple[Transducer, Transducer]:
    """The scopes read from the left, and those read from the right."""
    left = compose(scope("negation", "negated"), scope("report", "reported"), scope("target", "aimed"), scope("intent", "meant"))
    return left, compose(scope("report", "reported"), scope("target", "aimed"))


def no_scopes() -> tuple[Transducer, Transducer]:
    """Transducers that mark nothing, to see what scopes do."""
    return Transducer(0, {}), Transducer(0, {})


class Grammar:
    """The composed grammar over words.

    ``patterns`` are (text, is a beginning, weight), a text of two words being a phrase;
    they come before seeds. ``bare`` threats, neither aimed nor meant, weigh less.
    """

    def __init__(self, patterns: Sequence[tuple[str, bool, float]] = (), calibration: tuple[float, float, float] = FIXED_CALIBRATION, factors: dict[str, float] | None = None, scoped: bool = True):
        self.words: dict[str, tuple[str, float]] = {}
        self.pairs: dict[tuple[str, str], tuple[str, float]] = {}
        for symbol, seeds, weight in (("report", REPORT, 0.0), ("negation", NEGATION, 0.0), ("intent", INTENT, 0.0), ("target", TARGET, 0.0), ("threat", THREAT, SEED_THREAT), ("insult", INSULT, SEED_INSULT)):
            for seed in seeds:
                self._add(seed, symbol, weight)
        self.beginnings: dict[str, float] = {}
        for text, beginning, weight in patterns:
            if beginning:
                self.beginnings[text] = weight
            else:
                self._add(text, "threat" if set(text.split()) & _THREAT_WORDS else "insult", weight)
        self.lengths = sorted({len(b) for b in self.beginnings}, reverse=True)
        self.scopes = scopes() if scoped else no_scopes()
        self.calibration = calibration
        self.factors = FACTORS | (factors or {})
        self._finder = None

    def _add(self, text: str, symbol: str, weight: float) -> None:
        words = text.split()
        if len(words) == 2:
            self.pairs[words[0], words[1]] = (symbol, weight)
        else:
            self.words[text] = (symbol, weight)

    def __getstate__(self):
        return self.__dict__ | {"_finder": None}

    def lexical(self, words: list[str]) -> list[tuple[str, float]]:
        """One symbol and weight for each word or phrase of a clause; of arcs that begin at a word, the longest."""
        out, k = [], 0
        while k < len(words):
            found = self.pairs.get((words[k], words[k + 1])) if k + 1 < len(words) else None
            k += 2 if found else 1
            if not found:
                word = words[k - 1]
                found = self.words.get(word)
                if not found:
                    found = ("", 0.0)
                    for n in self.lengths:
                        weight = self.beginnings.get(word[:n])
                        if weight is not None:
                            found = ("insult", weight)
                            break
            out.append(found)
        return out

    def may_match(self, text: str) -> bool:
        """Whether lower-case ``text`` spells an insult or threat, if only inside a word or the first word of a phrase."""
        if self._finder is None:
            finder = ahocorasick.Automaton()
            spelled = [w for w, (symbol, _) in self.words.items() if symbol in ("insult", "threat")] + [a for (a, _), (symbol, _) in self.pairs.items() if symbol in ("insult", "threat")]
            for w in [*spelled, *self.beginnings]:
                finder.add_word(w, 1)
            finder.make_automaton()
            self._finder = finder
        return next(self._finder.iter(text), None) is not None

    def matches(self, words: list[str]) -> list[tuple[str, float, int]]:
        """(symbol, weight, marks) of each insult and threat of a clause."""
        symbols = self.lexical(words)
        if not any(s in ("insult", "threat") for s, _ in symbols):
            return []
        left, right = self.scopes
        marks = [0] * len(symbols)
        for part, order in ((left, range(len(symbols))), (right, range(len(symbols) - 1, -1, -1))):
            state = part.start
            for k in order:
                state, found = part.step(state, symbols[k][0])
                marks[k] |= found
        return [(s, w, m) for (s, w), m in zip(symbols, marks) if s in ("insult", "threat")]

    def factor(self, symbol: str, marks: int, factors: dict[str, float] | None = None) -> float:
        factors = factors or self.factors
        out = factors["bare"] if symbol == "threat" and not marks & (_BIT["aimed"] | _BIT["meant"]) else 1.0
        for mark, bit in _BIT.items():
            if marks & bit:
                out *= factors[mark]
        return out

    def clauses(self, text: str | None) -> list[list[tuple[str, float, int]]]:
        """The matches of each clause that has any, of one whole text."""
        lower = (text or "").lower()
        if not lower or not self.may_match(lower):
            return []
        return [found for piece in _CLAUSE.split(lower) if piece and self.may_match(piece) and (found := self.matches(_WORD.findall(piece)))]

    def weigh(self, clauses: list[list[tuple[str, float, int]]], factors: dict[str, float] | None = None) -> tuple[float, float]:
        """(worst clause, sum of the others)."""
        worst = total = 0.0
        for found in clauses:
            weight = sum(w * self.factor(s, m, factors) for s, w, m in found)
            worst = max(worst, weight)
            total += max(weight, 0.0)
        return worst, total - worst

    def score(self, worst: float, others: float) -> float:
        a, b, c = self.calibration
        z = a + b * math.log1p(worst) + c * math.log1p(others)
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

    def score_text(self, text: str | None) -> float:
        return self.score(*self.weigh(self.clauses(text)))


_THREAT_WORDS = {w for seed in THREAT for w in seed.split()[:1]}


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE labelled rows outside fold 1, chosen by hash; stored."""
    chosen = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id")) != 1).groupBy(F.col("doc_id").alias("__labelled")).agg(F.max("toxic").alias("toxic"))
    chosen = hash_sample(chosen, "__labelled", SAMPLE)
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__labelled"))
    return materialize(some.groupBy("text").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "toxicity-sample")  # copies count once


def learned_patterns(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """Seeds, words, beginnings and pairs with their log-odds: every seed, and what marks toxic rows."""
    ends = sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in ends}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return []

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())
        for batch in sliced(batches):
            for text, label in zip(batch["text"], batch["toxic"]):
                counts[label].update(_spelled(text))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield _table(counts)
                    counts = (Counter(), Counter())
        if counts[0] or counts[1]:  # a table of no rows has no kinds of columns
            yield _table(counts)

    rows = materialize(sample.mapInPandas(count, "pattern string, clean long, toxic long").groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-patterns")
    share = toxic / (toxic + clean)
    both = F.col("clean") + F.col("toxic")
    sigma = (F.col("toxic") - both * share) / F.sqrt(both * share * (1 - share))
    likely = rows.filter((F.col("toxic") >= MIN_ROWS) & (sigma >= MIN_SIGMA) & (F.col("toxic") >= 0.5 * both))
    top = likely.orderBy(sigma.desc(), "pattern").limit(CANDIDATES).collect()
    seeds = dict.fromkeys(INSULT, SEED_INSULT) | dict.fromkeys(THREAT, SEED_THREAT)
    counted = {r["pattern"]: r for r in rows.filter(F.col("pattern").isin(*seeds)).collect()}  # a row for each seed
    release(rows)
    names = [r["pattern"] for r in top]
    number = {p: k for k, p in enumerate(names)}

    def occur(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            yield pd.DataFrame({"found": [sorted(number[p] for p in _spelled(t) if p in number) for t in batch["text"]]})

    found = sample.filter("toxic = 1").mapInPandas(occur, "found array<int>").limit(SAMPLE).collect()
    picked = explaining([r["found"] for r in found], [r["toxic"] / (r["toxic"] + r["clean"] + 1) for r in top], [len(p) for p in names])

    def log_odds(r) -> float:
        return min(math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (clean + 1)), 8.0)

    out = {}
    for seed, prior in seeds.items():
        if seed in counted:
            rows_with = counted[seed]["toxic"] + counted[seed]["clean"]
            out[seed, False] = max((rows_with * log_odds(counted[seed]) + PRIOR_ROWS * prior) / (rows_with + PRIOR_ROWS), 0.0)
    for k in picked:
        out.setdefault((names[k].rstrip("*"), names[k].endswith("*")), log_odds(top[k]))
    return [(text, beginning, weight) for (text, beginning), weight in out.items()]


def _spelled(text: str) -> set[str]:
    """The words of a text, their beginnings marked by a star, and neighbours within a clause."""
    out: set[str] = set()
    for piece in _CLAUSE.split(text.lower()):
        words = _WORD.findall(piece)
        out.update(words)
        out.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    return out | {w[:k] + "*" for w in out if " " not in w for k in BEGINNINGS if len(w) >= k}


def _table(counts: tuple[Counter, Counter]) -> pd.DataFrame:
    keys = list(counts[0].keys() | counts[1].keys())
    return pd.DataFrame({"pattern": keys, "clean": [counts[0][k] for k in keys], "toxic": [counts[1][k] for k in keys]})


def explaining(rows: list[list[int]], precision: list[float], length: list[int]) -> list[int]:
    """Sequential covering: numbers of the patterns that each explain MIN_NEW more rows, best first.

    ``rows`` lists the candidates in each toxic text. Among equals the longest is taken.
    """
    holds: dict[int, set[int]] = {}
    for k, found in enumerate(rows):
        for c in found:
            holds.setdefault(c, set()).add(k)
    picked = []
    while holds:
        best = max(holds, key=lambda c: (len(holds[c]) * precision[c] ** 4, length[c], -c))
        new = holds.pop(best)
        if len(new) < MIN_NEW:
            break
        picked.append(best)
        holds = {c: left for c, have in holds.items() if len(left := have - new) >= MIN_NEW}
    return picked


def calibrated(worst: np.ndarray, others: np.ndarray, toxic: np.ndarray) -> tuple[tuple[float, float, float], float]:
    """Calibration and log-likelihood: the worst clause leads, other clauses weigh at most half as much."""
    x = np.c_[np.log1p(worst), np.log1p(others)]
    weights, bias = fit_logistic(x, toxic)
    if weights[0] <= 0 or not 0 <= weights[1] <= weights[0] / 2:
        lesser = 0.5 if weights[1] > 0 else 0.0
        one, bias = fit_logistic((x[:, 0] + lesser * x[:, 1])[:, None], toxic)
        weights = np.array([max(float(one[0]), 0.0), lesser * max(float(one[0]), 0.0)])
    p = np.clip(1 / (1 + np.exp(-np.clip(bias + x @ weights, -30, 30))), 1e-9, 1 - 1e-9)
    return (float(bias), float(weights[0]), float(weights[1])), float((toxic * np.log(p) + (1 - toxic) * np.log(1 - p)).sum())


def learn(docs: DataFrame, labels: DataFrame, scoped: bool = True) -> Grammar:
    """The grammar with arcs, weights, scope factors and calibration from the labelled sample."""
    sample = labelled_sample(docs, labels)
    grammar = Grammar(learned_patterns(sample), scoped=scoped)
    trials = [{}] + [{name: value} for name, values in FACTOR_GRID.items() for value in values if value != FACTORS[name]]

    def measured(trials: list[dict[str, float]]) -> pd.DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in sliced(batches):
                found = [grammar.clauses(t) for t in batch["text"]]
                both = [[grammar.weigh(f, grammar.factors | t) for t in trials] for f in found]
                yield pd.DataFrame({"worst": [[w for w, _ in b] for b in both], "others": [[o for _, o in b] for b in both], "toxic": batch["toxic"]})

        return sample.mapInPandas(run, "worst array<double>, others array<double>, toxic int").limit(SAMPLE).toPandas()

    rows = measured(trials)
    if rows["toxic"].nunique() == 2:
        worst, others, toxic = np.array(rows["worst"].tolist()), np.array(rows["others"].tolist()), rows["toxic"].to_numpy(float)
        likelihood = [calibrated(worst[:, k], others[:, k], toxic)[1] for k in range(len(trials))]
        for name, values in FACTOR_GRID.items():
            gain = {value: likelihood[trials.index({name: value})] - likelihood[0] - PRIOR_COST * abs(values.index(value) - values.index(FACTORS[name])) for value in values if value != FACTORS[name]}
            best = max(gain, key=gain.get)
            if gain[best] > 0:
                grammar.factors[name] = best
        chosen = measured([{}])
        grammar.calibration, _ = calibrated(np.array([w[0] for w in chosen["worst"]]), np.array([o[0] for o in chosen["others"]]), chosen["toxic"].to_numpy(float))
    release(sample)
    return grammar


def score_column(grammar: Grammar, text="text"):
    """Column of scores; the grammar travels with the function."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score_text(t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")(F.coalesce(F.col(text), F.lit("")))


def scored(docs: DataFrame, labels: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; the grammar is learned unless given."""
    grammar = grammar or learn(docs, labels)
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), score_column(grammar).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted clean, with their columns."""
    grammar = learn(docs, labels)
    return docs.filter(score_column(grammar) < THRESHOLD)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
