"""Quality classifier with hierarchical empirical Bayes.

A logistic model on whole-text statistics gives each document its evidence p. Sites have
two levels, host and path below it. documents has no URL, so ``source`` stands in for the
host and ``lang`` for the path: path posteriors are per source and language. Each level has
its posterior mean

    rate(site) = (sum of p over the site + k * rate(parent)) / (n + k)

where the parent of a host is the whole corpus. The strength k of each level's prior is the
variance of p within sites over the variance of sites around their parents, both by the
moments of a nested analysis of variance: alike sites shrink fully, unlike ones hardly, and
a sparse site leans on its parent. A document is judged by what the *others* of its host
and path say: its own p is left out of both rates, so that no evidence counts twice. Its
score adds to its own log-odds those of its path's rate beyond the corpus; it is kept if the
score is at least ``KEEP``.

All sums are grouped aggregates that combine on the map side; paths are summed once and
hosts from paths, so a hot host is one row by then. The model is fitted on a bounded,
hash-chosen sample of labelled rows (``SAMPLE``) outside fold 1.

Edge cases. Null and empty texts have the evidence of zero statistics; null host or path
is a site of its own; a site of one document has its parent's rate. Very long texts are
read whole, one at a time. Without labelled rows of both kinds p is 0.5 and all are kept.
Repeated rows each count and are scored alike; a score that ties with ``KEEP`` is kept. Of
labels that repeat a document the lowest quality holds, null labels are left out. Further
columns are carried by :func:`keep_good`, under whatever names, and ignored by
:func:`scored`. No rows in, no rows out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.tables import fold, table
from tidewell.llm.textstats import FIELDS, with_statistics
from tidewell.sampling import hash_sample
from tidewell.skew import attach
from tidewell.storage import materialize

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
KEEP = 0.5
#: Bounds of a prior's strength, in documents; the upper one stands for sites that differ by chance alone.
STRENGTH = (1.0, 1e6)
_EPS = 1e-6


def features() -> list[Column]:
    """Columns of the model, from the columns FIELDS."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(chars / words),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(100 * F.col("n_dup_lines") / lines),
        F.log1p(100 * F.col("n_repeat_words") / words),
        F.log1p(100 * F.col("n_echoes") / words),
        F.log1p(100 * F.col("n_digits") / chars),
        F.log1p(100 * F.col("n_stops") / words),
        F.log(words / lines),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept on the raw scale, by Newton steps on standardised columns."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def fit_evidence(docs: DataFrame, labels: DataFrame) -> tuple[list[float], float]:
    """The document model, from at most SAMPLE labelled rows outside fold 1."""
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id")) != 1).groupBy(F.col("doc_id").alias("__labelled")).agg(F.min("quality").alias("__quality"))
    chosen = hash_sample(chosen, "__labelled", SAMPLE)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__labelled")).dropDuplicates(["doc_id"])
    stats = with_statistics(some, ["__quality"])
    rows = stats.select(F.array(*features()).alias("x"), "__quality").limit(SAMPLE).toPandas()
    if rows["__quality"].nunique() < 2:
        return [0.0] * len(features()), 0.0
    w, b = fit_logistic(np.array(rows["x"].tolist()), rows["__quality"].to_numpy(float))
    return w.tolist(), b


def evidence(model: tuple[list[float], float]) -> Column:
    """p: that the document is good, by its own text."""
    weights, bias = model
    z = F.lit(bias)
    for w, x in zip(weights, features()):
        z = z + F.lit(w) * x
    return F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(_EPS)), F.lit(1 - _EPS))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(within: float, rows: int, sites: int, parents: int, between: float, spread: float) -> float:
    """Prior strength by moments.

    ``within`` and ``between`` are sums of squares inside sites and of sites around their
    parents; ``spread`` is the rows less, for each parent, the sum of its sites' squared
    rows over its rows.
    """
    if rows <= sites or sites <= parents or spread <= 0:
        return STRENGTH[1]
    inside = within / (rows - sites)
    beyond = (between - (sites - parents) * inside) / spread
    return min(max(inside / beyond, STRENGTH[0]), STRENGTH[1]) if beyond > 0 else STRENGTH[1]


@dataclass
class Hierarchy:
    """Sums of each path and its host, one row a path, and what is known of all."""

    sites: DataFrame
    corpus: float
    host_strength: float
    path_strength: float

    def host_rate(self, own: Column | float = 0.0, count: int = 0) -> Column:
        """Posterior mean of the host, without ``count`` documents whose evidence sums to ``own``."""
        return (F.col("host_s") - own + self.host_strength * self.corpus) / (F.col("host_n") - count + self.host_strength)

    def path_rate(self, own: Column | float = 0.0, count: int = 0) -> Column:
        return (F.col("s") - own + self.path_strength * self.host_rate(own, count)) / (F.col("n") - count + self.path_strength)

    def score(self) -> Column:
        """Own log-odds, and what the rest of the path says beyond the corpus."""
        site = F.least(F.greatest(self.path_rate(F.col("p"), 1), F.lit(_EPS)), F.lit(1 - _EPS))
        return 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(site) - F.lit(math.log(self.corpus / (1 - self.corpus))))))


def hierarchy(judged: DataFrame, host: str = "source", path: str = "lang") -> Hierarchy:
    """Site sums and prior strengths from the evidence ``p`` of every document."""
    sums = judged.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    at_host = Window.partitionBy(host)
    paths = materialize(sums.select("*", F.sum("n").over(at_host).alias("host_n"), F.sum("s").over(at_host).alias("host_s"), F.row_number().over(at_host.orderBy(path)).alias("first")), "quality-paths")
    n, s, mean = F.col("n"), F.col("s"), F.col("host_s") / F.col("host_n")
    whole = paths.agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.count(F.lit(1)).alias("paths"),
        F.count_if(F.col("first") == 1).alias("hosts"),
        F.sum(s * s / n).alias("of_paths"),
        F.sum(F.when(F.col("first") == 1, F.col("host_s") * mean)).alias("of_hosts"),
        F.sum(n * n / F.col("host_n")).alias("path_sizes"),
        F.sum(F.when(F.col("first") == 1, F.col("host_n") * F.col("host_n"))).alias("host_sizes"),
    ).first()
    if not whole["n"]:
        return Hierarchy(paths, 0.5, *STRENGTH)
    rows, corpus = whole["n"], min(max(whole["s"] / whole["n"], _EPS), 1 - _EPS)
    of_corpus = whole["s"] ** 2 / rows
    for_host = _strength(whole["q"] - whole["of_hosts"], rows, whole["hosts"], 1, whole["of_hosts"] - of_corpus, rows - whole["host_sizes"] / rows)
    for_path = _strength(whole["q"] - whole["of_paths"], rows, whole["paths"], whole["hosts"], whole["of_paths"] - whole["of_hosts"], rows - whole["path_sizes"])
    return Hierarchy(paths, corpus, for_host, for_path)


_SITE = ("host_n", "host_s", "s", "n")


def with_scores(judged: DataFrame, known: Hierarchy, host: str, path: str, total: int, salt: str) -> DataFrame:
    """Add host_rate, path_rate (both without the row itself) and score to rows with ``p``."""
    sites = known.sites.select(host, path, "host_n", "host_s", "s", "n", F.col("n").alias("__weight"))
    out = attach(judged, sites, [host, path], "__weight", total, [salt])
    rates = out.withColumns({"host_rate": known.host_rate(F.col("p"), 1), "path_rate": known.path_rate(F.col("p"), 1), "score": known.score()})
    return rates.drop(*_SITE)


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, p, host_rate, path_rate, score, keep for every row of ``docs``."""
    model = fit_evidence(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long"), "text", F.col(host).alias("host"), F.col(path).alias("path"))
    judged = materialize(with_statistics(slim, ["doc_id", "host", "path"]).withColumn("p", evidence(model)).drop(*FIELDS), "quality-evidence")
    out = with_scores(judged, hierarchy(judged, "host", "path"), "host", "path", judged.count(), "doc_id")
    return out.select("doc_id", "p", "host_rate", "path_rate", "score", (F.col("score") >= KEEP).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns.

    Statistics are computed again for the final pass: whole texts are then filtered where
    they lie and never shuffled, unless there are too many paths to broadcast.
    """
    model = fit_evidence(docs, labels)
    slim = docs.select("text", F.col(host).alias("host"), F.col(path).alias("path"))
    judged = with_statistics(slim, ["host", "path"]).withColumn("p", evidence(model)).select("host", "path", "p")
    known = hierarchy(judged, "host", "path")
    total = known.sites.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col("text"), F.xxhash64("doc_id", "text").alias("__salt"), F.col(host).alias("host"), F.col(path).alias("path"))
    again = with_statistics(row, ["__row", "__salt", "host", "path"]).withColumn("p", evidence(model)).drop(*FIELDS)
    out = with_scores(again, known, "host", "path", total, "__salt").filter(F.col("score") >= KEEP)
    return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
