"""Quality rules with robust multivariate outliers.

Two fixed rules come first: a document fails with fewer than ``MIN_WORDS`` words, or when
more than 30 % of its words lie in repeated 8-word windows. Each other document is judged
against those of its own language and source that pass: a minimum-covariance-determinant
estimate of the transformed statistics, and a cut on the squared Mahalanobis distance.

The estimate covers every passing row, without subsamples. Each group has three starts:
medians and MADs, the moments of values clamped to two MADs, and plain moments. From each,
concentration steps lead on: distances under the present estimate are counted in fine
logarithmic bins with the sums and cross products of each bin, and the innermost bins that
hold the share ``CORE`` of a group make the next estimate. After ``FIRST_STEPS`` the start
with the least determinant is kept in each group, and each group goes on until its log
determinant no longer falls by ``TOLERANCE``; groups that have come to their end leave the
next step. One step is one aggregation that combines on the map side, so a source with a
third of all rows costs no task more than its share. At the end distances are scaled by
their median, outwards only.

Variances are as estimated. A statistic that is the same for half of a group's documents or
more (most clean texts have no symbol or repeated line at all) has no spread to estimate: a
core of equal values would put any other infinitely far. Such a flat statistic is no axis
of that group's estimate, and a document is rejected if it departs from the common value by
more than ``FLAT_LIMITS``. Distances on the other axes are cut at ``SPREAD`` times the
0.9995 quantile of chi-square with as many degrees of freedom, since lengths of texts and
words have longer tails than a normal law.

Groups with fewer than ``MIN_GROUP`` passing rows are pooled with the small groups of their
language, and if those are few too, with all that is left.

Edge cases. Null text: no words, so the base rules fail it. Null language or source form a
group of their own. Rows that fail the base rules have no distance. Very long texts are
read whole. Ties: rows at equal distance lie in one bin and are in the core together; a
distance of exactly the cut is kept; of starts with equal determinants the first named is
taken. A group whose documents are all alike has no axis left and keeps what is like them. Repeated rows are judged each. Columns beyond doc_id, text, lang and source are
ignored. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.textstats import with_statistics
from tidewell.skew import attach
from tidewell.storage import materialize, release

MIN_WORDS = 20
MIN_GROUP = 50
CORE = 0.75
#: Concentration steps that every start takes.
FIRST_STEPS = 2
#: Fall of the log determinant below which an estimate has converged.
TOLERANCE = 0.001
#: Bins in a doubling of the squared distance.
BINS = 64
#: The 0.9995 quantile and the median of chi-square with 0 to 6 degrees of freedom.
CHI2_TAIL = (0.0, 12.116, 15.202, 17.730, 19.997, 22.105, 24.103)
CHI2_MEDIAN = (1.0, 0.4549, 1.3863, 2.3660, 3.3567, 4.3515, 5.3481)
#: Times the quantile up to which a document is kept.
SPREAD = 2.5
#: Share of equal values from which a statistic is flat.
FLAT = 0.5
#: Departures from the common value up to which a flat statistic is accepted: log words, log word length, log1p of percent symbols (10 %), repeated lines and repeated words (80 %), words equal to the one before (20 %).
FLAT_LIMITS = (3.0, 0.5, 2.4, 4.4, 4.4, 3.0)
_P = len(FLAT_LIMITS)
_V = [f"v{k}" for k in range(_P)]
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def _share(part: str, whole: str) -> Column:
    return F.log1p(100 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))


def transformed(stats: DataFrame) -> DataFrame:
    """Add v0..v5: the statistics on scales where clean texts lie close together."""
    return stats.select(
        "*",
        F.log1p("n_words").alias("v0"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))).alias("v1"),
        _share("n_symbols", "word_chars").alias("v2"),
        _share("n_dup_lines", "n_lines").alias("v3"),
        _share("n_repeat_words", "n_words").alias("v4"),
        _share("n_echoes", "n_words").alias("v5"),
    )


def _pooled(rows: DataFrame, total: int) -> DataFrame:
    """Add ``grp``: (lang, source), or what it is pooled with."""
    sizes = materialize(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "outliers-sizes")
    own = F.concat_ws("\x01", F.coalesce("lang", F.lit("\x02")), F.coalesce("source", F.lit("\x02")))
    by_lang = F.concat_ws("\x01", F.coalesce("lang", F.lit("\x02")), F.lit("\x03"))
    small = F.sum(F.when(F.col("n") < MIN_GROUP, F.col("n"))).over(Window.partitionBy("lang"))
    named = sizes.withColumn("__small", small).select("lang", "source", "n", F.when(F.col("n") >= MIN_GROUP, own).when(F.col("__small") >= MIN_GROUP, by_lang).otherwise(F.lit("\x03")).alias("grp"))
    return attach(rows, named, ["lang", "source"], "n", total)


#: ``flat`` has a bit for each flat statistic.
_MODEL = "grp string, start int, n long, flat int, mean array<double>, precision array<double>, logdet double"


def _invert(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From n, k and the sums of the core to its mean, inverse scatter and log determinant."""
    for batch in rows:
        out = []
        for r in batch.to_dict("records"):
            mean = np.array([r[f"s{i}"] for i in range(_P)]) / r["k"]
            scatter = np.empty((_P, _P))
            for i, j in _PAIRS:
                scatter[i, j] = scatter[j, i] = r[f"c{i}_{j}"] / r["k"] - mean[i] * mean[j]
            out.append((r["grp"], r["start"], r["n"], r["flat"], mean.tolist(), *inverted(scatter, r["flat"])))
        yield pd.DataFrame(out, columns=["grp", "start", "n", "flat", "mean", "precision", "logdet"])


def inverted(scatter: np.ndarray, flat: int) -> tuple[list[float], float]:
    """Inverse and log determinant of a scatter over the axes that are not flat; the others get zeros."""
    axes = [k for k in range(_P) if not flat >> k & 1]
    whole = np.zeros((_P, _P))
    if not axes:
        return whole.ravel().tolist(), 0.0
    own = scatter[np.ix_(axes, axes)]
    own = own + np.diag(1e-9 * np.maximum(np.diag(own), 1e-9))  # for axes that depend on each other
    whole[np.ix_(axes, axes)] = np.linalg.inv(own)
    return whole.ravel().tolist(), float(np.linalg.slogdet(own)[1])


def is_flat(k: int) -> Column:
    return F.col("flat").bitwiseAND(F.lit(1 << k)) != 0


def by_axes(values: tuple[float, ...]) -> Column:
    """The value for as many axes as are not flat."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), _P + 1 - F.bit_count("flat"))


def squared_distance() -> Column:
    """Mahalanobis distance of v0..v5 under the columns ``mean`` and ``precision``."""
    off = [F.col(v) - F.col("mean")[k] for k, v in enumerate(_V)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1 if i == j else 2) * F.col("precision")[i * _P + j] * off[i] * off[j]
    return F.greatest(total, F.lit(0.0))


def _sums() -> list[Column]:
    return [F.sum(v).alias(f"s{k}") for k, v in enumerate(_V)] + [F.sum(F.col(_V[i]) * F.col(_V[j])).alias(f"c{i}_{j}") for i, j in _PAIRS]


_NAMES = [f"s{k}" for k in range(_P)] + [f"c{i}_{j}" for i, j in _PAIRS]


def starts(rows: DataFrame, total: int) -> DataFrame:
    """The three starts of each group of ``rows`` (stored, with grp and v0..v5): 0 medians and MADs, 1 clamped moments, 2 moments; stored."""
    middle = [F.percentile_approx(v, 0.5, 10000).alias(f"m{k}") for k, v in enumerate(_V)]
    centre = materialize(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *middle), "outliers-centre")
    near = attach(rows.select("grp", *_V), centre, ["grp"], "n", total)
    spread = near.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.first(f"m{k}").alias(f"m{k}") for k in range(_P)],
        *[F.percentile_approx(F.abs(F.col(v) - F.col(f"m{k}")), 0.5, 10000).alias(f"d{k}") for k, v in enumerate(_V)],
        *[F.count_if(F.col(v) == F.col(f"m{k}")).alias(f"e{k}") for k, v in enumerate(_V)],
    )
    flat = sum((F.when((F.col(f"e{k}") >= FLAT * F.col("n")) | (F.col(f"d{k}") <= 0), 1 << k).otherwise(0) for k in range(1, _P)), F.when((F.col("e0") >= FLAT * F.col("n")) | (F.col("d0") <= 0), 1).otherwise(0))
    scales = materialize(spread.select("grp", "n", flat.cast("int").alias("flat"), *[f"m{k}" for k in range(_P)], *[(1.4826 * F.col(f"d{k}")).alias(f"d{k}") for k in range(_P)]), "outliers-scales")
    diagonal = F.array(*[F.when(~is_flat(i), F.try_divide(F.lit(1.0), F.col(f"d{i}") * F.col(f"d{i}"))).otherwise(0.0) if i == j else F.lit(0.0) for i in range(_P) for j in range(_P)])
    logdet = F.lit(0.0)
    for k in range(_P):
        logdet = logdet + F.when(~is_flat(k), 2 * F.log(F.col(f"d{k}"))).otherwise(0.0)
    first = scales.select("grp", F.lit(0).alias("start"), "n", "flat", F.array(*[f"m{k}" for k in range(_P)]).alias("mean"), diagonal.alias("precision"), logdet.alias("logdet"))
    scaled = attach(rows.select("grp", *_V), scales, ["grp"], "n", total)
    counts = (F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("k"))
    plain = scaled.groupBy("grp", "flat").agg(*counts, *_sums()).withColumn("start", F.lit(2))
    clamped = scaled.select("grp", "flat", *[F.least(F.greatest(F.col(v), F.col(f"m{k}") - 2 * F.col(f"d{k}")), F.col(f"m{k}") + 2 * F.col(f"d{k}")).alias(v) for k, v in enumerate(_V)])
    clamped = clamped.groupBy("grp", "flat").agg(*counts, *_sums()).withColumn("start", F.lit(1))
    out = materialize(first.unionByName(clamped.unionByName(plain).mapInPandas(_invert, _MODEL)), "outliers-starts")
    release(centre, scales)
    return out


def step(rows: DataFrame, now: DataFrame, total: int) -> DataFrame:
    """One concentration step of every (grp, start) of ``now``; stored. Rows of other groups take no part."""
    each = now.groupBy("grp", "flat").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("start", "mean", "precision"))).alias("starts"))  # three at most
    placed = attach(rows.select("grp", *_V), each, ["grp"], "n", total).select("grp", "flat", *_V, F.explode("starts").alias("__s")).select("grp", "flat", *_V, "__s.*")
    bins = placed.withColumn("__bin", F.floor(F.log2(squared_distance() + 1e-6) * BINS)).groupBy("grp", "flat", "start", "__bin").agg(F.count(F.lit(1)).alias("k"), *_sums())
    inner = Window.partitionBy("grp", "start").orderBy("__bin")  # a row for each bin
    bins = bins.withColumn("__n", F.sum("k").over(Window.partitionBy("grp", "start"))).withColumn("__before", F.sum("k").over(inner) - F.col("k"))
    core = bins.filter(F.col("__before") < CORE * F.col("__n")).groupBy("grp", "flat", "start").agg(F.max("__n").alias("n"), F.sum("k").alias("k"), *[F.sum(c).alias(c) for c in _NAMES])
    return materialize(core.mapInPandas(_invert, _MODEL), "outliers-step")


def concentrated(rows: DataFrame, total: int) -> DataFrame:
    """(grp, n, flat, mean, precision, logdet, middle): the estimate of least determinant for each group of ``rows`` (stored, with grp and v0..v5), and its medians; stored."""
    first = now = starts(rows, total)
    for _ in range(FIRST_STEPS):
        after = step(rows, now, total)
        if now is not first:
            release(now)
        now = after
    best = F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "start"))  # three rows
    kept = materialize(now.withColumn("__r", best).filter("__r = 1").drop("__r"), "outliers-best")
    release(now)
    ended: list[DataFrame] = []
    now = kept
    while True:  # determinants fall or a group ends, and they cannot fall forever
        after = step(rows, now, total)
        before = now.select(F.col("grp").alias("__grp"), F.col("logdet").alias("__logdet"))
        compared = materialize(after.join(before, F.col("grp") == F.col("__grp")).withColumn("moves", F.col("__logdet") - F.col("logdet") >= TOLERANCE).drop("__grp", "__logdet"), "outliers-moved")
        release(now, after)
        ended.append(compared.filter("NOT moves").drop("moves"))
        now = compared.filter("moves").drop("moves")
        if now.isEmpty():
            break
    out = ended[0]
    for table in ended[1:]:
        out = out.unionByName(table)
    middles = first.filter("start = 0").select(F.col("grp").alias("__grp"), F.col("mean").alias("middle"))
    model = materialize(out.drop("start").join(middles, F.col("grp") == F.col("__grp")).drop("__grp"), "outliers-model")
    release(first)
    return model


def departs() -> Column:
    """Whether a flat statistic departs from the common value by more than is accepted."""
    out = F.lit(False)
    for k, v in enumerate(_V):
        out = out | (is_flat(k) & (F.abs(F.col(v) - F.col("middle")[k]) > FLAT_LIMITS[k]))
    return out


def judged(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed, distance and kept for every row of ``docs``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = transformed(with_statistics(docs.select(F.col("doc_id").cast("long"), "text", "lang", "source"), ("doc_id", "lang", "source"))).withColumn("base_failed", failed)
    stats = materialize(found, "outliers-stats")
    passing = stats.filter(~F.col("base_failed"))
    total = passing.count()
    rows = materialize(_pooled(passing, total), "outliers-rows")
    model = concentrated(rows, total)
    placed = attach(rows, model, ["grp"], "n", total).withColumn("__d", squared_distance()).withColumn("__odd", departs()).drop("mean", "precision", "logdet", "middle")
    placed = materialize(placed, "outliers-placed")
    middle = materialize(placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__d", 0.5, 10000).alias("__mid")), "outliers-middle")
    scaled = attach(placed, middle, ["grp"], "n", total).withColumn("distance", F.col("__d") / F.greatest(F.col("__mid") / by_axes(CHI2_MEDIAN), F.lit(1.0)))
    near = ~F.col("__odd") & (F.col("distance") <= SPREAD * by_axes(CHI2_TAIL))
    release(rows, model)
    told = scaled.withColumn("kept", near).drop("__d", "__mid", "__odd", "grp", "flat")
    rest = stats.filter("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    return told.unionByName(rest)


def op5_robust_outliers(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
