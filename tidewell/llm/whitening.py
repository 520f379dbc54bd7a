"""Whitening of embeddings by matrix-free block subspace iteration.

Entries become integers (floor of 256 times the entry), each distinct vector counts once,
and one pass sums count, sums and squares exactly. Then every step is one Spark pass over
the distinct vectors: tasks centre their rows, multiply them by the block Q and by
themselves again, and their d x b products are added in a tree, so neither the covariance
nor any row reaches the driver. There QR and Rayleigh-Ritz give the next block. Ritz pairs
are accepted once the residuals of all k are at most ``TOLERANCE`` of the largest
eigenvalue; a spectrum that resists for ``MOST_PASSES`` passes is an error, never a guess.

Embeddings are often nearly isotropic, where iteration on one block needs hundreds of
passes. The Rayleigh-Ritz step therefore spans the blocks of earlier passes too, whose
products are known, up to ``HISTORY`` blocks; then it starts again from the best two.
With ``history=1`` it is the plain iteration.

Edge cases. Rows whose vector is null, empty, or holds null, NaN or infinite entries are
dropped. Vectors of several lengths: the length of the most distinct vectors is the
dimension (of ties the larger), others are dropped too. Repeated rows each get their result
but count once in the fit; null ids are ids like others. Entries beyond a long's range
saturate. Components without variance (fewer distinct vectors than components, constant
dimensions) are left out, so a table of one distinct vector gives no rows, as an empty table
does. Ties among eigenvalues: any orthonormal basis of theirs. ``deviation`` is null where
it exceeds a long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.storage import materialize, release

SCALE = 256
COMPONENTS = 4
#: Columns of a block.
BLOCK = 16
#: Blocks that Rayleigh-Ritz spans before it starts again.
HISTORY = 8
#: A residual may have so much of the largest eigenvalue.
TOLERANCE = 1e-12
#: Eigenvalues of no more than so much of the largest are no variance.
NO_VARIANCE = 1e-11
MOST_PASSES = 300
#: Numbers in a slice of rows that a task multiplies at once.
SLICE = 1 << 19

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    """Exact counts and sums of the fit list, and what the iteration found."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` with ``x``, their usable vectors as longs; the others go."""
    entries = F.col(vector)

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))

    usable = rows.filter(entries.isNotNull() & (F.size(entries) > 0) & F.forall(entries, finite))
    return usable.withColumn("x", F.transform(entries, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _slices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """Vectors of length d as integer matrices of bounded size."""
    step = max(1, SLICE // d)
    for batch in batches:
        column = batch.column("x")
        if len(column) == 0:
            continue
        for at in range(0, len(column), step):
            part = column.slice(at, step)
            lengths = part.value_lengths().to_numpy(zero_copy_only=False)
            if not (lengths == d).all():
                part = part.filter(pa.array(lengths == d))
            if len(part):
                yield _matrix(part, d)


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers, from halves that cannot overflow."""
    return (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)


def _square_sums(x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Exact sums over each row of x * x, or of x times integer ``weights``."""
    other = x if weights is None else weights
    top = max(int(x.max()), -int(x.min())) * max(int(other.max()), -int(other.min()))
    if top * x.shape[1] < 1 << 62:
        return (x * other.astype(np.int64)).sum(1)
    return (x.astype(object) * other.astype(object)).sum(1)


def _totals(fit: DataFrame) -> Model:
    """Exact count, sums and trace of the fit list, for the length of most of its vectors."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            column = batch.column("x")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                for x in _slices(iter([batch.filter(pa.array(lengths == d))]), d):
                    n, sums, squares = held.get(d, (0, 0, 0))
                    held[d] = [n + len(x), _exact_sums(x) + sums, squares + int(_square_sums(x).astype(object).sum())]
        for d, (n, sums, squares) in held.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "n": [n], "sums": [[str(s) for s in sums]], "squares": [str(squares)]})

    def add(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])], a[2] + b[2]

    parts = fit.mapInArrow(local, "d long, n long, sums array<string>, squares string").rdd
    keyed = parts.map(lambda r: (r["d"], (r["n"], [int(s) for s in r["sums"]], int(r["squares"]))))
    best = keyed.reduceByKey(add).sortBy(lambda kv: (-kv[1][0], -kv[0])).take(1)
    if not best:
        return Model()
    n, sums, squares = best[0][1]
    return Model(n, sums, (n * squares - sum(s * s for s in sums)) / n**2)


def _summed(fit: DataFrame, d: int, local: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of ``local`` over all slices of the fit list, added in a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _slices(batches, d):
            total += local(x)
        yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

    parts = fit.mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(r["part"]).reshape(shape))
    return parts.treeAggregate(np.zeros(shape), np.add, np.add)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns that span what ``block`` adds to the orthonormal columns ``against``."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        if not block.shape[1]:
            return block
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-8]
    return block


def iterate(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, history: int = HISTORY, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues, their vectors and the passes it took; ``multiply`` applies the covariance to a block."""
    block = min(d, max(block, k))
    width = min(d, max(history, 1) * block)
    fresh = _orthonormal(np.random.default_rng(11).standard_normal((d, block)), np.zeros((d, 0)))
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    for passes in range(1, MOST_PASSES + 1):
        basis, images = np.hstack([basis, fresh]), np.hstack([images, multiply(fresh)])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, applied = basis @ turn, images @ turn
        residuals = applied[:, :block] - ritz[:, :block] * values[:block]
        worst = np.linalg.norm(residuals[:, :k], axis=0).max()
        if worst <= tolerance * max(values[0], 0) or basis.shape[1] == d:
            return np.maximum(values[:k], 0), ritz[:, :k], passes
        if basis.shape[1] + block > max(width, block):
            keep = 2 * block if 3 * block <= width else block
            if history <= 1:  # plain iteration: the next block is the image of this one, alone
                basis, images, fresh = np.zeros((d, 0)), np.zeros((d, 0)), _orthonormal(applied[:, :block], np.zeros((d, 0)))
                continue
            basis, images = ritz[:, :keep], applied[:, :keep]
        fresh = _orthonormal(residuals, basis)[:, : d - basis.shape[1]]
        if not fresh.shape[1]:  # the span is invariant
            return np.maximum(values[:k], 0), ritz[:, :k], passes
    raise RuntimeError(f"residual {worst:.3g} of eigenvalue {values[0]:.3g} after {MOST_PASSES} passes")


def fitted(fit: DataFrame, k: int = COMPONENTS, block: int = BLOCK, history: int = HISTORY, tolerance: float = TOLERANCE) -> Model:
    """The model of the stored fit list: ``x`` of each distinct vector."""
    model = _totals(fit)
    if model.trace <= 0:
        return model
    mean, n, d = model.mean, model.n, len(model.sums)

    def multiply(q: np.ndarray) -> np.ndarray:
        def local(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _summed(fit, d, local, q.shape) / n

    values, vectors, model.passes = iterate(multiply, d, min(k, d), block, history, tolerance)
    real = values > NO_VARIANCE * values[0]
    vectors = vectors[:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    model.values, model.vectors = values[real], vectors * signs
    return model


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity, from a pass of its own."""
    k = len(model.values)
    if not k:
        return 0.0
    mean, onto = model.mean, model.vectors / np.sqrt(model.values)

    def local(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ onto
        return np.vstack([w.T @ w, w.sum(0)])

    total = _summed(fit, len(model.sums), local, (k + 1, k)) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Model, error: float) -> DataFrame:
    """A row for each of ``rows`` (vec_id, x) and component; nothing is shuffled."""
    k, d = len(model.values), len(model.sums)
    if not k:
        return rows.sparkSession.createDataFrame([], RESULT)
    mean, onto, n = model.mean, model.vectors / np.sqrt(model.values), model.n
    sums = np.array(model.sums, dtype=object)
    own = sum(s * s for s in model.sums)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SLICE // max(d, k))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lengths = part.column("x").value_lengths().to_numpy(zero_copy_only=False)
                part = part.filter(pa.array(lengths == d))
                if not part.num_rows:
                    continue
                x = _matrix(part.column("x"), d)
                w = (x - mean) @ onto
                wide = n * n * _square_sums(x).astype(object) - 2 * n * _square_sums(x, sums).astype(object) + own
                deviation = pa.array([v if v < 1 << 63 else None for v in wide], pa.int64())
                m = len(x)
                repeat = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(repeat),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        deviation.take(repeat),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, RESULT)


def whiten(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS, block: int = BLOCK, history: int = HISTORY) -> DataFrame:
    """Fit on the distinct vectors of ``rows`` and whiten them all."""
    usable = quantised(rows, vector)
    fit = materialize(usable.select("x").distinct(), "whitening-fit")
    model = fitted(fit, k, block, history)
    error = identity_error(fit, model)
    release(fit)
    return whitened(usable, model, error)


def op11_whitening(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
