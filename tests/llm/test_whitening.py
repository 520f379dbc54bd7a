import math

import numpy as np
import pytest

from tidewell.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def frame(spark, vectors, ids=None):
    rows = [(k if ids is None else ids[k], v, 0, "clash") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k=4):
    """Rows by definition, with all eigenvectors of the whole covariance."""
    usable = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in usable])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    w = (x - s / n) @ vectors / np.sqrt(values)
    return n, [int(((n * r - s) ** 2).sum()) for r in x], w, values / np.trace(v)


def check(got, vectors, ids, k=4):
    n, deviation, w, explained = brute(vectors, k)
    got = sorted(got, key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c + 1) for i in ids for c in range(k)]
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in got)
    assert [r["deviation"] for r in got[::k]] == deviation
    mine = np.array([r["whitened"] for r in got]).reshape(-1, k)
    signs = np.sign((mine * w).sum(0))
    assert np.abs(mine * signs - w).max() < 1e-8
    assert np.allclose([r["explained"] for r in got[:k]], explained, rtol=1e-9)


def test_whitens_as_the_whole_covariance_does(spark):
    r = np.random.default_rng(4)
    vectors = (r.standard_normal((300, 24)) * np.linspace(0.3, 1.5, 24)).tolist()
    vectors += vectors[:40] * 3  # copies count once
    check(whitening.op11_whitening(frame(spark, vectors)).collect(), vectors, range(len(vectors)))


def test_isotropic_vectors_of_many_dimensions(spark):
    vectors = np.random.default_rng(5).standard_normal((600, 200)).tolist()
    check(whitening.op11_whitening(frame(spark, vectors)).collect(), vectors, range(600))


def test_awkward_rows(spark):
    good = np.random.default_rng(6).standard_normal((50, 6)).tolist()
    bad = [None, [], [None] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0] * 5, [1.0] * 7]
    got = whitening.op11_whitening(frame(spark, good + bad + [[-0.0] * 6])).collect()
    check(got, [*good, [0.0] * 6], [*range(50), 58])
    repeated = frame(spark, good + good, [None if k == 3 else k % 50 for k in range(100)])
    got = whitening.op11_whitening(repeated).collect()
    assert len(got) == 400 and got[0]["n"] == 50 and sum(r["vec_id"] is None for r in got) == 4


def test_tables_without_variance_give_no_rows(spark):
    assert whitening.op11_whitening(frame(spark, [])).count() == 0
    assert whitening.op11_whitening(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.op11_whitening(frame(spark, [None, []])).count() == 0
    two = whitening.op11_whitening(frame(spark, [[1.0, 2.0], [3.0, 2.0], [1.0, 2.0]])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in two) == [(k, 1, 1.0, 1.0) for k in range(3)]


def test_sums_and_deviations_beyond_a_long(spark):
    vectors = [[1e17, 1.0], [-1e17, 2.0], [3.0, 4.0]]
    usable = whitening.quantised(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    model = whitening._totals(usable)
    top = (1 << 63) - 1
    assert model.sums == [top - (1 << 63) + 768, 7 * 256]  # entries saturate
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    assert got and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)


@pytest.mark.parametrize(("d", "history"), [(40, 1), (40, 3), (150, 8), (5, 8), (16, 8)])
def test_iteration_certifies_its_pairs(d, history):
    r = np.random.default_rng(d)
    turn, _ = np.linalg.qr(r.standard_normal((d, d)))
    spectrum = np.sort(r.uniform(1, 2, d))[::-1] ** (1 if history > 1 else 8)
    v = turn @ np.diag(spectrum) @ turn.T
    calls = []

    def multiply(q):
        assert np.allclose(q.T @ q, np.eye(q.shape[1]), atol=1e-12)
        calls.append(q.shape[1])
        return v @ q

    values, vectors, passes = whitening.iterate(multiply, d, 4, block=8, history=history)
    assert passes == len(calls) and max(calls) <= 8
    assert np.allclose(values, spectrum[:4], rtol=1e-12)
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-11 * values[0]


def test_equal_eigenvalues_give_an_orthonormal_basis():
    v = np.diag([3.0] * 6 + [1.0] * 30)
    values, vectors, _ = whitening.iterate(lambda q: v @ q, 36, 4, block=4)
    assert np.allclose(values, 3) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_a_spectrum_that_does_not_converge_is_an_error():
    noise = np.random.default_rng(1)
    with pytest.raises(RuntimeError):
        whitening.iterate(lambda q: q + 0.1 * noise.standard_normal(q.shape), 60, 4, block=4, history=2)
