"""Whitening against exact sums, float64 decompositions and matrices with clusters."""

import random

import numpy as np
import pytest

from plumbline.llm import queries, whitening
from plumbline.sources.tables import load

NAN, INF = float("nan"), float("inf")


def plain(vectors, count):
    """(deviations, projections up to sign, shares) of usable vectors."""
    x = np.floor(256 * np.array(vectors, np.float64))
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    order = np.argsort(-values)[:count]
    z = (x - sums / n) @ basis[:, order] / np.sqrt(values[order])
    deviations = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, deviations, z, values[order] / values.sum()


def compare(rows, ids, vectors, count):
    n, deviations, z, shares = plain(vectors, count)
    rows = sorted(rows, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == [(i, c) for i in sorted(ids) for c in range(1, z.shape[1] + 1)]
    at = {i: k for k, i in enumerate(ids)}
    assert all(r.n == n and r.deviation == deviations[at[r.vec_id]] for r in rows)
    got = np.array([r.whitened for r in rows]).reshape(-1, z.shape[1])
    want = z[[at[i] for i in sorted(ids)]]
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    assert np.allclose([r.explained for r in rows[: z.shape[1]]], shares, rtol=1e-10)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10


def test_query_over_the_whole_table(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").collect()
    got = queries.op11_embedding_whitening(spark, sf_dir).collect()
    compare(got, [r.vec_id for r in rows], [r.embedding for r in rows], 4)


def test_odd_rows(spark):
    rng = random.Random(1)
    good = [(k, [rng.gauss(0, 1) for _ in range(5)]) for k in range(40)]
    good += [(k + 40, v) for k, v in good[:15]] + [(90, [-0.0] * 5), (91, [0.0] * 5)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [NAN] * 5), (104, [INF] * 5), (105, [1.0] * 3)]
    rows = [(i, v, 7, 8) for i, v in good + bad]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n int, x int").repartition(3)
    vectors = [np.array(v, np.float32) for _, v in good]
    compare(whitening.whitened(df).collect(), [i for i, _ in good], vectors, 4)


def test_few_dimensions_and_no_variance(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [3.0, 2.0]), (1, [3.0, 2.0])], "vec_id bigint, embedding array<float>")
    rows = whitening.whitened(df).collect()
    assert len(rows) == 6
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1 for r in rows if r.component == 1)
    assert all(r.whitened is None and r.explained == 0 for r in rows if r.component == 2)
    one = whitening.whitened(spark.createDataFrame([(5, [1.0])], "vec_id int, embedding array<float>")).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(5, 1, 1, 0, None, 0.0)]
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert whitening.whitened(none).count() == 0
    gone = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert whitening.whitened(gone).count() == 0


def test_huge_entries(spark):
    rows = [(k, [float(v) for v in vs]) for k, vs in enumerate([(1e30, 1, 0), (-1e30, 2, 0), (3e12, 5, 1), (0, 0, 0)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = whitening.whitened(df, 3).collect()
    assert len(got) == 12 and got[0].identity_error < 1e-4
    assert all(r.deviation is None for r in got if r.vec_id < 2)


def test_products_are_exact():
    rng = random.Random(2)
    for top in (100, 1 << 30, (1 << 62) - 1):
        y = np.array([[rng.randint(-top, top) for _ in range(4)] for _ in range(1100)], np.int64)
        want = y.astype(object).T.dot(y.astype(object))
        assert (whitening.products(y) == want).all()


def matrix_of(values, seed=3):
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    basis = basis.astype(np.longdouble)
    for _ in range(3):  # orthonormal beyond float64
        basis = basis @ (1.5 * np.eye(len(values)) - 0.5 * (basis.T @ basis))
    made = (basis * np.array(values, np.longdouble)) @ basis.T
    return (made + made.T) / 2, basis


@pytest.mark.parametrize("values", [
    list(range(30, 0, -1)),
    [5, 5 - 1e-9, 5 - 2e-9, 2, 1, 1 - 1e-7, 0.5, 0],
    [4, 4, 4, 1, 1, 0.1],
    [1] * 6,
    [1e6, 1e6 - 1e-3, 1, 1e-6],
])
def test_refinement_with_clusters(values):
    matrix, _ = matrix_of(values)
    rough = np.linalg.eigh((matrix / np.abs(matrix).max()).astype(np.float32))[1]
    got, x = whitening.refined(matrix, rough)
    top = max(values)
    assert np.abs(got - np.array(values)).max() < 1e-15 * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-16
    assert np.abs(matrix @ x - x * got).max() < 1e-15 * top


def test_vectors_of_near_values_are_told_apart():
    values = [5, 5 - 1e-6, 5 - 3e-6, 2, 1, 0.5]
    matrix, basis = matrix_of(values)
    rough = np.linalg.eigh(matrix.astype(np.float32))[1]
    _, x = whitening.refined(matrix, rough)
    # The matrix is known to 19 digits, so these vectors are to some 13.
    assert np.abs(np.abs((x * basis).sum(0)) - 1).max() < 1e-15
    assert np.abs(x - basis * np.sign((x * basis).sum(0))).max() < 1e-11
