"""Whitening against exact fractions and numpy's eigenvalues."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from tabrisk.llm.whitening import charpoly, charpoly_mod, fit_whitening, largest_roots, primes_for, products, roots_above, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, _x int, component int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in vectors], SCHEMA)


def leverrier(matrix):
    """Coefficients of det(t - matrix), constant first (Faddeev-LeVerrier)."""
    d = len(matrix)
    a = np.array(matrix, object)
    out, m = [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        m = a @ m + out[-1] * np.eye(d, dtype=int).astype(object)
        out.append(Fraction(-sum(np.diag(a @ m)), k))
    return [int(c) for c in reversed(out)]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 12])
def test_characteristic_polynomial(spark, d):
    draw = np.random.default_rng(d)
    x = draw.integers(-300, 300, (d + 3 if d != 7 else 4, d))   # d = 7: rank 4
    matrix = products(x.astype(np.int64))
    want = leverrier(matrix)
    assert charpoly(spark, matrix) == want
    for p in (2 ** 31 - 1, 101, 7):
        assert charpoly_mod(matrix, p).tolist() == [c % p for c in want]


def test_roots_are_counted_with_multiplicity():
    f = [1]
    for root in (0, 3, 3, 7, 7, 7, 10):
        f = [a - root * b for a, b in zip([0, *f], [*f, 0])]
    assert [roots_above(f, c) for c in (-1, 0, 2, 3, 6, 7, 9, 10)] == [7, 6, 6, 4, 4, 1, 1, 0]
    assert largest_roots(f, 5) == [10, 7, 7, 7, 3]


def test_primes_reach_the_bound():
    bound = 10 ** 60
    primes = primes_for(bound)
    assert np.prod(np.array(primes, object)) > 2 * bound and len(set(primes)) == len(primes)
    assert all(p % q for p in primes for q in range(3, 1000, 2))


def brute(vectors):
    """n, sums and covariance as fractions of the distinct integer vectors."""
    kept = [(i, tuple(floor(256 * float(np.float32(c))) for c in v)) for i, v in vectors
            if v and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = [[sum((x[i] - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in fit) / n for j in range(d)] for i in range(d)]
    return kept, n, sums, cov


def same_up_to_sign(got, want):
    return min(np.abs(got - want).max(), np.abs(got + want).max())


def test_whiten_against_fractions(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, (draw.normal(0, [0.5, 0.2, 0.1, 0.05, 0.02]) + 0.3).tolist()) for i in range(60)]
    vectors += [(100 + i, vectors[0][1]) for i in range(40)]                       # copies
    vectors += [(200, None), (201, [0.1, None, 0.2, 0.3, 0.4]), (202, [float("nan")] * 5), (203, [float("inf")] * 5),
                (204, []), (None, vectors[1][1]), (5, vectors[5][1])]
    kept, n, sums, cov = brute([v for v in vectors if v[1]])
    e, u = np.linalg.eigh(np.array(cov, float))
    e, u = e[::-1], u[:, ::-1]
    got = whiten(frame(spark, vectors)).collect()
    assert sorted({str(r.vec_id) for r in got}) == sorted({str(i) for i, _ in kept}) and len(got) == 4 * len(kept)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(1, 5):
        want = {i: (np.array(x) - np.array(sums) / n) @ u[:, c - 1] / e[c - 1] ** 0.5 for i, x in kept}
        ids = sorted(want, key=str)
        assert same_up_to_sign(np.array([by[i, c][0].whitened for i in ids]), np.array([want[i] for i in ids])) < 1e-11
    for i, x in kept:
        r = by[i, 1][0]
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert abs(r.explained * float(sum(cov[j][j] for j in range(5))) / e[0] - 1) < 1e-12
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-12


def test_repeated_eigenvalues_get_a_basis(spark):
    # the corners of a cube: all directions have the same variance
    vectors = [(i, [float(i >> b & 1) for b in range(3)]) for i in range(8)]
    x = spark.createDataFrame([([int(256 * c) for c in v],) for _, v in vectors], "_x array<bigint>")
    model = fit_whitening(x)
    assert len(set(model.eigenvalues)) == 1 and len(model.eigenvalues) == 3
    assert np.abs(model.components @ model.components.T - np.eye(3)).max() < 1e-15
    got = whiten(frame(spark, vectors)).collect()
    assert len(got) == 24 and got[0].identity_error < 1e-14 and abs(got[0].explained - 1 / 3) < 1e-12


def test_close_eigenvalues(spark):
    draw = np.random.default_rng(5)
    x = np.unique(draw.integers(-100, 100, (400, 6)) * 1000 + draw.integers(0, 3, (400, 6)), axis=0)
    model = fit_whitening(spark.createDataFrame([(r.tolist(),) for r in x], "_x array<bigint>"))
    centred = x - x.mean(0)
    cov = centred.T @ centred / len(x)
    for e, u in zip(model.eigenvalues, model.components):
        assert np.abs(cov @ u - float(e) * u).max() < 1e-12 * np.trace(cov)


def test_wide_entries_are_exact(spark):
    x = [[2 ** 40 + i, -(2 ** 41) * i, i] for i in range(5)]
    assert (products(np.array(x, np.int64)) == np.array(x, object).T @ np.array(x, object)).all()


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        got = whiten(frame(spark, vectors))
        assert got.columns[0] == "vec_id" and got.count() == 0
    # two vectors: one direction; the third is of another length
    assert whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.5]), (3, [1.0])])).count() == 2


def test_query_on_the_table(spark, sf_dir):
    from tabrisk.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(np.int64) for r in table}
    fit = np.unique(np.array(list(x.values())), axis=0)
    cov = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(cov)
    out = QUERIES["op11_embedding_whitening"](spark, sf_dir)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert len(got) == 4 * len(x)
    for c in range(1, 5):
        mine = [r for r in got if r.component == c]
        want = np.array([(x[r.vec_id] - fit.mean(0)) @ u[:, -c] / e[-c] ** 0.5 for r in mine])
        assert same_up_to_sign(np.array([r.whitened for r in mine]), want) < 1e-8
        assert abs(mine[0].explained - e[-c] / np.trace(cov)) < 1e-10
    assert got[0].identity_error < 1e-10
    total = fit.sum(0)
    assert all(r.deviation == int(((len(fit) * x[r.vec_id] - total) ** 2).sum()) for r in got)
