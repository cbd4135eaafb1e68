"""Whitening of embeddings from the exact characteristic polynomial.

Entries become integers ``floor(256 * c)``, the distinct integer vectors are the
fit list, and from there to the roots nothing is rounded:

1. Spark adds up counts, sums and products of the fit list exactly; they give
   the integer scatter ``C = n * sum(x x') - S S'``, which is ``n^2`` times the
   covariance.
2. ``det(t - C)`` is computed modulo as many 31-bit primes as its largest
   possible coefficient needs, one prime a row of a Spark job: reduction to
   Hessenberg form, then the recurrence over its leading minors.  Chinese
   remaindering gives the integer coefficients.
3. All roots are real, so the sign changes of the coefficients of
   ``f(t + c)`` count the roots above ``c`` exactly, repeated ones as often as
   they occur.  Bisection over dyadic ``c`` isolates each wanted root to 110 bits
   of the trace.
4. Inverse iteration in long decimal arithmetic finds the null space at each
   root, orthogonal to the components before, so repeated roots get a basis.

Only ``d x d`` tables (``d``: entries of a vector) and a few rows a prime pass
through the driver; the vectors stay in Spark.  The work on ``C`` grows with
``d^4``, for ``d`` up to some hundreds.

Defined results: vectors that are NULL, empty or hold NULL or non-finite
entries are dropped, and so are those whose length is not the commonest (the
larger of two equally common ones); NULL and repeated identifiers keep their
rows; components with a zero eigenvalue can't be scaled and are left out, so
vectors that are all equal, one vector and an empty table give an empty result;
entries beyond 2^54 in size are an error; other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.session import checkpoint_dir

SCALE = 256
ROOT_BITS = 110          # of the trace, to which roots are isolated
COMPONENTS = 4


# ---- integer vectors and their sums ------------------------------------------

def integer_vectors(rows: DataFrame, vec_col: str, *keep: str) -> DataFrame:
    """``_x`` (array<bigint>) of the rows that stay, and the columns in ``keep``."""
    entry = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = rows.select(*keep, entry.alias("_v")).where(F.col("_v").isNotNull() & (F.size("_v") > 0) & fine)
    length = whole.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = whole.where(F.size("_v") == (length["d"] if length else 0))
    big = F.exists("_v", lambda c: F.abs(c) >= float(2 ** 54))
    x = F.transform("_v", lambda c: F.floor(c * SCALE))
    return whole.select(*keep, F.when(big, F.raise_error(F.lit("an entry is too large"))).otherwise(x).alias("_x"))


def _written(df: DataFrame) -> DataFrame:
    """A table in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/whitening-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(x: np.ndarray) -> np.ndarray:
    """x' x of integers, exact (object entries)."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 2 ** 53:
        y = x.astype(float)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _sums(batches):
    """Products of (1, x) over one partition: the count, the sums and x x'."""
    total = 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("_x"))
            total = total + products(np.concatenate([np.ones((len(x), 1), np.int64), x], 1))
    if isinstance(total, np.ndarray):
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([
            pa.array(i, pa.int32()), pa.array(j, pa.int32()),
            pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))], ["i", "j", "v"])


def moments(fit: DataFrame) -> np.ndarray | None:
    """The exact (d + 1)^2 products of (1, x) over ``fit``."""
    cells = fit.mapInArrow(_sums, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(
        F.sum("v").cast("decimal(38,0)").alias("v")).collect()   # (d + 1)(d + 2) / 2 rows
    if not cells:
        return None
    size = max(r["j"] for r in cells) + 1
    out = np.zeros((size, size), object)
    for r in cells:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["v"])
    return out


# ---- the characteristic polynomial -------------------------------------------

def _is_prime(n: int) -> bool:
    """Deterministic for n < 3.2e9."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        if n == base:
            return True
        y = pow(base, odd, n)
        if y not in (1, n - 1) and not any((y := y * y % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """31-bit primes whose product exceeds ``2 * bound``."""
    out, product, p = [], 1, 2 ** 31 - 1
    while product <= 2 * bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - matrix) mod p, constant first."""
    h = np.array(matrix % p, np.int64)
    d = len(h)
    for m in range(1, d - 1):                      # below the subdiagonal of column m - 1
        nonzero = np.flatnonzero(h[m:, m - 1])
        if not len(nonzero):
            continue
        if k := int(nonzero[0]):
            h[[m, m + k]] = h[[m + k, m]]
            h[:, [m, m + k]] = h[:, [m + k, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)    # det(t - leading k x k part)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - h[k - 1, k - 1] * minors[k - 1] % p) % p
        below = 1
        for i in range(k - 2, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            minors[k] = (minors[k] - int(h[i, k - 1]) * below % p * minors[i] % p) % p
    return minors[d]


def charpoly(spark, matrix: np.ndarray) -> list[int]:
    """Integer coefficients of det(t - matrix), constant first, for a symmetric
    positive semidefinite integer matrix."""
    d, trace = len(matrix), int(sum(matrix[i, i] for i in range(len(matrix))))
    # sums of products of k eigenvalues are at most those of k equal ones
    bound = max(comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))
    primes = primes_for(bound)

    def reduce(batches):
        for batch in batches:
            for p in batch.column("p").to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([charpoly_mod(matrix, p).tolist()], pa.list_(pa.int64()))], ["p", "c"])

    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 64))
    got = rows.mapInArrow(reduce, "p bigint, c array<bigint>").collect()   # d + 1 numbers a prime
    value, modulus = [0] * (d + 1), 1
    for r in got:
        p = r["p"]
        inverse = pow(modulus % p, -1, p)
        value = [v + modulus * ((c - v) * inverse % p) for v, c in zip(value, r["c"])]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


# ---- roots and components -----------------------------------------------------

def roots_above(scaled: list[int], m: int) -> int:
    """Roots above ``m`` of an integer polynomial with real roots only."""
    a = list(scaled)
    for i in range(len(a) - 1):                    # Taylor shift by m
        for j in range(len(a) - 2, i - 1, -1):
            a[j] += m * a[j + 1]
    signs = [c > 0 for c in a if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(coefficients: list[int], count: int) -> list[Fraction]:
    """The ``count`` largest roots, falling, repeated ones repeated, each rounded
    down to 110 bits of their sum; for polynomials with roots >= 0 only."""
    d = len(coefficients) - 1
    trace = -coefficients[-2] if d else 0
    shift = max(0, ROOT_BITS - trace.bit_length())
    scaled = [c << (shift * (d - k)) for k, c in enumerate(coefficients)]
    out, seen = [], {}

    def above(m):
        if m not in seen:
            seen[m] = roots_above(scaled, m)
        return seen[m]

    high = (trace << shift) + 1
    for k in range(1, min(count, d) + 1):
        low, top = -1, high                        # at least k roots above low, fewer above top
        while top - low > 1:
            middle = (low + top) // 2
            if above(middle) >= k:
                low = middle
            else:
                top = middle
        out.append(Fraction(max(top, 0), 1 << shift))
        high = top
    return out


def _null_vectors(matrix: np.ndarray, roots: list[Fraction]) -> np.ndarray:
    """Unit eigenvectors (rows) at the roots, each orthogonal to those before."""
    d = len(matrix)
    trace = int(sum(matrix[i, i] for i in range(d)))
    with localcontext() as context:
        context.prec = 60 + 2 * len(str(trace))
        found = []
        for number, root in enumerate(roots):
            value = Decimal(root.numerator) / Decimal(root.denominator)
            lu = np.array([[Decimal(int(c)) for c in row] for row in matrix], object)
            for i in range(d):
                lu[i, i] -= value
            least = Decimal(max(trace, 1)).scaleb(-context.prec)
            order = list(range(d))
            for k in range(d):
                pivot = k + max(range(d - k), key=lambda i: abs(lu[k + i, k]))
                if pivot != k:
                    lu[[k, pivot]] = lu[[pivot, k]]
                    order[k], order[pivot] = order[pivot], order[k]
                if abs(lu[k, k]) < least:
                    lu[k, k] = least
                if k + 1 < d:
                    lu[k + 1:, k] /= lu[k, k]
                    lu[k + 1:, k + 1:] -= np.outer(lu[k + 1:, k], lu[k, k + 1:])
            v = np.array([Decimal((i * 7919 + number * 104729) % 1009 + 1) for i in range(d)], object)
            for _ in range(4):
                for u in found:
                    v = v - u * (u @ v)
                v = v[order]
                for k in range(1, d):
                    v[k] -= lu[k, :k] @ v[:k]
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (lu[k, k + 1:] @ v[k + 1:] if k + 1 < d else 0)) / lu[k, k]
                for u in found:
                    v = v - u * (u @ v)
                v = v / max(map(abs, v))
                v = v / (v @ v).sqrt()
            found.append(v)
        return np.array(found, object).astype(float).reshape(len(found), d)


# ---- the operator ---------------------------------------------------------------

@dataclass
class Whitening:
    n: int                       # vectors of the fit list
    sums: np.ndarray             # their sums, exact
    eigenvalues: list[Fraction]  # of the covariance
    trace: Fraction
    components: np.ndarray       # a row each

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exact n * x - S, whitened) of integer vectors."""
        limit = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        kind = np.int64 if limit < 2 ** 61 else object
        centred = x.astype(kind) * self.n - self.sums.astype(kind)
        scale = np.array([float(e) ** -0.5 for e in self.eigenvalues])
        return centred, (centred / self.n).astype(float) @ self.components.T * scale


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of distinct integer vectors ``_x``; None without a component."""
    got = moments(fit)
    if got is None:
        return None
    n, sums = int(got[0, 0]), got[0, 1:]
    scatter = n * got[1:, 1:] - np.outer(sums, sums)
    trace = int(sum(np.diag(scatter)))
    if not trace:
        return None
    roots = [r for r in largest_roots(charpoly(fit.sparkSession, scatter), components)
             if r * 2 ** (ROOT_BITS - 10) > trace]
    return Whitening(n, sums, [r / n ** 2 for r in roots], Fraction(trace, n ** 2), _null_vectors(scatter, roots))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of |covariance of the whitened fit list - identity|."""
    k = len(model.eigenvalues)

    def whitened(batches, mean):
        total, cross = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.project(_matrix(batch.column("_x")))[1] - mean
                total, cross = total + w.sum(0), cross + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64())) for v in (total, cross.ravel())], ["s", "c"])

    def summed(mean):
        part = fit.mapInArrow(lambda b: whitened(b, mean), "s array<double>, c array<double>")
        rows = part.select(F.posexplode(F.concat("s", "c"))).groupBy("pos").agg(F.sum("col").alias("v")).collect()
        return np.array([r["v"] for r in sorted(rows, key=lambda r: r["pos"])]) / model.n

    cross = summed(summed(np.zeros(k))[:k])[k:].reshape(k, k)
    return float(np.abs(cross - np.eye(k)).max())


_OUT = "{id} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that stays and each component: ``<id>, component, n,
    deviation, whitened, explained, identity_error``."""
    x = integer_vectors(vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec")), "_vec", "_id")
    fit = _written(x.select("_x").distinct())
    model = fit_whitening(fit, components)
    kind = dict(x.dtypes)["_id"]
    schema = _OUT.format(id=f"`{id_col}`", kind=kind)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, model)
    explained = [float(e / model.trace) for e in model.eigenvalues]
    k = len(explained)

    def rows(batches):
        for batch in batches:
            centred, w = model.project(_matrix(batch.column("_x"))) if batch.num_rows else (np.zeros((0, 1)), np.zeros((0, k)))
            most = int(np.abs(centred).max(initial=0))
            wide = centred if centred.dtype != object and most * most * centred.shape[1] < 2 ** 63 else centred.astype(object)
            yield pa.RecordBatch.from_arrays([
                batch.column("_id").take(pa.array(np.repeat(np.arange(len(w)), k))),
                pa.array(np.tile(np.arange(1, k + 1), len(w)), pa.int32()),
                pa.array(np.full(len(w) * k, model.n), pa.int64()),
                pa.array(np.repeat((wide * wide).sum(1), k), pa.int64()),   # an error beyond 64 bits
                pa.array(w.ravel(), pa.float64()),
                pa.array(np.tile(explained, len(w)), pa.float64()),
                pa.array(np.full(len(w) * k, error), pa.float64())],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(rows, schema)
