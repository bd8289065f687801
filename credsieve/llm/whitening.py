"""Whitening of embeddings along exact principal components.

Every component c of a usable vector becomes x = floor(1024 * c) + 100000.

1. Spark sums the x per dimension, then the products of the x centred at their rounded
   means, in whole numbers: a task sums its rows, a row per entry and limb leaves it, and
   ``n * sum(y y') - sum(y) sum(y)'`` is n² times the covariance without any rounding.
2. Its characteristic polynomial is found modulo one prime per Spark row: Hessenberg form
   by similarity, then the recurrence over its leading blocks.  Chinese remaindering gives
   the whole coefficients, as the primes' product exceeds twice their bound.
3. All roots are real, so the sign changes of the polynomial shifted to m count the roots
   above m exactly.  Bisection on that count isolates the largest roots, bisection on the
   sign refines a simple one.
4. A component is the null space of the matrix less its root, by inverse iteration in
   ``DIGITS`` decimal digits.  Roots that agree to ``ROOT_BITS`` bits share a null space,
   of which an orthonormal basis is taken.
5. One narrow pass projects the rows.

What reaches the driver has the size of the matrix, whatever the number of rows.

Defined results: a vector that is null, empty, or holds a null, non-finite or larger entry
than 2^51 is left out, as is one of another length than the commonest (of several the
greatest); repeated ids are rows of their own and null ids stay null; a component of no
variance whitens to 0 and explains 0, and is left out of the identity's error; an empty
table gives no rows.  Of the two signs the one whose largest entry is positive is taken.
Other columns of the input are left behind, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import fresh
from credsieve.storage import Steps

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 51)
# Bits of a limb of y: products of two, summed over a batch of rows, are exact in doubles.
LIMB, ROWS = 18, 1 << 16
# Bits of a limb of a task's sum; millions of tasks add up within a long.
PART = 36
PRIME_BITS = 31
ROOT_BITS = 256
DIGITS = 120


def _integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable, and the x of those."""
    usable = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims
    flat = column.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False)
    values = flat.astype(np.float64).reshape(-1, dims)
    with np.errstate(invalid="ignore"):
        good = (np.abs(values) <= LARGEST).all(axis=1)
    usable[usable] = good
    return usable, np.floor(SCALE * values[good]).astype(np.int64) + SHIFT


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Signed limbs, the lowest first, as doubles."""
    out, half, rest = [], 1 << (LIMB - 1), values
    while True:
        low = ((rest + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB
        if not rest.any():
            return out


def _products(y: np.ndarray) -> np.ndarray:
    """Sum of y y' over the rows, as whole numbers of any size."""
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for low in range(0, len(y), ROWS):
        limbs = _limbs(y[low : low + ROWS])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def _parts(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """(entry, limb, part) of whole numbers, without the zero parts."""
    half, mask = 1 << (PART - 1), (1 << PART) - 1
    for entry, value in enumerate(values):
        limb = 0
        while value:
            low = ((value + half) & mask) - half
            if low:
                yield entry, limb, low
            value, limb = (value - low) >> PART, limb + 1


def _summed(rows: DataFrame, entries: int, of_batch, dims: int) -> list[int]:
    """Exact sums over all rows of the ``entries`` numbers that ``of_batch`` gives for the
    usable x of a batch.  A task sends its sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(entries, dtype=object)
        for batch in batches:
            _, x = _integers(batch.column(0), dims)
            if len(x):
                total += of_batch(x)
        found = list(_parts(total.tolist()))
        if found:
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["entry", "limb", "part"])

    found = rows.select("vector").mapInArrow(run, "entry long, limb long, part long")
    out = [0] * entries
    # entries * limbs rows, whatever the number of vectors
    for r in found.groupBy("entry", "limb").agg(F.sum("part").alias("part")).collect():
        out[r.entry] += r.part << (PART * r.limb)
    return out


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that are never wrong below 3.2e9."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x in (1, n - 1):
            continue
        if all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes from 2^PRIME_BITS down whose product exceeds ``bound``."""
    out, product, n = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``matrix`` modulo p, zero below its subdiagonal."""
    h = matrix.copy()
    size = len(h)
    for m in range(1, size - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m][None, :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    return h


def characteristic(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p of det(x - matrix), the lowest first."""
    size = len(matrix)
    h = hessenberg(matrix, p)
    found = np.zeros((size + 1, size + 1), dtype=np.int64)
    found[0, 0] = 1
    for m in range(1, size + 1):
        found[m, 1:] = found[m - 1, :-1]
        weights, below = np.zeros(m, dtype=np.int64), 1
        for i in range(m - 1, -1, -1):
            weights[i] = int(h[i, m - 1]) * below % p
            if i:
                below = below * int(h[i, i - 1]) % p
                if not below:
                    break
        found[m] = (found[m] - (weights[:, None] * found[:m] % p).sum(axis=0)) % p
    return found[size]


def _coefficient_bound(trace: int, size: int) -> int:
    """No elementary symmetric function of ``size`` numbers >= 0 of this sum is larger."""
    return max(math.comb(size, k) * trace**k // size**k + 1 for k in range(size + 1))


def polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Characteristic polynomial of a symmetric matrix without negative eigenvalues."""
    size = len(matrix)
    primes = primes_beyond(2 * _coefficient_bound(sum(matrix[i][i] for i in range(size)), size) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            found = [
                characteristic(np.array([[v % p for v in row] for row in matrix], dtype=np.int64), p).tolist()
                for p in ps
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ps, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "found"]
            )

    tasks = min(len(primes), 64)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    residues = {r.p: r.found for r in rows.mapInArrow(run, "p long, found array<long>").collect()}
    product = math.prod(primes)
    out = [0] * (size + 1)
    for p in primes:
        rest = product // p
        weight = rest * pow(rest % p, -1, p)
        out = [(c + weight * r) % product for c, r in zip(out, residues[p], strict=True)]
    return [c - product if c > product // 2 else c for c in out]


class Roots:
    """The largest roots of a polynomial all of whose roots are real and not negative.

    ``coefficients`` are whole numbers, the lowest first.  Roots are given as whole
    numbers m: the root times 2^bits lies above m and not above m + 1.
    """

    def __init__(self, coefficients: list[int], largest: int) -> None:
        size = len(coefficients) - 1
        self.bits = max(0, ROOT_BITS - largest.bit_length())
        self.scaled = [c << (self.bits * (size - i)) for i, c in enumerate(coefficients)]
        self.high = (largest << self.bits) + 1
        self.above = lru_cache(None)(self._above)

    def _above(self, m: int) -> int:
        """How many roots, with their multiplicity, exceed m."""
        c = list(self.scaled)
        for low in range(len(c) - 1):
            for i in range(len(c) - 2, low - 1, -1):
                c[i] += m * c[i + 1]
        signs = [v > 0 for v in c if v]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def _sign(self, m: int) -> int:
        value = 0
        for c in reversed(self.scaled):
            value = value * m + c
        return (value > 0) - (value < 0)

    def find(self, j: int) -> int:
        """The j-th largest root, counted from 1; -1 for a root 0."""
        if self.above(0) < j:
            return -1
        low, high = 0, self.high
        while high - low > 1 and not (self.above(low) == j and self.above(high) == j - 1):
            middle = (low + high) // 2
            low, high = (middle, high) if self.above(middle) >= j else (low, middle)
        before = self._sign(high) if high - low > 1 else 0
        while high - low > 1:
            # one simple root in (low, high]: the sign changes there and nowhere else
            middle = (low + high) // 2
            now = self._sign(middle)
            if before == 0:
                low, high = high - 1, high
            elif now == 0:
                low, high = middle - 1, middle
            elif now == before:
                high = middle
            else:
                low = middle
        return low


def _orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                v = v - u * (u @ v)
        out.append(v / (v @ v).sqrt())
    return out


def null_space(matrix: list[list[int]], root: Fraction, size: int) -> list[list[float]]:
    """Orthonormal basis of ``size`` vectors of the null space of matrix - root."""
    with localcontext() as context:
        context.prec = DIGITS
        exact = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        n = len(exact)
        work = exact - shift * np.array([[Decimal(int(i == j)) for j in range(n)] for i in range(n)], dtype=object)
        least = max(abs(shift), Decimal(1)) * Decimal(10) ** (20 - DIGITS)
        # Crout's factors with row exchanges, in place
        order = list(range(n))
        for k in range(n):
            pivot = max(range(k, n), key=lambda i: abs(work[i, k]))
            if pivot != k:
                work[[k, pivot]] = work[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            if abs(work[k, k]) < least:
                work[k, k] = least
            if k + 1 < n:
                work[k + 1 :, k] = work[k + 1 :, k] / work[k, k]
                work[k + 1 :, k + 1 :] = work[k + 1 :, k + 1 :] - np.outer(work[k + 1 :, k], work[k, k + 1 :])

        def solved(right: np.ndarray) -> np.ndarray:
            y = right[order].copy()
            for i in range(1, n):
                y[i] = y[i] - work[i, :i] @ y[:i]
            for i in range(n - 1, -1, -1):
                rest = work[i, i + 1 :] @ y[i + 1 :] if i + 1 < n else Decimal(0)
                y[i] = (y[i] - rest) / work[i, i]
            return y

        # start vectors that no coordinate subspace is orthogonal to
        seeds = np.random.default_rng(1).integers(1, 1000, (size, n))
        basis = _orthonormal([np.array([Decimal(int(v)) for v in row], dtype=object) for row in seeds])
        for _ in range(3):
            basis = _orthonormal([solved(v) for v in basis])
        return [[float(c) for c in v] for v in basis]


def _signed(vector: list[float]) -> list[float]:
    largest = max(range(len(vector)), key=lambda i: (abs(vector[i]), -i))
    return [-c for c in vector] if vector[largest] < 0 else vector


class Whitening:
    """What the fit has found: n, per-dimension sums, components and their eigenvalues."""

    def __init__(self, spark, n: int, sums: list[int], centre: list[int], products: list[list[int]], count: int) -> None:
        size = len(sums)
        self.n, self.sums, self.centre = n, sums, centre
        # sums of the centred values, at most n / 2 each
        self.rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
        scatter = [[n * products[i][j] - self.rest[i] * self.rest[j] for j in range(size)] for i in range(size)]
        trace = sum(scatter[i][i] for i in range(size))
        self.vectors: list[list[float]] = []
        self.values: list[float] = []
        self.explained: list[float] = []
        count = min(count, size)
        if trace == 0:
            self.vectors = [[float(i == j) for j in range(size)] for i in range(count)]
            self.values, self.explained = [0.0] * count, [0.0] * count
            return
        shared = math.gcd(*(v for row in scatter for v in row))
        matrix = [[v // shared for v in row] for row in scatter]
        roots = Roots(polynomial(spark, matrix), trace // shared)
        found = [roots.find(j) for j in range(1, count + 1)]
        done = 0
        while done < count:
            # neighbouring numbers are one root too
            end = done + 1
            while end < count and found[end - 1] - found[end] <= 1:
                end += 1
            root = Fraction(max(0, 2 * found[done] + 1), 2 << roots.bits) if found[done] >= 0 else Fraction(0)
            self.vectors += [_signed(v) for v in null_space(matrix, root, end - done)]
            for j in range(done, end):
                value = Fraction(2 * found[j] + 1, 2 << roots.bits) * shared if found[j] >= 0 else Fraction(0)
                self.values.append(float(value / n**2))
                self.explained.append(float(value / trace))
            done = end

    @property
    def live(self) -> list[int]:
        """Components of some variance."""
        return [k for k, e in enumerate(self.values) if e > 0]


def usable_rows(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return embeddings.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(F.size("vector") > 0)


def fit(rows: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """The components of all usable rows; None if there are none."""
    sizes = rows.where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST)))
    commonest = sizes.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).head()
    if commonest is None:
        return None
    dims, n = commonest["dims"], commonest["count"]
    sums = _summed(rows, dims, lambda x: sum(_sum_rows(x[i : i + ROWS]) for i in range(0, len(x), ROWS)), dims)
    centre = [round(Fraction(s, n)) for s in sums]
    upper = np.triu_indices(dims)
    middle = np.array(centre, dtype=np.int64)
    flat = _summed(rows, len(upper[0]), lambda x: _products(x - middle)[upper], dims)
    products = [[0] * dims for _ in range(dims)]
    for i, j, v in zip(*upper, flat, strict=True):
        products[i][j] = products[j][i] = v
    return Whitening(rows.sparkSession, n, sums, centre, products, count)


def _sum_rows(x: np.ndarray) -> np.ndarray:
    """Column sums as whole numbers; halves of the numbers cannot overflow in ROWS rows."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return (high.sum(axis=0).astype(object) << 32) + low.sum(axis=0).astype(object)


def _deviations(y: np.ndarray, model: Whitening) -> list[int]:
    """Sum over the dimensions of (n * x - S)², exactly, for the centred x."""
    n, rest = model.n, model.rest
    largest = int(np.abs(y).max(initial=0))
    if (n * largest + n) ** 2 * len(rest) < 1 << 62:
        return ((n * y - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    # n² y'y - 2 n y'r + r'r, the products of limbs being exact in doubles
    squares, crossed = np.zeros(len(y), dtype=object), np.zeros(len(y), dtype=object)
    limbs = _limbs(y)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            squares += (a * b).sum(axis=1).astype(np.int64).astype(object) << (LIMB * (i + j))
        for j, b in enumerate(_limbs(np.array(rest, dtype=np.int64))):
            crossed += (a * b).sum(axis=1).astype(np.int64).astype(object) << (LIMB * (i + j))
    constant = sum(r * r for r in rest)
    return [n * n * s - 2 * n * c + constant for s, c in zip(squares, crossed, strict=True)]


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (text of a whole number), whitened: one row per usable vector."""
    dims = len(model.sums)
    middle = np.array(model.centre, dtype=np.int64)
    offset = np.array([float(Fraction(r, model.n)) for r in model.rest])
    vectors = np.array(model.vectors).T
    scale = np.array([1 / math.sqrt(e) if e > 0 else 0.0 for e in model.values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, x = _integers(batch.column(1), dims)
            y = x - middle
            white = ((y.astype(np.float64) - offset) @ vectors) * scale
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(usable)),
                    pa.array([str(d) for d in _deviations(y, model)], pa.string()),
                    pa.FixedSizeListArray.from_arrays(white.ravel(), white.shape[1]).cast(pa.list_(pa.float64())),
                ],
                names=["vec_id", "deviation", "whitened"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>")


def identity_error(white: DataFrame, live: list[int]) -> float:
    """Largest entry, without sign, of the covariance of the whitened values less the identity.

    Spark's covariance centres as it goes; one row reaches the driver.
    """
    pairs = [(i, j) for i in live for j in live if i <= j]
    if not pairs:
        return 0.0
    at = [F.get("whitened", F.lit(k)) for k in range(max(live) + 1)]
    found = white.agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]).head()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whiten(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    count: int = COMPONENTS,
    steps: Steps | None = None,
) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row
    for each usable vector and component."""
    spark = embeddings.sparkSession
    rows = usable_rows(embeddings, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    model = fit(rows, count)
    if model is None:
        return spark.createDataFrame(
            [],
            f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
            "explained double, identity_error double",
        )
    steps = steps or Steps(spark)
    white = steps.write(project(rows, model))
    error = identity_error(white, model.live)
    explained = F.array(*[F.lit(e) for e in model.explained])
    at = fresh(white, "_at")
    return white.select(
        "vec_id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), F.posexplode("whitened").alias(at, "whitened")
    ).select(
        "vec_id",
        (F.col(at) + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col(at) + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
