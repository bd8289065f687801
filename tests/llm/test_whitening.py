"""Whitening of embeddings against numpy and exact fractions."""

import random
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from credsieve.llm import whitening
from llm.cases import CLASHING
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dims)) * np.linspace(2, 0.1, dims)).astype(np.float32).tolist()


def exact(rows):
    """x, n * x - S and the covariance times n² in whole numbers."""
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * c - s for c, s in zip(v, sums)] for v in x]
    return x, y, n


def test_rows_through_the_query(spark, tmp_path):
    rows = vectors(300, 12)
    odd = [(900, None, 1), (901, [None] + [0.5] * 11, 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, None), (904, [], 1), (905, [1.0] * 3, 1)]
    table = [(i, v, i % 3) for i, v in enumerate(rows)] + [(7, rows[7], 1), (None, rows[8], None)]
    used = [v for _, v, _ in table]
    df = spark.createDataFrame(table + odd, SCHEMA).select("*", *[F.lit(v).alias(c) for c, v in CLASHING.items()])
    df.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["op12_embedding_whitening"](spark, str(tmp_path)).collect()
    _, y, n = exact(used)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    z = np.array(y, float) / n
    values, basis = np.linalg.eigh(z.T @ z / n)
    values, basis = values[::-1], basis[:, ::-1]
    expected = z @ basis[:, :8] / np.sqrt(values[:8])
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    for i, v in enumerate(table):
        mine = [r for r in by_id[v[0]]]
        assert {r.deviation for r in mine} == {sum(c * c for c in y[i])}
    signs = {r.component: np.sign(r.whitened * expected[0, r.component - 1]) for r in by_id[0]}
    for i in range(1, 300):
        for r in by_id[i]:
            assert r.whitened * signs[r.component] == pytest.approx(expected[i, r.component - 1], abs=1e-9)
            assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)


def test_polynomial_is_exact(spark):
    rng = random.Random(2)
    a = [[rng.randrange(-9, 10) for _ in range(5)] for _ in range(7)]
    m = [[sum(r[i] * r[j] for r in a) for j in range(5)] for i in range(5)]
    found = whitening.polynomial(spark, m)

    def det(rows):
        if len(rows) == 1:
            return rows[0][0]
        return sum((-1) ** j * rows[0][j] * det([r[:j] + r[j + 1 :] for r in rows[1:]]) for j in range(len(rows)))

    for x in range(-2, 4):
        assert sum(c * x**i for i, c in enumerate(found)) == det([[x * (i == j) - m[i][j] for j in range(5)] for i in range(5)])


def test_roots_are_isolated_with_multiplicity():
    # (x - 1)² (x - 2) (x² - 6x + 7) with roots 3 ± sqrt 2
    def times(p, q):
        out = [0] * (len(p) + len(q) - 1)
        for i, a in enumerate(p):
            for j, b in enumerate(q):
                out[i + j] += a * b
        return out

    p = times(times(times([-1, 1], [-1, 1]), [-2, 1]), [7, -6, 1])
    roots = whitening.Roots(p, 11)
    found = [Fraction(2 * roots.find(j) + 1, 2 << roots.bits) for j in range(1, 6)]
    for f, e in zip(found, [3 + 2**0.5, 2, 3 - 2**0.5, 1, 1]):
        assert float(f) == pytest.approx(e, rel=1e-15)
    assert roots.find(4) == roots.find(5)
    assert abs((found[0] - 3) ** 2 - 2) < Fraction(1, 1 << 200)


@pytest.mark.parametrize("case", ["ties", "few", "constant", "one", "empty", "large"])
def test_awkward_tables(spark, case):
    rows = {
        # two equal eigenvalues, exactly
        "ties": [[x, y, 0.25] for x in (-1.0, 1.0) for y in (-1.0, 1.0)],
        "few": vectors(3, 10),
        "constant": [[0.5, 0.25, 1.0]] * 6,
        "one": [[0.5, 0.25]],
        "empty": [],
        "large": [[1e12 * x, x * x, x**3] for x in (-3.0, 1.0, 2.0, 7.0)],
    }[case]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(df).collect()
    dims = len(rows[0]) if rows else 0
    assert len(got) == len(rows) * min(8, dims)
    if not rows:
        return
    x, y, n = exact(rows)
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(i, sum(c * c for c in v)) for i, v in enumerate(y)}
    white = np.zeros((n, min(8, dims)))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    z = np.array([[float(Fraction(c, n)) for c in v] for v in y])
    rank = np.linalg.matrix_rank(z / max(1.0, np.abs(z).max())) if case != "large" else 3
    for k in range(min(8, dims)):
        variance = white[:, k] @ white[:, k] / n
        assert variance == pytest.approx(1.0 if k < rank else 0.0, abs=1e-6)
    assert got[0].identity_error <= 1e-6
    assert sum({r.component: r.explained for r in got}.values()) <= 1 + 1e-9


def test_limbs_carry_any_size():
    rng = np.random.default_rng(0)
    y = rng.integers(-(1 << 60), 1 << 60, (50, 3))
    expected = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(3)] for i in range(3)]
    assert whitening._products(y).tolist() == expected
    for v in [0, 1, -1, 1 << 35, -(1 << 35), (1 << 200) - 7, -(1 << 130)]:
        assert sum(p << (whitening.PART * limb) for _, limb, p in whitening._parts([v])) == v
