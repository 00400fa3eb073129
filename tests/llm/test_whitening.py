"""Whitening against numpy on the test vectors, and the exact arithmetic on matrices with known roots."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import SF_DIR
from tidewatch.llm import charpoly, queries, whitening


def spectrum(matrix, most=99):
    primes = charpoly.primes_over(charpoly.coefficient_bound(matrix))
    poly = charpoly.combined(list(zip(primes, charpoly.residues(matrix, primes))))
    roots = charpoly.largest_roots(poly, most)
    return poly, [(r.low / 2**r.k, r.multiplicity) for r in roots], roots


def faddeev(matrix):
    """Coefficients by traces of powers, in fractions."""
    d = len(matrix)
    a = [[Fraction(x) for x in row] for row in matrix]
    power, out = [[Fraction(int(i == j)) for j in range(d)] for i in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        power = [[sum(a[i][m] * power[m][j] for m in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(power[i][i] for i in range(d)) / k
        out.append(c)
        for i in range(d):
            power[i][i] += c
    return [int(c) for c in out]


def test_polynomial_equals_traces():
    draw = random.Random(5)
    for d in (1, 2, 5, 9):
        rows = [[draw.randint(-(10**6), 10**6) for _ in range(d)] for _ in range(d)]
        gram = [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]
        assert spectrum(gram)[0] == faddeev(gram)


@pytest.mark.parametrize(
    ("matrix", "expected"),
    [
        (np.diag([7, 7, 7, 3, 3, 0, 0, 5]), [(7, 3), (5, 1), (3, 2)]),
        (np.ones((6, 6), int) + 3 * np.eye(6, dtype=int), [(9, 1), (3, 5)]),
        (np.zeros((3, 3), int), []),
        (np.array([[5]]), [(5, 1)]),
    ],
)
def test_repeated_roots(matrix, expected):
    _, found, roots = spectrum(matrix.tolist())
    assert found == expected
    for root in roots:
        vectors = np.array(charpoly.null_vectors(matrix.tolist(), root.low, root.k, root.multiplicity))
        assert np.allclose(vectors @ vectors.T, np.eye(root.multiplicity), atol=1e-14)
        assert np.allclose(matrix @ vectors.T, vectors.T * (root.low / 2**root.k), atol=1e-13)


def test_close_roots_are_told_apart():
    big = 10**12
    _, found, roots = spectrum([[big, 1, 0], [1, big, 0], [0, 0, big]])
    assert [m for _, m in found] == [1, 1, 1]
    assert [round(r.low / 2**r.k) for r in roots] == [big + 1, big, big - 1]
    vector = charpoly.null_vectors([[big, 1, 0], [1, big, 0], [0, 0, big]], roots[0].low, roots[0].k, 1)[0]
    assert vector == pytest.approx([math.sqrt(0.5), math.sqrt(0.5), 0], abs=1e-15)


def test_only_as_many_roots_as_asked():
    assert [m for _, m in spectrum(np.diag([9, 8, 8, 8, 1]).tolist(), most=2)[1]] == [1, 3]


def test_products_are_exact():
    draw = random.Random(2)
    rows = [[draw.randint(-(2**62), 2**62), draw.randint(-9, 9), 0] for _ in range(50)]
    found = whitening.products(np.array(rows, dtype=np.int64))
    assert found.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]


def test_embeddings_equal_numpy(spark):
    got = queries.QUERIES["op11_whitening"](spark, SF_DIR).toPandas()
    table = pd.read_parquet(f"{SF_DIR}/embeddings.parquet")
    x = np.floor(64 * np.stack(table["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(np.cov((x - x.mean(0)).T, bias=True))
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    got = got.sort_values(["vec_id", "component"])
    assert got["component"].tolist() == list(range(1, 33)) * n
    ids = table["vec_id"].sort_values().tolist()
    assert got["vec_id"].tolist() == [i for i in ids for _ in range(32)]
    order = table["vec_id"].argsort().to_numpy()
    white = got["whitened"].to_numpy().reshape(n, 32)
    expected = ((x - sums / n) @ vectors / np.sqrt(values))[order]
    signs = np.sign((white * expected).sum(0))
    assert np.abs(white - expected * signs).max() < 1e-6
    assert np.abs(np.cov(white.T, bias=True) - np.eye(32)).max() < 1e-9
    total = np.trace(np.cov((x - x.mean(0)).T, bias=True))
    assert np.allclose(got["explained"].to_numpy()[:32], values / total, rtol=1e-9)
    assert got["deviation"].tolist() == [int(v) for v in ((n * x - sums) ** 2).sum(1)[order] for _ in range(32)]
    assert set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], "x"), (2, None, "x"), (3, [nan, 1.0], "x"), (4, [None, 2.0], "x"), (5, [3.0], None),
        (6, [], "x"), (None, [4.0, 2.0], "x"), (7, [1e300, 1.0], "x"), (8, [2.0, 5.0], "x"), (8, [2.0, 5.0], "x"),
        (9, [-inf, 0.0], "x"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, v array<double>, deviation string")
    got = whitening.whitened(frame, "vec_id", "v").toPandas()
    kept = np.array([[64, 128], [192, 0], [0, 0], [256, 128], [128, 320], [128, 320]])
    assert len(got) == 2 * len(kept) and got["vec_id"].isna().sum() == 2
    wide = len(kept) * kept - kept.sum(0)
    assert sorted(int(v) for v in got["deviation"]) == sorted(2 * [int(v) for v in (wide**2).sum(1)])
    assert got["identity_error"].max() < 1e-12


def test_exact_beyond_a_long(spark):
    rows = [(1, [9e15]), (2, [-9e15]), (3, [0.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v").toPandas()
    assert {i: int(v) for i, v in zip(got["i"], got["deviation"])} == {
        3: 0, 1: (3 * 64 * 9 * 10**15) ** 2, 2: (3 * 64 * 9 * 10**15) ** 2,
    }
    assert got["whitened"].abs().max() == pytest.approx(math.sqrt(1.5))


def test_too_large_for_a_decimal_is_null(spark):
    rows = [(1, [9e16]), (2, [-9e16]), (3, [0.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v").toPandas()
    assert got.set_index("i")["deviation"].isna().to_dict() == {1: True, 2: True, 3: False}
    assert got["whitened"].abs().max() == pytest.approx(math.sqrt(1.5))


def test_without_variance_or_rows(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], "i long, v array<float>"), "i", "v").collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, None, None, 0.0), (2, None, None, 0.0),
    ]
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 2.0])], "i long, v array<float>")
    second = whitening.whitened(flat, "i", "v").where("component = 2").collect()
    assert [(r["whitened"], r["explained"]) for r in second] == [(None, 0.0)] * 2
    assert whitening.whitened(spark.createDataFrame([], "i long, v array<float>"), "i", "v").count() == 0
