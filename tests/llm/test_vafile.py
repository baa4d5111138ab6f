import math
from fractions import Fraction

import numpy as np
import pytest

from oracle import rows
from entailis.llm import vafile
from entailis.llm.queries import OP3_SQL, op3_topk
from oracle import connect, same


def brute(vectors, is_query, k):
    held = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted(set((i, tuple(q)) for i, q in held)):
        if is_query(i):
            scores = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in held if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def run(spark, vectors, k=5, step=2):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "'x' as score", "1 as v")
    return rows(vafile.top_k(df, lambda i: i % step == 0, k)), brute(vectors, lambda i: i % step == 0, k)


def test_query(spark, data):
    same(op3_topk(spark, data), connect(data), OP3_SQL)


def test_random_and_tied(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.integers(-2, 3, 6) / 2).tolist()) for i in range(120)]
    got, expected = run(spark, vectors)
    assert got == expected


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (2, [0.0, 0.0]), (4, None), (6, [None, 1.0]), (8, [nan, 1.0]), (10, [inf, 1.0]), (1, [1.0, 2.0]), (3, [1.0]), (12, [2.0]), (14, []), (None, [1.0, 1.0]), (5, [-1.0, 0.5]), (5, [-1.0, 0.5]), (16, [-0.001, 0.001])]
    got, expected = run(spark, vectors)
    assert got == expected


@pytest.mark.parametrize("most", [15, 19, 60, 308])
def test_every_finite_component_takes_part(spark, most):
    vectors = [(i, [(-1.0) ** i * 10.0 ** (most - i % 16), 1.0 + i / 7]) for i in range(40)]
    got, expected = run(spark, vectors)
    assert got == expected
    assert {i for _, _, i, _ in got} and len(got) == 20 * 5


def test_wide_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, 1024)
    # Many nearly equal scores, whose order single precision cannot tell.
    vectors = [(i, (base + rng.normal(0, 1e-3, 1024)).tolist()) for i in range(60)]
    got, expected = run(spark, vectors)
    assert got == expected


def test_blocks_and_files(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK_BYTES", 500)
    monkeypatch.setattr(vafile, "FILE_BYTES", 16 * 64)
    rng = np.random.default_rng(4)
    got, expected = run(spark, [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(90)], k=3)
    assert got == expected


def test_empty(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(0, [1.0])])[0] == []


@pytest.mark.parametrize("cells", [2, 256])
def test_bounds_hold(cells):
    rng = np.random.default_rng(5)
    exact, q = rng.integers(-130, 130, (200, 16)).astype(float), rng.integers(-130, 130, (9, 16)).astype(float)
    file = vafile.ApproximationFile(np.arange(200), exact, 1, cells)
    assert (file.bounds(q) >= q @ exact.T).all()
