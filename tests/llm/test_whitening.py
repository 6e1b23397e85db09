"""Whitening against numpy on the whole matrix, and block Lanczos on operators with repeated and vanishing eigenvalues."""

import math

import numpy as np
import pytest

from inkwell.llm import whitening as W


def plain(vectors, d, wanted=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (d - len(v))]] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    moved = x * n - total
    c = moved.astype(float) / n
    values, found = np.linalg.eigh(c.T @ c / n)
    order = [i for i in np.argsort(-values)[:wanted] if values[i] > 1e-11 * values.max()]
    return [int((m * m).sum()) for m in moved], c, values[order], found[:, order], np.trace(c.T @ c / n)


def check(out, ids, vectors, d):
    dev, c, values, found, trace = plain(vectors, d)
    z = c @ found / np.sqrt(values)
    by = {}
    for r in out:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, len(values) + 1)) and len(out) == len(ids) * len(values)
    key = lambda i, v, w: (str(i), v, round(w, 4))
    for k, mine in by.items():
        got = sorted(key(r["vec_id"], r["deviation"], r["whitened"]) for r in mine)
        want = [sorted(key(i, v, s * w) for i, v, w in zip(ids, dev, z[:, k - 1], strict=True)) for s in (1, -1)]
        close = [all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(got, w, strict=True)) for w in want]
        gap = min((abs(values[k - 1] - v) for j, v in enumerate(values) if j != k - 1), default=1.0)
        assert any(close) or gap < 1e-6 * values[0]
        assert all(abs(r["explained"] - values[k - 1] / trace) <= 1e-6 * values[k - 1] / trace and r["n"] == len(ids) and r["identity_error"] <= 1e-6 for r in mine)


def test_odd_rows(spark, odd):
    rows = spark.read.parquet(f"{odd}/embeddings.parquet").collect()
    good = [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    check(W.op11_whitening(spark, odd).collect(), [i for i, _ in good], [v for _, v in good], 8)


def test_more_dimensions_than_components(spark):
    pick = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in pick.standard_normal(50) * np.linspace(5, 1, 50)], i) for i in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, n int").repartition(7)
    check(W.whiten(df).collect(), [v[0] for v in vectors], [v[1] for v in vectors], 50)
    few = W.whiten(df, wanted=5, block=2).collect()  # narrow blocks take more passes to the same directions
    _, c, values, found, trace = plain([v[1] for v in vectors], 50, 5)
    assert {r["component"] for r in few} == {1, 2, 3, 4, 5}
    for r in few:
        assert abs(abs(r["whitened"]) - abs(c[r["vec_id"]] @ found[:, r["component"] - 1]) / math.sqrt(values[r["component"] - 1])) < 1e-5


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]], [[1.0], [2.0, 5.0], [], [3.0, 1.0, 7.0]], [[1e300, 1.0], [-1e300, 2.0], [0.0, 3.0]], [[1e12, 1.0]] * 3 + [[0.5, 0.25]]])
def test_few_equal_ragged_and_huge(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out = W.whiten(df).collect()
    d = max(map(len, vectors))
    if len({tuple(v) for v in vectors}) == 1:
        assert out == []
    elif max((abs(c) for v in vectors for c in v), default=0) < 1e5:
        check(out, list(range(len(vectors))), vectors, d)
    else:
        assert out and all(math.isfinite(r["whitened"]) for r in out)


def test_deviations_are_exact():
    pick = np.random.default_rng(1)
    for most in (2**10, 2**31, 2**45, 2**60):
        moved = pick.integers(-most, most, (50, 130))
        assert W.deviations(moved) == [sum(int(v) ** 2 for v in row) for row in moved]
    assert W.centred(np.array([[2**52, 1]]), 2**40, [5, 7]).tolist() == [[2**92 - 5, 2**40 - 7]]


@pytest.mark.parametrize("values", [np.ones(40), np.r_[np.full(20, 3.0), np.full(20, 1.0)], np.r_[5.0, 5.0, 5.0, np.zeros(37)], np.linspace(1, 2, 90) ** 8, np.r_[1e6, np.full(30, 1.0), np.linspace(0.1, 0.9, 60)]])
@pytest.mark.parametrize("block", [4, 32])
def test_lanczos(values, block):
    """Repeated eigenvalues, invariant subspaces and a wide spectrum: residuals and order are right, and no column is lost.
    Blocks narrower than a multiplicity rely on restarts."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((d, d)))[0]
    v = (q * values) @ q.T
    got, found, told = W.lanczos(lambda b: v @ b, d, 32, block)
    if block == 32:
        assert np.allclose(got, np.sort(values)[::-1][:32], atol=1e-9 * values.max())
    assert np.allclose(found.T @ found, np.eye(32), atol=1e-10)
    assert np.linalg.norm(v @ found - found * got) <= 1e-9 * values.max()
    if block == 4 and len(set(values)) <= 2:
        assert told["restarts"]


def test_extra_columns_and_names(spark):
    rows = [(i, [float(i % 5), float(i % 3)], 1, 2.0, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, whitened double, n string")
    assert W.whiten(df).count() == 60 and W.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
