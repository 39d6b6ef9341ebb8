"""Whitening by TSQR against a decomposition of the covariance."""

import numpy as np
import pytest
from conftest import DATA

from tallyloom.llm import whitening
from tallyloom.llm._util import Scratch


def usable(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v)


def check(rows, out):
    rows = [(i, v) for i, v in rows if usable(v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    off = fit - total / n
    e, axes = np.linalg.eigh(off.T @ off / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(16, int((e > e[0] * 1e-13).sum()))
    got = sorted(out, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in got] == sorted((i, c) for i, _ in rows for c in range(1, k + 1))
    order = np.argsort([i for i, _ in rows], kind="stable")
    w = np.array([r.whitened for r in got]).reshape(-1, k)
    want = ((x - total / n) @ axes[:, :k] / np.sqrt(e[:k]))[order]
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - sign * want).max() < 1e-6
    assert [r.deviation for r in got[::k]] == ((n * x - total) ** 2).sum(axis=1)[order].tolist()
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-10
    assert np.allclose([r.explained for r in got[:k]], e[:k] / e.sum(), rtol=1e-9)


def test_given_table(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in e.collect()], whitening.whiten(e).collect())


@pytest.mark.parametrize("partitions", [1, 40])
def test_copies_count_once(spark, partitions):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(200, 20)) @ rng.normal(size=(20, 20))).tolist()
    rows = [(i, base[0] if i % 3 == 0 else base[i % 200]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(partitions)
    check(rows, whitening.whiten(df).collect())


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 2.0]), (2, [3.0, float("nan"), 1.0]), (3, [float("-inf"), 1.0, 1.0]), (4, [1.0, None, 0.0]), (5, None), (6, []), (7, [5.0, 2.5, 2.0]), (7, [5.0, 2.5, 2.0]), (8, [4.0, 1.5, 2.0]), (9, [1.0]), (None, [1.0, 2.0, 2.0]), (10, [1e300, 0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, x string")).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i in (1, 7, 7, 8, None) for _ in range(2))  # a constant dimension has no component
    assert max(r.identity_error for r in got) < 1e-10
    for none in ([], [(1, None)], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        assert whitening.whiten(spark.createDataFrame(none, "vec_id long, embedding array<double>")).count() == 0


def test_deviations_beyond_a_long():
    x = np.array([[0, 10**12], [3, 10**12 + 2]], np.int64)
    n, sums = 10**7, (10**7, 10**19)
    assert whitening.deviations(x, n, sums) == [(10**7) ** 2, (2 * 10**7) ** 2 + (2 * 10**7) ** 2]
    assert whitening.deviations(x, 10**10, (10**10, 10**22)) == [None, None]


def test_factors_merge_in_any_number(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.integers(-50, 50, 6).tolist(),) for _ in range(500)]
    for parts in (1, 9, 70):
        fit = spark.createDataFrame(rows, "x array<long>").repartition(parts)
        m = whitening.fitted(fit, Scratch(spark, "t"))
        x = np.array([r[0] for r in rows])
        assert m.n == 500 and m.sums == tuple(x.sum(axis=0).tolist())
        assert np.allclose(m.eigenvalues, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])
