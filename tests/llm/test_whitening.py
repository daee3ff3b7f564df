"""Whitening against the eigenvectors of the covariance matrix."""

import math

import numpy as np
import pytest

from lorekeep.llm import embedding_whitening as ew
from tests.llm.odd import with_clashing_columns

SF = "/root/testdata/sf0.001"


def plain(rows, components=32):
    """(ids, n, deviations, eigenvalues, vectors, whitened up to sign, trace) of the kept rows."""
    lengths = [len(v) for _, v in rows if v]
    dim = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = [(i, v) for i, v in rows if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return [i for i, _ in kept], n, deviations, e, v, centred @ v / np.sqrt(e), np.trace(centred.T @ centred / n)


def compare(got, rows):
    ids, n, deviations, e, _, w, trace = plain(rows)
    k = len(e)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    signs = [1 if by[ids[0]][c + 1].whitened * w[0][c] > 0 else -1 for c in range(k)]
    for i, d, row in zip(ids, deviations, w, strict=True):
        for c in range(k):
            r = by[i][c + 1]
            assert r.deviation == d
            assert r.whitened == pytest.approx(signs[c] * row[c], abs=1e-6)
            assert r.explained == pytest.approx(e[c] / trace, rel=1e-9)
            assert r.identity_error <= 1e-9


def test_query_equals_the_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(ew.op11_embedding_whitening(spark, SF).collect(), rows)


def test_dropped_rows_and_odd_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [3, 1, 0.5, 2, 1]).tolist()) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 2.0, 3.0, 4.0]), (103, [1.0, float("inf"), 2.0, 3.0, 4.0]), (104, []), (105, [1.0])]
    df = with_clashing_columns(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "n", "component", "whitened", "dim")
    compare(ew.whiten(df, ew.fit(df)).collect(), rows)


def test_triangles_are_joined_over_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    compare(ew.whiten(df, ew.fit(df)).collect(), rows)


def test_repeated_and_equal_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<float>")
    assert ew.fit(same) is None and ew.whiten(same, None).collect() == []
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, [3.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ew.whiten(df, ew.fit(df)).collect()
    assert len(got) == 8 and {r.n for r in got} == {4}
    assert sum(r.whitened for r in got if r.component == 1) == pytest.approx(0, abs=1e-9)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ew.whiten(empty, ew.fit(empty)).collect() == []


def test_components_without_spread_give_no_rows(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.component for r in ew.whiten(df, ew.fit(df)).collect()} == {1}


def test_small_deviations_keep_their_digits():
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.normal(size=(300, 7)))
    spread = np.array([1e6, 1e3, 1.0, 1.0, 1e-2, 1e-4, 1e-5])
    turn, _ = np.linalg.qr(rng.normal(size=(7, 7)))
    lengths, v = ew.jacobi(np.linalg.qr(q * spread, mode="r"))
    assert np.allclose(lengths, spread, rtol=1e-10)
    lengths, v = ew.jacobi(np.linalg.qr((q[:, :5] * spread[:5]) @ turn[:5], mode="r"))
    assert np.allclose(lengths[:4], spread[:4], rtol=1e-8) and np.allclose(v.T @ v, np.eye(7), atol=1e-12)


def test_exact_deviation_beyond_doubles():
    model = ew.Whitening(3, [3 * 10**6 + 1, 5 * 10**6], np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[10**6 + 2**31, 10**6], [10**6, 2 * 10**6 + 2**29]])
    assert model.deviation(x) == [d if d < 2**63 else None for d in (sum((3 * int(c) - s) ** 2 for c, s in zip(r, model.sums, strict=True)) for r in x)]
