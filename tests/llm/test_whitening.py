"""Operator 13 against a dense eigensolver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.llm import whitening
from cutline.llm.whitening import Spectrum, rank_one
from tests.llm.cases import clashing, save

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.01"


def matrices():
    rng = np.random.default_rng(5)
    for t in range(200):
        k = int(rng.integers(1, 24))
        a = rng.normal(size=(k, k))
        a[:, : (k // 2) * (t % 3 == 0)] = 0  # half the eigenvalues are 0
        m = a @ a.T
        m = np.eye(k) * 3 if t % 5 == 0 else m  # all are equal
        m = np.diag(rng.integers(0, 3, k).astype(float)) if t % 7 == 0 else m  # groups are equal
        v = rng.normal(size=k) * 10 ** rng.uniform(-8, 4)
        v = v * (rng.random(k) < 0.5) if t % 4 == 0 else v  # some components are untouched
        yield m, v


def test_rank_one_update():
    for m, v in matrices():
        d, q = np.linalg.eigh(m)
        values, vectors = rank_one(np.maximum(d, 0), q, v)
        whole = (q * np.maximum(d, 0)) @ q.T + np.outer(v, v)
        assert np.abs((vectors * values) @ vectors.T - whole).max() <= 1e-13 * max(np.abs(whole).max(), 1e-300) * 10
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
        assert (np.diff(values) >= 0).all()


def test_spectra_combine():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(700, 12)) * rng.uniform(5, 300, 12)).astype(np.int64)
    x[40:90] = x[40]
    off = x - x.mean(0)
    want = np.linalg.eigvalsh(off.T @ off)
    total = Spectrum.empty(12)
    for part in np.split(x, [1, 2, 9, 9, 300]):
        held = Spectrum.empty(12)
        for row in part:
            held.add(row)
        total.merge(Spectrum.of(*held.row()))
    assert np.allclose(total.values, want, rtol=1e-11)
    assert total.n == 700 and (total.sums == x.sum(0)).all() and np.allclose(total.mean, x.mean(0))


def dense(vectors):
    """Count, exact deviations, coordinates and shares by numpy alone, eight components."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(dim)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    off = np.array(x, float) - np.array(sums) / n
    e, w = np.linalg.eigh(off.T @ off / n)
    e, w = e[::-1][:8], w[:, ::-1][:, :8]
    return n, deviation, off @ w / np.sqrt(e), e / np.trace(off.T @ off / n)


def check(rows, vectors, ids, tolerance=1e-8):
    n, deviation, white, explained = dense(vectors)
    count = min(8, white.shape[1])
    assert len(rows) == len(vectors) * count
    order = {}
    for k, i in enumerate(ids):
        order.setdefault(i, []).append(k)
    signs = np.zeros(count)
    for r in rows:
        k, c = order[r.vec_id][0], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[k])
        assert r.explained == pytest.approx(explained[c], rel=1e-9)
        assert r.identity_error < 1e-9
        if not signs[c] and abs(white[k, c]) > 1e-3:
            signs[c] = np.sign(white[k, c] * r.whitened)
        assert r.whitened == pytest.approx(signs[c] * white[k, c], abs=tolerance)


def test_op13(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = whitening.op13_whitening(spark, SF).collect()
    check(rows, [r.embedding for r in table], [r.vec_id for r in table])


def test_op13_many_tasks_and_edges(spark, tmp_path):
    rng = np.random.default_rng(0)
    vectors = [(rng.normal(size=10) * np.arange(1, 11) / 20).tolist() for _ in range(400)]
    rows = [(k, v, 0) for k, v in enumerate(vectors)]
    rows += [(7, vectors[7], 1), (7, vectors[7], 1)]  # repeated rows
    nan, inf = float("nan"), float("inf")
    bad = [None, [None] * 10, [nan] * 10, [inf, *[0.0] * 9], [-inf, *[0.0] * 9], [], [0.5], [0.25] * 11]
    kept = list(rows)
    rows += [(1000 + k, v, 0) for k, v in enumerate(bad)]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(40), "component", "n", "whitened", "part", "size")
    folder = save(df, tmp_path, "embeddings")
    # More tasks than one level combines.
    got = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet").repartition(40)).collect()
    floats = [np.array(v, np.float32).tolist() for _, v, _ in kept]
    check(got, floats, [k for k, _, _ in kept])
    assert {r.vec_id for r in whitening.op13_whitening(spark, folder).collect()} == {k for k, _, _ in kept}


def test_op13_null_ids_and_low_rank(spark):
    rows = [(None if k % 7 == 0 else k, [k / 64.0, k / 32.0, 1.0], 0) for k in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 50 and {r.component for r in got} == {1}  # one direction has all variance
    assert sum(r.vec_id is None for r in got) == 8
    assert all(r.explained == pytest.approx(1.0) and r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("vectors", [[], [None], [[0.5, 0.25]], [[0.5, 0.25]] * 4, [[]], [[], [1.0]]])
def test_op13_without_variance(spark, vectors):
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], SCHEMA)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert not out.collect()


def test_deviation_beyond_long(spark):
    """A sum of squares that no long holds is NULL; the exact integers decide."""
    big = spark.range(3).select(F.col("id").alias("vec_id"), F.array(F.col("id") * 1e6, F.col("id") * 0.5).alias("embedding"))
    x = [[math.floor(1024 * c) + 100_000 for c in (k * 1e6, k * 0.5)] for k in range(3)]
    sums = [sum(r[k] for r in x) for k in range(2)]
    exact = [sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    want = [v if v < 2**63 else None for v in exact]
    assert want[1] is not None and want[0] is None
    got = {r.vec_id: r.deviation for r in whitening.whiten(big).filter("component = 1").collect()}
    assert got == dict(enumerate(want))
