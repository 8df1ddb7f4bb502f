"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import whitening
from tests.llm import util

SCHEMA = "vec_id long, embedding array<float>, label int"


def quantised(v):
    return [int(np.floor(256.0 * float(np.float32(c)))) for c in v]


def check(rows, vectors, ids, k=4):
    """rows against brute force over the vectors of one length."""
    xs = [quantised(v) for v in vectors]
    fit = np.array(sorted(set(map(tuple, xs))), dtype=float)
    n, total = len(fit), fit.astype(int).sum(axis=0)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    by = {}
    for r in rows:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, min(k, len(total)) + 1))
    for c, found in by.items():
        assert sum(map(len, found.values())) == len(ids)
        expected = (np.array(xs) - fit.mean(axis=0)) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        got = np.array([found[i][0].whitened for i in ids])
        sign = np.sign(got @ expected)
        assert np.abs(got * sign - expected).max() < 1e-8
        for i, x in zip(ids, xs):
            r = found[i][0]
            assert r.n == n and r.deviation == sum((n * a - int(s)) ** 2 for a, s in zip(x, total))
            assert abs(r.explained - values[c - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-8


def test_op12_against_eigenvectors(spark, tmp_path):
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(700, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + 5).astype(np.float32).tolist()
    vectors += [vectors[0]] * 300  # a hot vector counts once
    rows = [(k, v, 1) for k, v in enumerate(vectors)]
    bad = [(9001, None, 1), (9002, [None] + vectors[0][1:], 1), (9003, [float("nan")] * 12, 1), (9004, [float("inf")] + vectors[1][1:], 1), (9005, [], 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(13)
    sf = util.write(spark, tmp_path, embeddings=util.clash(df))
    got = whitening.op12_whitening(spark, sf).collect()
    check(got, vectors, list(range(len(vectors))))


def test_lengths_are_spaces_of_their_own(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=(60, 5)).astype(np.float32).tolist(), r.normal(size=(50, 2)).astype(np.float32).tolist()
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(a + b)], SCHEMA)
    done = whitening.whiten(df).select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    rows = done.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error").collect()
    check([x for x in rows if x.vec_id < 60], a, list(range(60)))
    check([x for x in rows if x.vec_id >= 60], b, list(range(60, 110)))


def test_no_variance_and_no_rows(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], SCHEMA)
    got = whitening.whiten(flat).collect()
    assert len(got) == 3
    assert all(r.n == 1 and r.deviation == 0 and r.whitened == [None, None] and r.explained == [None, None] and r.identity_error is None for r in got)
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], 0) for k in range(40)], SCHEMA)
    for r in whitening.whiten(line).collect():
        assert r.whitened[0] is not None and r.whitened[1] is None and r.explained[1] == 0.0 and r.identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_merges_keep_all_dimensions():
    r = np.random.default_rng(5)
    x = r.integers(-900, 900, size=(500, 9))
    whole = whitening.Summary.of(x)
    cuts = [0, 3, 4, 200, 350, 500]
    merged = whitening.Summary.of(x[cuts[0] : cuts[1]])
    for a, b in zip(cuts[1:], cuts[2:]):
        merged = merged.merge(whitening.Summary.of(x[a:b]))
    assert merged.n == 500 and merged.sums == whole.sums
    assert np.abs(merged.singular - whole.singular).max() < 1e-9 * whole.singular[0]
    for s in (whole, merged):
        scatter = s.vectors.T @ np.diag(s.singular**2) @ s.vectors
        c = x - x.mean(axis=0)
        assert np.abs(scatter - c.T @ c).max() < 1e-6


def test_deviation_beyond_a_long(spark):
    big = spark.createDataFrame([(1, [1e14], 0), (2, [-1e14], 0), (3, [0.5], 0)], SCHEMA)
    got = {r.vec_id: r.deviation for r in whitening.whiten(big).collect()}
    xs = {1: quantised([1e14])[0], 2: quantised([-1e14])[0], 3: 128}
    total = sum(xs.values())
    for k, x in xs.items():
        exact = (3 * x - total) ** 2
        assert got[k] == (exact if exact < 1 << 63 else None) or got[k] is None


@pytest.mark.parametrize("step", [1, 7])
def test_leaf_of_few_rows(spark, step, monkeypatch):
    monkeypatch.setattr(whitening, "LEAF_ROWS", step)
    x = np.arange(40).reshape(20, 2) ** 2 % 17
    s = whitening.Summary.of(x[:1])
    for k in range(1, 20, step):
        s = s.merge(whitening.Summary.of(x[k : k + step]))
    assert s.n == 20 and s.sums == x.sum(axis=0).tolist()
