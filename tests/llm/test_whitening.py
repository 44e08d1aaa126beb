"""Whitening against a dense eigendecomposition in numpy, with exact counts in Python's integers."""

import math

import numpy as np
import pytest

from lodestar.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, id string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, "c", "x", 2) for i, v in rows], SCHEMA)


def vectors(n, dim, seed, scale=None):
    r = np.random.default_rng(seed)
    return (r.standard_normal((n, dim)) * (scale if scale is not None else 1)).astype(np.float32)


def check(got, kept, k=8):
    """got: rows; kept: (id, vector) that take part."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums).astype(float) / n
    cov = centred.T @ centred / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(k, int((values > 1e-10 * values[0]).sum()))
    assert len(got) == n * k
    deviation = {(i, int(((row * n - sums) ** 2).sum())) for (i, _), row in zip(kept, x, strict=True)}
    assert {(r["vec_id"], r["deviation"]) for r in got} == deviation
    assert {r["n"] for r in got} == {n}
    assert all(r["identity_error"] < 1e-9 for r in got)
    expected = centred @ vecs[:, :k] / np.sqrt(values[:k])
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r["whitened"]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    for c in range(1, k + 1):
        mine = np.array([by[c][i] for i, _ in kept])
        sign = np.sign(mine @ expected[:, c - 1])
        assert np.abs(mine * sign - expected[:, c - 1]).max() < 1e-7


def test_equals_a_dense_decomposition(spark):
    scale = np.linspace(2, 0.2, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(400, 24, 1, scale))]
    check(whitening.op12(table(spark, rows).repartition(5)).collect(), rows)


def test_a_flat_spectrum_widens_the_block(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(600, 40, 2))]
    saved = whitening.usable(table(spark, rows)).cache()
    passes, plain = [], whitening.image
    try:
        whitening.image = lambda *a: passes.append(a[3].shape[1]) or plain(*a)
        whitening.fit(saved)
    finally:
        whitening.image = plain
    assert passes[0] == 16 and passes[-1] == 40 and len(passes) < 8
    check(whitening.op12(table(spark, rows)).collect(), rows)


def test_gaps_need_no_wider_block(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(300, 60, 3, np.r_[np.linspace(90, 60, 8), np.full(52, 0.01)]))]
    passes, plain = [], whitening.image
    try:
        whitening.image = lambda *a: passes.append(a[3].shape[1]) or plain(*a)
        got = whitening.op12(table(spark, rows)).collect()
    finally:
        whitening.image = plain
    assert max(passes) == 16
    check(got, rows)


def test_what_takes_no_part(spark):
    good = [(i, v.tolist()) for i, v in enumerate(vectors(50, 5, 4))] + [(900, [0.0] * 5), (901, [0.0] * 5)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0, 0, 0]), (103, [math.nan, 0, 0, 0, 0]), (104, [math.inf, 0, 0, 0, 0]), (105, [1.0, 2.0]), (106, [1e30, 0, 0, 0, 0])]
    check(whitening.op12(table(spark, good + bad)).collect(), good)


def test_repeated_and_null_ids_stay(spark):
    v = vectors(30, 4, 5).tolist()
    got = whitening.op12(table(spark, [(None if i % 3 == 0 else i // 2, x) for i, x in enumerate(v)])).collect()
    assert len(got) == 30 * 4
    assert sum(r["vec_id"] is None for r in got) == 10 * 4


def test_no_spread_or_no_rows(spark):
    assert whitening.op12(table(spark, [])).count() == 0
    assert whitening.op12(table(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert whitening.op12(table(spark, [(1, [1.0, 2.0])])).dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def test_fewer_components_than_eight(spark):
    base = vectors(40, 2, 6)
    rows = [(i, [float(a), float(b), float(a)]) for i, (a, b) in enumerate(base)]
    check(whitening.op12(table(spark, rows)).collect(), rows)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 7)), float(i), -float(2**45 * (i % 3))]) for i in range(40)]
    got = whitening.op12(table(spark, rows)).collect()
    x = [[1024 * int(c) + 100000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = {i: sum((40 * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for i, row in enumerate(x)}
    assert got and all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 1 << 63 else None) for r in got)
