"""Spectral divide and conquer against a standard eigensolver, and whitening against a plain computation."""

import math

import numpy as np
import pytest

from corpusworks.llm import whitening as W

SPECTRA = {
    "apart": np.arange(1.0, 41.0),
    "geometric": 2.0 ** -np.arange(40),
    "clusters": np.repeat([5.0, 5.0 + 1e-9, 1.0, 0.0], 10),
    "equal": np.ones(12),
    "rank one": np.array([3.0] + [0.0] * 20),
    "symmetric about the mean": np.array([-1.0, 0.0, 1.0] * 5),
    "two": np.array([2.0, 1.0]),
    "one": np.array([7.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components(name):
    values, draw = SPECTRA[name], np.random.default_rng(3)
    q, _ = np.linalg.qr(draw.standard_normal((len(values), len(values))))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = W.leading(a, len(values))
    scale = np.abs(values).max()
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-13 * scale * len(values))
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-13 * len(values)
    assert np.abs(a @ v - v * e).max() < 1e-13 * len(values) * scale
    few, _ = W.leading(a, 3)
    assert np.allclose(few, e[:3], atol=1e-12 * scale)


def test_polar_factor():
    draw = np.random.default_rng(4)
    a = draw.standard_normal((30, 30))
    a = a + a.T
    e, v = np.linalg.eigh(a)
    assert np.abs(W.polar(a) - (v * np.sign(e)) @ v.T).max() < 1e-12


def plain(vectors, most=4):
    """Every figure from Python integers and a standard eigensolver."""
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = [list(t) for t in {tuple(r) for r in x}]
    n, d = len(fit), len(x[0])
    sums = [sum(r[j] for r in fit) for j in range(d)]
    y = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in fit])
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for r in x:
        dev = sum((n * r[j] - sums[j]) ** 2 for j in range(d))
        for k in range(min(most, d)):
            w = sum((n * r[j] - sums[j]) / n * v[j, k] for j in range(d)) / math.sqrt(e[k])
            out.append((k + 1, n, dev, w, e[k] / e.sum()))
    return out


def check(rows, vectors, ids):
    expected = plain(vectors)
    by_row = {}
    for i, (k, n, dev, w, part) in zip(np.repeat(ids, len(expected) // len(vectors)), expected, strict=True):
        by_row.setdefault((i, k, n, dev), []).append((w, part))
    assert len(rows) == len(expected)
    signs = {}
    for r in rows:
        w, part = by_row[(r.vec_id, r.component, r.n, r.deviation)][0]
        assert abs(r.explained - part) <= 1e-10 * part and 0 <= r.identity_error < 1e-9
        assert abs(abs(r.whitened) - abs(w)) < 1e-7
        if abs(w) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(w) == np.sign(r.whitened))
    assert all(len(s) == 1 for s in signs.values())


def test_given_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    given = [(r.vec_id, r.embedding) for r in table.collect()]
    check(W.whiten(table).collect(), [v for _, v in given], [i for i, _ in given])


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, component string, x string")


def test_copies_count_once_and_every_row_gets_its_result(spark):
    draw = np.random.default_rng(8)
    vectors = [v.tolist() for v in draw.standard_normal((50, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]]
    vectors += [vectors[0]] * 300
    check(W.whiten(frame(spark, list(enumerate(vectors)))).collect(), vectors, range(len(vectors)))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (2, [0.5, -1.0, 4.0]), (None, [3.0, 0.25, -0.0]), (4, [1e-310, 5.0, 1.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [1.0, nan, 2.0]), (9, [1.0, -inf, 2.0]), (10, [1.0, 2.0])]
    got = W.whiten(frame(spark, good + bad)).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.component) for r in got) == sorted(((i is None, i or 0), k) for i, _ in good for k in (1, 2, 3))
    assert {r.n for r in got} == {4} and all(r.identity_error < 1e-9 for r in got)
    assert W.whiten(frame(spark, [])).count() == 0 and W.whiten(frame(spark, bad[:5])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0  # no variance, no component
    flat = W.whiten(frame(spark, [(1, [1.0, 7.0]), (2, [2.0, 7.0]), (3, [4.0, 7.0])])).collect()
    assert {r.component for r in flat} == {1} and all(r.explained == 1 for r in flat)


def test_large_numbers_stay_exact(spark):
    base = 2.0**44
    rows = [(i, [base + i, float(i * i), -base]) for i in range(5)]
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    n, sums = 5, [sum(c) for c in zip(*x, strict=True)]
    got = {r.vec_id: r for r in W.whiten(frame(spark, rows)).collect() if r.component == 1}
    assert {i: r.deviation for i, r in got.items()} == {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert abs(sum(r.whitened**2 for r in got.values()) / n - 1) < 1e-12
    far = W.whiten(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {(r.vec_id, r.deviation) for r in far} == {(1, None), (2, None), (3, 589825)}  # two are beyond a long
