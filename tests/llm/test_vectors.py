"""Whitening and centroid clustering against plain numpy."""

import hashlib
import math

import numpy as np
import pytest

from cohortloom.llm import vafile as V
from cohortloom.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int, n int, key string, x double, cluster string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "k", 0.5, "c") for i, v in rows], SCHEMA)


def edge_rows(width, count, seed=3):
    rng = np.random.default_rng(seed)
    base = (rng.standard_normal((count, width)) * np.exp(-np.arange(width) / width) + 0.01).astype(np.float32)
    base[: count // 3, 0] += 3
    rows = [(k, [float(v) for v in x]) for k, x in enumerate(base)]
    rows += [(900 + k, rows[5][1]) for k in range(count // 2)]  # a third of all rows is one vector
    rows += [(None, rows[7][1]), (7, rows[7][1])]
    bad = [(801, None), (802, []), (803, [float("nan")] * width), (804, [float("inf")] + [0.0] * (width - 1)), (805, [None] + [0.0] * (width - 1)),
           (806, [0.0] * (width - 1))]
    return rows, bad


def whole(rows):
    return np.array([[math.floor(256 * c) for c in v] for _, v in rows], dtype=np.int64)


def key_of(row):
    return (row[0] is not None, row[0] or 0)


@pytest.mark.parametrize("width", [1, 3, 24])
def test_whitening_against_numpy(spark, width):
    rows, bad = edge_rows(width, 60)
    got = W.whiten(table(spark, rows + bad)).collect()
    x = whole(rows)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    m = min(4, width)
    assert len(got) == len(rows) * m and {r["n"] for r in got} == {n}
    by_key = {}
    for r in got:
        by_key.setdefault((r["vec_id"], r["component"]), []).append(r)
    for (key, _), line in zip(rows, x):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(line, s))
        for c in range(m):
            for r in by_key[(key, c + 1)]:
                if key not in (7, None):
                    assert r["deviation"] == deviation
                want = ((line - s / n) @ u[:, c]) / math.sqrt(e[c])
                assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
                assert abs(r["explained"] / (e[c] / (centred**2).sum() * n) - 1) < 1e-10
                assert r["identity_error"] < 1e-10


def test_whitening_without_variance(spark):
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = W.whiten(table(spark, [(k, [float(k), 2.0, 1.0]) for k in range(5)])).collect()
    assert {r["component"] for r in flat} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in flat)


@pytest.mark.parametrize("kind", ["decay", "crowded", "equal", "low rank"])
def test_eigenpairs_reach_double_precision(kind):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 50))
    if kind == "decay":
        x *= np.exp(-np.arange(50) / 5)
    if kind == "low rank":
        x = x[:, :2] @ rng.standard_normal((2, 50))
    a = np.eye(50) if kind == "equal" else x.T @ x / 400
    seen = []

    def product(w):
        seen.append(w.shape)
        return a @ w

    e, u = W.jacobi_davidson(product, 50, 4)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1][:4]).max() < 1e-13 * max(1, e[0])
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-13 * max(1, e[0])
    assert np.abs(u.T @ u - np.eye(4)).max() < 1e-12 and all(s[1] <= W.MAX_SPACE for s in seen)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    b = rng.standard_normal((20, 3))
    assert np.abs(a @ W.minres(lambda w: a @ w, b, 60, 1e-12) - b).max() < 1e-8


def lloyd(x, keys, count, rounds):
    order = sorted(range(len(x)), key=lambda i: (keys[i] is None, hashlib.sha256(f"2:{keys[i]}".encode()).hexdigest(), x[i].tolist()))
    c = [x[i].tolist() for i in order[:count]]
    for step in range(rounds + 1):
        d = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        if step < rounds:
            c = [[int(v) // int((near == k).sum()) for v in x[near == k].sum(axis=0)] if (near == k).any() else c[k] for k in range(len(c))]
    return near, d.min(axis=1), c


@pytest.mark.parametrize(("count", "bits"), [(7, 2), (7, 6), (40, 4), (500, 3)])
def test_clusters_against_plain_lloyd(spark, monkeypatch, count, bits):
    monkeypatch.setattr(V, "CHUNK_ROWS", 16)
    monkeypatch.setattr(V, "FILE_ROWS", 48)
    rows, bad = edge_rows(9, 80)
    got = V.cluster(table(spark, rows + bad).repartition(3), width=9, count=count, bits=bits).collect()
    x = whole(rows)
    near, far, c = lloyd(x, [k for k, _ in rows], count, 5)
    inertia = [int(far[near == k].sum()) for k in range(len(c))]
    want = [
        (key, int(k), int(d), inertia[k], int(far.sum()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest())
        for (key, _), k, d in zip(rows, near, far)
    ]
    assert sorted(map(tuple, got), key=key_of) == sorted(want, key=key_of)
    assert V.cluster(table(spark, bad), width=9).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 12))
    x[:250] += 5000
    cells = V.Cells(x.min(axis=0), x.max(axis=0), 5)
    assert (cells.decode(cells.encode(x)) == (x - cells.low) // cells.step).all()
    c = x[::50]
    open_ = V.Bounds(cells, c).candidates(cells.decode(cells.encode(x)))
    d = V.squared(x, c)
    assert open_[np.arange(len(x)), d.argmin(axis=1)].all()  # the nearest is never out
    assert open_.sum() < 0.6 * open_.size
    near_all = d == d.min(axis=1)[:, None]
    assert (open_ | ~near_all).all()  # nor is one that ties with it


def test_only_open_or_moved_vectors_are_fetched(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(v) for v in rng.standard_normal(64) + 40 * (k % 5)]) for k in range(300)]
    files = V.VectorFiles(V.whole_rows(table(spark, rows), "vec_id", "embedding"), 64)
    c = np.array([[256 * 40 * g] * 64 for g in range(5)])
    assert files.round(c)[2] == 300 and files.round(c)[2] == 0
