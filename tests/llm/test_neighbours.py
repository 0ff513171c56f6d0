import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import neighbours as nb
from folioforge.operators.vectors import current_rows

SCHEMA = "id string, doc long, embedding array<double>, vector string"


def truth(rows, k=5, least=0.9):
    ids, docs = [r[0] for r in rows], np.array([r[1] for r in rows])
    x = np.array([r[2] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    out = set()
    for i in range(len(rows)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(rows)) if docs[j] != docs[i] and s[i, j] >= least)[:k]
        out |= {tuple(sorted((ids[i], j))) for _, j in near}
    return out


def data(n=1500, groups=60, dim=64, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"r{i:05d}", int(rng.integers(0, n // 4)), rng.normal(size=dim) * rng.uniform(0.2, 3)) for i in range(n)]
    for g in range(groups):
        base = rng.normal(size=dim)
        for m in range(int(rng.integers(2, 7))):
            rows.append((f"g{g:03d}-{m}", 10_000 + g * 10 + m, (base + rng.normal(size=dim) * rng.uniform(0.02, 0.3)) * rng.uniform(0.5, 2)))
    return [(i, d, v.tolist()) for i, d, v in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_recall_against_brute_force(spark):
    rows = data()
    got = {tuple(r) for r in nb.similar_pairs(nb.nearest_vectors(frame(spark, rows))).collect()}
    want = truth(rows)
    assert len(want) > 100 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.01 * len(want)


def test_salted_blocks(spark, monkeypatch):
    rows = data(600, 30)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 60)
    got = {tuple(r) for r in nb.similar_pairs(nb.nearest_vectors(frame(spark, rows))).collect()}
    want = truth(rows)
    assert len(got & want) >= 0.95 * len(want)


def test_copies_are_one_class(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    # a third of all rows are copies; one document holds many of them
    rows = data(300, 10) + [(f"c{i:04d}", 77 if i % 2 else 50_000 + i, base.tolist()) for i in range(200)]
    near = base + rng.normal(size=64) * 0.05
    rows += [("near", 60_000, near.tolist()), ("near2", 77, near.tolist())]
    got = {tuple(r) for r in nb.similar_pairs(nb.nearest_vectors(frame(spark, rows))).collect()}
    want = truth(rows)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_odd_rows(spark):
    v = np.ones(64).tolist()
    rows = [("a", 1, v), ("b", 2, v), ("c", 1, v), ("d", None, v), (None, 3, v), ("e", 4, None), ("f", 5, [0.0] * 64), ("g", 6, [1.0] * 32), ("h", 7, [float("nan")] * 64)]
    got = {tuple(r) for r in nb.similar_pairs(nb.nearest_vectors(frame(spark, rows))).collect()}
    assert got == {("a", "b"), ("b", "c")}
    assert nb.nearest_vectors(frame(spark, [])).count() == 0
    assert nb.nearest_vectors(frame(spark, rows[5:7])).count() == 0


def test_only_the_highest_version(spark):
    v, w = np.ones(64).tolist(), np.r_[np.ones(32), -np.ones(32)].tolist()
    df = spark.createDataFrame([("a", 1, v, 1), ("a", 1, w, 2), ("a", 1, w, 2), ("b", 2, v, 1), ("c", 3, w, 9)], "id string, doc long, embedding array<double>, ord long")
    rows = current_rows(df, "id", "ord", {"doc": F.col("doc"), "embedding": F.col("embedding")})
    assert {tuple(r) for r in nb.similar_pairs(nb.nearest_vectors(rows)).collect()} == {("a", "c")}


@pytest.mark.parametrize("probes", [1, 3, 8])
def test_cells_in_order(probes):
    rng = np.random.default_rng(2)
    a, b = rng.random((50, 6)), rng.random((50, 7))
    i, j = nb.nearest_cells(a, b, probes)
    sums = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
    want = np.sort(sums, axis=1)[:, :probes]
    got = np.take_along_axis(a, i, 1) + np.take_along_axis(b, j, 1)
    assert np.allclose(got, want)


def test_hot_cell(spark):
    """Vectors that are nearly but not exactly equal fall into few cells, which are parted; nothing is lost."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    rows = [(f"m{i:05d}", i // 2, (base + rng.normal(size=64) * 0.05).tolist()) for i in range(2500)] + data(400, 20, seed=8)
    df = frame(spark, rows)
    index = nb.fit_index(df.select("id", "embedding"), len(rows), 64, 8, cell_rows=800, hot_rows=200)
    assert index.hot and max(e * q for e, q, _ in index.hot.values()) > 4
    got = {tuple(r) for r in nb.similar_pairs(nb.nearest_vectors(df, cell_rows=800, hot_rows=200)).collect()}
    want = truth(rows)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
