from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prescriva.operators import split
from prescriva.operators.neighbours import nearest


def brute(x, keys, k):
    d = np.zeros((len(x), len(x)))
    for i in range(x.shape[1]):
        d += (x[:, i, None] - x[None, :, i]) ** 2
    out = {}
    for i in range(len(x)):
        near = sorted((d[i, j], keys[j]) for j in range(len(x)) if j != i)[:k]
        out[keys[i]] = [(float(np.sqrt(v)), key) for v, key in near]
    return out


@pytest.mark.parametrize("pivots", [1, 16])
def test_nearest_of_2000_rows_of_a_level(spark, pivots):
    """Clusters of unlike size and spread, repeated rows among them, and a small second level."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in ((0, 0.1, 900), (1, 0.02, 500), (0.5, 1.0, 560))])
    x = np.concatenate([x, np.repeat(x[:4], 10, axis=0)])
    keys = rng.permutation(len(x)).tolist()
    rows = [(k, "A", *map(float, v)) for k, v in zip(keys, x, strict=True)] + [(9000 + i, "B", float(i), 0.0, 0.0) for i in range(4)] + [(9100, "C", 0.0, 0.0, 0.0), (9101, None, 0.0, 0.0, 0.0), (9102, "B", None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, level string, a double, b double, c double").repartition(5)
    got = {r.key: [(n.distance, n.key) for n in r.near] for r in nearest(df, ["a", "b", "c"], "level", "id", 5, pivots).collect()}
    want = brute(x, keys, 5)
    want |= brute(np.array([[i, 0.0, 0.0] for i in range(4)]), [9000 + i for i in range(4)], 5) | {9100: []}
    assert got == want


def test_smote_between_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "many" if i < 300 else "few" if i < 370 else "one", *map(float, rng.random(2))) for i in range(371)]
    df = spark.createDataFrame(rows, "id long, level string, a double, b double")
    out = split.smote(df, ["a", "b"], "level", "id").collect()
    counts = {k: sum(r.level == k for r in out) for k in ("many", "few", "one")}
    assert counts == {"many": 300, "few": 300, "one": 300} and sum(r.synthetic for r in out) == 230 + 299
    few = np.array([r[2:] for r in rows if r[1] == "few"])
    near = brute(few, list(range(len(few))), 5)
    ends = [(few[i], few[j]) for i in near for _, j in near[i]]
    for r in (r for r in out if r.synthetic and r.level == "few"):
        p = np.array([r.a, r.b])
        assert min(np.linalg.norm(p - u) + np.linalg.norm(p - v) - np.linalg.norm(u - v) for u, v in ends) < 1e-12
    assert {(r.a, r.b) for r in out if r.level == "one"} == {rows[-1][2:]}  # a lone row is repeated
    again = split.smote(df.repartition(7), ["a", "b"], "level", "id").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))  # whatever the layout
    assert split.smote(df.limit(0), ["a", "b"], "level", "id").count() == 0
    assert split.smote(df.where(F.col("level") == "many"), ["a", "b"], "level", "id").count() == 300


def test_cells_are_even_and_small_and_a_tie_in_every_cell_is_found(spark):
    """Leaves of a tree over some rows hold about as many of all rows each; a grid's equally near rows are those of the smallest keys."""
    from prescriva.operators.neighbours import _Tree

    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (8000, 5)) ** 3
    cell, curve = _Tree.of(x[:1000], 4).place(x)
    assert set(cell) == set(range(16)) and np.bincount(cell).max() < 2 * 8000 / 16 and curve.min() >= 0
    grid = np.array([(i % 40, i // 40) for i in range(1600)], dtype=float)
    df = spark.createDataFrame([(i, "A", *v) for i, v in enumerate(grid.tolist())], "id long, level string, a double, b double").repartition(3)
    got = {r.key: [(n.distance, n.key) for n in r.near] for r in nearest(df, ["a", "b"], "level", "id").collect()}
    assert got == brute(grid, list(range(1600)), 5)
