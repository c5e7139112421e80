from __future__ import annotations

import numpy as np

from prescriva.llm import components, lattice


def brute(rows, least=0.9):
    """Exact links and components: (vec_id, n_links, component_id, kept) in the rows' order."""
    ok = [bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    n = len(rows)
    adjacent = np.zeros((n, n), dtype=bool)
    for dim in {len(v) for (_, v), o in zip(rows, ok, strict=True) if o}:
        own = [i for i in range(n) if ok[i] and len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in own], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        adjacent[np.ix_(own, own)] = x @ x.T >= least
    np.fill_diagonal(adjacent, False)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(adjacent[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], int(adjacent[i].sum()), component, rows[i][0] == component))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(frame).collect()), key=str)


def test_decoder_against_all_near_points():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest_e8(y)
    away = ((y - p) ** 2).sum(axis=1)
    others = ((y[:, None, :] - p[:, None, :] - lattice._NEAR[None]) ** 2).sum(axis=2).min(axis=1)
    assert (away <= others + 1e-9).all() and away.max() <= 1 + 1e-9 and len(lattice._NEAR) == 240


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, j) for j in range(201, 240)] + [(300, 300), (5, 4), (5, 4)] + [tuple(map(int, rng.integers(1000, 1100, 2))) for _ in range(80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    wanted = {x: find(x) for x in parent if find(x) != x}
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components.components(frame).collect()} == wanted
    assert components.components(frame.limit(0)).count() == 0


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0.01, 0.05, 0.1])
        rows.append((100 + i, v.tolist()))
    rows += [(600 + i, base[0].tolist()) for i in range(30)] + [(700, (2 * base[1]).tolist()), (3, base[2].tolist()), (None, base[5].tolist())]
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] * 16), (803, [None] + [1.0] * 15), (804, [1.0, 2.0]), (805, [2.0, 4.0]), (806, [float("inf")] * 2), (None, None)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cid int, size string")
    wanted = brute(rows)
    found = got(frame)
    assert [r[0] for r in found] == [r[0] for r in wanted] and len(found) == len(rows)
    links, exact = sum(r[1] for r in found), sum(r[1] for r in wanted)
    assert links <= exact and links / exact > 0.99
    assert got(frame.limit(0)) == []


def test_blocks_of_large_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    one = rng.normal(size=32)
    rows = [(i, (one + rng.normal(size=32) * 0.02).tolist()) for i in range(150)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(lattice, "BLOCK", 20)
    assert got(frame) == brute(rows)


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
    assert got(frame) == brute(rows)


def test_recall_at_the_limit():
    """Pairs at a cosine of exactly 0.9, the hardest ones: at least nine tenths meet."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    p, q = lattice.cells(x), lattice.cells(0.9 * x + np.sqrt(1 - 0.81) * z)
    meet = ((p[:, :, :1] == q).any(axis=2) | (q[:, :, :1] == p).any(axis=2)).any(axis=1)
    assert meet.mean() >= 0.9
