from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from prescriva.operators import ends, learn
from prescriva.plans import outcome as o


@pytest.mark.parametrize("rule", ["kosko_modificada", "kosko", "reescalada"])
@pytest.mark.parametrize("slope", [0.5, 2.0, 5.0, 10.0])
def test_looked_up_ends_are_the_iterated_ones(rule, slope):
    """Values and derivatives, also beyond the table and on both sides of a steep step."""
    memory, a, b, _ = replace(o.fixed_map(rule), slope=slope).parameters
    table = ends.ends(slope, memory, a, b, 0.47, 30, 3.0)
    pull = np.concatenate([np.linspace(-3.5, 3.5, 40_001), np.linspace(-0.6, -0.4, 40_001)])
    [end], [bend] = ends.ends_of([table], pull[None])
    true, total = learn._single(0.47, pull[None], np.array([[slope]]), memory, a, b, 30)
    assert np.abs(end - true[0]).max() < 1e-12 and (np.abs(bend - total[0]) / np.maximum(1, np.abs(total[0]))).max() < 1e-10
    assert (ends.ends_of([table], pull[None], derivative=False)[0][0] == end).all() and np.isnan(ends.ends_of([table], np.array([[0.1, np.nan]]))[0][0, 1])


def test_sums_of_looked_up_ends():
    """Losses, gradients and curvatures are those of the iterated rows, and next to no row is iterated."""
    rng = np.random.default_rng(3)
    m = replace(o.fixed_map(), start={"y": 0.4})
    x, v = rng.random((6, 50_000)), rng.random(50_000)
    edges, receivers = np.argwhere(m.weights != 0), np.array([5])
    maps = [replace(m, slope=s, bias=m.bias * k, weights=m.weights * k) for s in (0.5, 2.0, 3.0, 10.0) for k in (0.3, 1.1)]
    began = x.T.copy()
    began[:, 5] = 0.4
    true = learn.residual_sums(maps, began, x[5][:, None], v, np.ones(1), edges, receivers)
    found = learn.lone_sums(maps, x, v, edges, receivers)
    for a, b in zip(found, true, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-7)
    for a, b in zip(learn.lone_sums(maps[:2], x, v, edges, receivers), found, strict=True):
        assert a == pytest.approx(b[:2], rel=1e-12, abs=1e-9)
    assert learn.lone_sums(maps, x, v, edges, receivers, curved=False)[0] == pytest.approx(true[0], rel=1e-11)
    rows, plain = [], ends.iterated
    try:
        ends.iterated = lambda pull, *settings: (rows.append(len(pull)), plain(pull, *settings))[1]
        learn.lone_sums(maps, x, v, edges, receivers)
    finally:
        ends.iterated = plain
    assert sum(rows) < 0.02 * len(maps) * 50_000


def test_objective_of_parts(spark):
    """Each variant's loss is over its own training part, whether ends are looked up or not, and an empty value is an error."""
    rng = np.random.default_rng(5)
    m = o.fixed_map()
    rows = [(*map(float, r), int(i % 3)) for i, r in enumerate(rng.random((300, 6)))]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in m.ids) + ", fold int")
    goal = learn.Objective(m, df, m.weights != 0, fold="fold")
    variants = [learn.Variant(s, 1e-3, f) for f in (0, 2) for s in (1.0, 5.0)]
    thetas = rng.uniform(-1, 1, (4, goal.size))
    plain, slopes = goal(thetas, variants)
    assert goal.lone and goal(thetas, variants, gradients=False)[0] == pytest.approx(plain, rel=1e-9)
    losses, g, _ = goal.curved(thetas, variants)
    assert losses == pytest.approx(plain, rel=1e-9) and g == pytest.approx(slopes, rel=1e-7, abs=1e-9)
    for empty in (float("nan"), None):
        with pytest.raises(Exception, match="null or NaN"):
            learn.Objective(m, df.replace({rows[0][0]: empty}, subset=[m.ids[0]]), m.weights != 0)
