from __future__ import annotations

import numpy as np
import pytest

from prescriva.operators import fcm, prescribe, quantiles
from prescriva.plans import outcome as o


def test_quantiles_by_place(spark, monkeypatch):
    """Arrays of unlike length, some empty or null, repeated values; short intervals and few bins, so that several passes are made."""
    monkeypatch.setattr(quantiles, "FEW", 4)
    monkeypatch.setattr(quantiles, "PLACE_BINS", 3)
    rng = np.random.default_rng(3)
    rows = [np.round(rng.normal(0, 1, rng.integers(1, 9)), int(rng.integers(1, 6))).tolist() for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in [*rows, [], None]], "history array<double>").repartition(3)
    got = quantiles.by_place(df, "history", (0.25, 0.5, 0.75))
    padded = np.array([v + v[-1:] * (8 - len(v)) for v in rows])
    assert [g for g, _ in got] == list(range(8))
    assert [v for _, v in got] == [pytest.approx(q, abs=1e-12) for q in np.quantile(padded, (0.25, 0.5, 0.75), axis=0).T]
    curve = prescribe.convergence(df).orderBy("generation").collect()
    assert [(r.generation, (r.q1, r.median, r.q3)) for r in curve] == got
    assert quantiles.by_place(df.limit(0), "history", (0.5,)) == []


def test_rows_stop_one_by_one():
    """A row's states and steps are those it has alone, with a moving concept or two, whatever stops before it."""
    rng = np.random.default_rng(4)
    for m in (o.fixed_map(), o.two_moving()):
        x = rng.random((50, len(m.ids)))
        end, taken, _ = fcm.iterate(m, x)
        for i in range(len(x)):
            one, n, trace = fcm.iterate(m, x[i : i + 1], trace=True)
            assert one[0] == pytest.approx(end[i], abs=1e-14) and n[0] == taken[i] and np.array_equal(trace[-1], one) and len(trace) == n[0] + 1
        assert len(set(taken.tolist())) > 1
