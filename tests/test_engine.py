from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prescriva.functions import dates, numeric, text
from prescriva.operators import encode, evaluate, explore, fcm, learn, prescribe, schema, split
from prescriva.plans import outcome
from prescriva.sources import tables
from prescriva.streaming import scoring


def one(df, c):
    return df.select(c.alias("x")).first().x


@pytest.fixture(scope="module")
def row(spark):
    return spark.range(1)


def test_text(row):
    assert one(row, text.slug(F.lit("  Ñandú-Él 3! "))) == "nandu_el_3"
    assert one(row, text.readable(F.lit("Extra_Curricular_Activities"))) == "Extra curricular activities"
    assert one(row, text.number(F.lit(1234567.5))) == "1.234.567,5" and one(row, text.number(F.lit(2.0))) == "2"
    assert one(row, text.listed(F.array(*map(F.lit, "abc")))) == "a, b y c"
    assert one(row, text.first_number(F.lit("G-07x9"))) == 7.0 and one(row, text.first_number(F.lit("none"))) is None


def test_canonical(spark):
    df = spark.createDataFrame([(1.0, True, " a "), (0.1, False, "b"), (None, None, None)], "d double, b boolean, s string")
    got = df.select(*(text.canonical(df, c).alias(c) for c in df.columns)).collect()
    assert [tuple(r) for r in got] == [("1", "True", "a"), ("0.1", "False", "b"), (None, None, None)]


def test_dates(row):
    day = lambda s: str(one(row, dates.parsed(F.lit(s))))
    assert day("2012-3-4") == day("04/03/2012") == day("4.3.2012") == "2012-03-04" and day("hello") == "None"


def test_levels(row):
    levels = {"L": 0.0, "M": 0.5, "H": 1.0}
    assert [one(row, numeric.nearest_level(F.lit(v), levels)) for v in (0.25, 0.26, 0.75, 2.0)] == ["L", "M", "M", "H"]
    assert one(row, numeric.nearest_level(F.lit(None).cast("double"), levels)) is None
    assert one(row, numeric.next_level(F.lit("L"), levels)) == "M" and one(row, numeric.next_level(F.lit("H"), levels)) == "H"


def test_robust_limits(spark):
    for tail, high in (([10000.0], 225.0), ([10000.0] * 5, 10000.0)):
        df = spark.createDataFrame([(float(v),) for v in [*range(100), *tail]], "x double")
        r = encode.robust_limits(df, ["x"]).first()
        assert r.low == 0 and r.high == pytest.approx(high, abs=2.5)


def test_schema_rules_and_json():
    s = outcome.FULL_SCHEMA
    assert schema.Schema.from_json(s.to_json()) == s and s.best_level == "H" and s.tolerance == 0.25
    assert [c.id for c in s.concepts][-1] == "C14" and sum(c.category is not None for c in s.concepts) == 5
    bad = schema.Schema("x", (schema.ColumnSpec("a", "accion", "nominal"), schema.ColumnSpec("a", "mutable", "ordinal", ("x",))))
    assert len(bad.structural_errors()) == 4
    with pytest.raises(ValueError):
        s.binarized("L")


def test_preprocessor_dates_and_imputation(spark):
    s = schema.Schema("t", (schema.ColumnSpec("alta", "inmutable", "fecha"), schema.ColumnSpec("ingreso", "inmutable"), schema.ColumnSpec("accion", "accion"), schema.ColumnSpec("y", "objetivo", "ordinal", ("No", "Sí"))))
    df = spark.createDataFrame([(1, "01-01-2012", 20.0, 1, "No"), (2, "03-01-2012", None, 2, "Sí"), (3, "05-01-2012", 40.0, 3, "No"), (4, "02-01-2012", 30.0, 4, "Sí")], "id long, alta string, ingreso double, accion long, y string")
    p = encode.Preprocessor.fit(df, s)
    assert p.medians["C2"] == 30 and p.first_dates["alta"] == "2012-01-01"
    x = {r.id: r for r in p.transform(df, ["id"]).collect()}
    assert x[2].C2 == 0.5 and x[3].C1 == 1.0 and x[1].C1 == 0.0 and x[4].C4 == 1.0
    assert encode.Preprocessor.from_json(p.to_json()).transform(df, ["id"]).collect() == p.transform(df, ["id"]).collect()


def test_expression_and_kernel_agree(spark):
    rng = np.random.default_rng(0)
    ids = [*outcome.SCALED, "y"]
    x = spark.createDataFrame([(i, *map(float, rng.random(6))) for i in range(50)], ["row_id", *ids])
    for rule in fcm.RULES:
        for activation in fcm.ACTIVATIONS:
            m = outcome.fixed_map(rule, activation)
            a = {r.row_id: r.v for r in x.select("row_id", fcm.infer_column(m, F.col("y"), 12).alias("v")).collect()}
            b = {r.row_id: r.state[-1] for r in fcm.infer_frame(x, m, ["row_id"], 12).collect()}
            assert a == pytest.approx(b)


def test_rows_converge_one_by_one():
    m = outcome.two_moving()
    x = np.random.default_rng(1).random((20, 6))
    m.steps = 100
    whole, taken, _ = fcm.iterate(m, x)
    alone = np.concatenate([fcm.iterate(m, x[i : i + 1])[0] for i in range(20)])
    assert np.allclose(whole, alone, atol=0) and len(set(taken.tolist())) > 1


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    m = outcome.two_moving()
    x, y, v, c = rng.random((9, 6)), rng.random((9, 2)), rng.random(9), np.array([0.5, 0.5])
    loss, dw, db = learn.loss_and_gradient(m, x, y, v, c, 10)
    moving = m.moving
    for j in range(6):
        for k, i in enumerate(moving):
            old = m.weights[j, i]
            m.weights[j, i] = old + 1e-6
            up = learn.loss_and_gradient(m, x, y, v, c, 10)[0]
            m.weights[j, i] = old
            assert (up - loss) / 1e-6 == pytest.approx(dw[j, k], abs=1e-4)
    m.bias[moving[0]] += 1e-6
    assert (learn.loss_and_gradient(m, x, y, v, c, 10)[0] - loss) / 1e-6 == pytest.approx(db[0], abs=1e-4)


def test_gradients_of_several_maps():
    from dataclasses import replace

    rng = np.random.default_rng(5)
    m = outcome.two_moving()
    maps = [replace(m, weights=m.weights * k, bias=m.bias + k / 10, slope=1.0 + k) for k in range(3)]
    x, y, v, c = rng.random((9, 6)), rng.random((9, 2)), rng.random(9), np.array([0.5, 0.5])
    losses, dw, db = learn.losses_and_gradients(maps, x, y, v, c, 10)
    for i, one in enumerate(maps):
        loss, own_dw, own_db = learn.loss_and_gradient(one, x, y, v, c, 10)
        assert losses[i] == pytest.approx(loss) and dw[i] == pytest.approx(own_dw) and db[i] == pytest.approx(own_db)


def test_folds_of_very_many_groups(spark):
    df = spark.range(60_000).select(F.col("id").alias("g"), F.when(F.col("id") % 4 == 0, "H").otherwise("L").alias("level"))
    folded = split.grouped_folds(df, "g", "level", 5)
    by = folded.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("level") == "H").cast("int")).alias("h")).collect()
    assert len(by) == 5 and all(abs(r.n - 12_000) < 500 and abs(r.h - 0.25) < 0.02 for r in by)


def test_search_options_and_draws():
    with pytest.raises(ValueError):
        prescribe.Search(population=3, elite=3)
    with pytest.raises(ValueError):
        prescribe.Search(mutation=1.5)
    low, high = np.zeros((3, 2)), np.ones((3, 2))
    aim = np.array([[0.2, 0.9], [0.5, 0.5], [1.0, 0.0]])
    price = lambda genes, own: ((genes - aim[own][:, None]) ** 2).sum(axis=2)
    seeds = np.array([1, 2, 3], dtype=np.uint64)
    for one_point in (False, True):
        s = prescribe.Search(one_point=one_point)
        best, least, mean, made = prescribe.evolve(price, low, high, low, seeds, s)
        assert np.abs(best - aim).max() < 0.05 and (np.diff(least[0, : made[0] + 1]) <= 0).all() and (mean[0, : made[0] + 1] >= least[0, : made[0] + 1]).all()
        alone = prescribe.evolve(lambda genes, own: price(genes, own + 1), low[1:2], high[1:2], low[1:2], seeds[1:2], s)
        assert (alone[0][0] == best[1]).all()  # a record's search doesn't depend on its company


def test_descent_in_a_box():
    target = np.array([0.5, -2.0, 0.1])
    curved = np.array([1, 5, 20])
    targets = np.array([target, -target, target / 3])
    values = lambda t, own: (((t - targets[own]) ** 2 * curved).sum(axis=1), 2 * (t - targets[own]) * curved)
    found = learn.together([learn.descent(np.zeros(3)) for _ in targets], values)
    for (theta, _), one in zip(found, targets, strict=True):
        assert theta == pytest.approx(np.clip(one, -1, 1), abs=1e-4)
    place, loss = learn.swarm(lambda t: ((t - [0.3, -0.2]) ** 2).sum(axis=1), 2)
    assert place == pytest.approx([0.3, -0.2], abs=1e-2) and loss < 1e-4


def test_training_recovers_a_map(spark):
    rng = np.random.default_rng(3)
    w, b = np.zeros((4, 4)), np.zeros(4)
    w[:3, 3], b[3] = (0.9, 0.0, 0.3), -0.4
    m = fcm.CognitiveMap(["a", "b", "c", "y"], ["y"], "y", w, b, slope=1.5)
    x = rng.random((300, 4))
    mean = x[:, 3].mean()
    for _ in range(5):
        start = x.copy()
        start[:, 3] = mean
        x[:, 3] = fcm.iterate(m, start, learn.STEPS)[0][:, 3]
        mean = x[:, 3].mean()
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], m.ids)
    allowed = np.zeros((4, 4), dtype=bool)
    allowed[:3, 3] = True
    trained, loss = learn.train(df, m, allowed, alpha=1e-6, most=60)
    assert loss < 1e-3 and trained.weights[:3, 3] == pytest.approx([0.9, 0.0, 0.3], abs=0.12)


def test_splits(spark):
    df = outcome.customer_outcome(spark, "/root/testdata/sf0.01").select("row_id", "region", "mkt", "nation", "outcome").cache()
    tested = split.stratified_split(df, "outcome", "row_id")
    for r in tested.groupBy("outcome").agg(F.count("*").alias("n"), F.sum(F.col("test").cast("int")).alias("t")).collect():
        assert r.t == math.ceil(r.n * 0.3)
    assert tested.repartition(7).orderBy("row_id").collect() == split.stratified_split(df.repartition(5), "outcome", "row_id").orderBy("row_id").collect()
    folded = split.grouped_folds(split.group_id(df, ["region", "mkt", "nation"], "row_id"), "group", "outcome", 5)
    shares = folded.groupBy("fold").agg(F.avg((F.col("outcome") == "M").cast("double")).alias("m"), F.count("*").alias("n")).collect()
    assert len(shares) == 5 and max(s.m for s in shares) - min(s.m for s in shares) < 0.1


def test_smote_balances(spark):
    x, _ = outcome.scaled_outcome(spark, "/root/testdata/sf0.01")
    made = split.smote(x, outcome.SCALED, "outcome", "row_id")
    counts = {r.outcome: r.n for r in made.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert max(counts.values()) - min(counts.values()) <= 4
    ends = made.agg(*(F.min(c) for c in outcome.SCALED), *(F.max(c) for c in outcome.SCALED)).first()
    assert all(0 <= v <= 1 for v in ends)


def test_ranks_and_correlations(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 8, 200)
    df = spark.createDataFrame([(i, float(v), float(v * v + rng.normal()), 1.0) for i, v in enumerate(a)], "id long, a double, b double, k double")
    import pandas as pd

    wanted = pd.Series(a).rank().tolist()
    assert [r.rank for r in explore.average_ranks(df, "a", "id").orderBy("id").collect()] == wanted
    pdf = df.toPandas()
    r = {(x.a, x.b): x.r for x in explore.spearman(df, ["a", "b"], "id").collect()}
    assert r["a", "b"] == pytest.approx(pdf.a.rank().corr(pdf.b.rank()))
    assert {x.r for x in explore.correlations(df, ["a", "k"]).where("b = 'k'").collect()} == {None}


def test_filters(spark):
    df = spark.createDataFrame([(1, "Ab", 1.0), (2, None, None), (3, "b", 3.0)], "id long, s string, v double")
    ids = lambda *f: [r.id for r in explore.rows_page(df, "id", [f])[0].collect()]
    assert ids("s", "!=", "b") == [1, 2] and ids("s", "contiene", "B") == [1, 3] and ids("v", ">=", 1) == [1, 3] and ids("v", "!=", "x") == [1, 2, 3]
    with pytest.raises(ValueError):
        ids("s", "<", "b")
    page, total = explore.rows_page(df, "id", order="v", descending=True, count=2)
    assert [r.id for r in page.collect()] == [3, 1] and total.first().total == 3


def test_genetic_search_against_the_grid(spark):
    x, _ = outcome.scaled_outcome(spark, "/root/testdata/sf0.001")
    m, plan = outcome.fixed_map(), prescribe.Plan(("n_orders", "avg_qty"), delta_most=0.5)
    goals = prescribe.step_goals(x, "outcome", outcome.LEVELS).orderBy("row_id").limit(12)
    grid = {r.row_id: r.cost for r in prescribe.grid_prescriptions(goals, m, plan, "row_id", F.col("goal"), 11, outcome.STEPS).collect()}
    found = {r.row_id: r for r in prescribe.genetic_prescriptions(goals, m, plan, "row_id", "goal").collect()}
    now = {r.row_id: r.c for r in goals.select("row_id", prescribe.cost(m, plan, {a: F.col(a) for a in plan.actions}, F.col("goal"), F.col("y")).alias("c")).collect()}
    for k, r in found.items():
        assert r.cost <= grid[k] + 5e-3 and r.cost <= now[k] + 1e-3 and sorted(r.history, reverse=True) == list(r.history)


def test_metrics(spark):
    df = spark.createDataFrame([("L", "L"), ("L", "M"), ("M", "M"), ("H", "M")], "t string, p string")
    by = {r.level: r for r in evaluate.class_metrics(df, "t", "p", ["L", "M", "H"]).collect()}
    assert by["M"].precision == pytest.approx(1 / 3) and by["H"].recall == 0 and by["L"].support == 2
    assert evaluate.confusion(df, "t", "p", ["L", "M", "H"]).count() == 9
    assert evaluate.summary(df, "t", "p").first().accuracy == 0.5


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ id ;horas;ok\n1;2;true\n2;3;false\n", encoding="utf-8")
    df = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "horas", "ok"] and [r.ok for r in df.collect()] == ["True", "False"]
    tables.save_text(spark, str(tmp_path / "m"), outcome.SCHEMA.to_json())
    assert schema.Schema.from_json(tables.load_text(spark, str(tmp_path / "m"))) == outcome.SCHEMA
    assert tables.read_follow_up(spark, str(tmp_path / "log")).count() == 0
    notes = spark.createDataFrame([("m", 1, None, {"a": 1.0}, "L"), ("m", 2, __import__("datetime").date(2024, 1, 2), {"a": 1.0}, "3.5"), ("m", 3, __import__("datetime").date(2024, 1, 2), {"b": 1.0}, "L")], tables.FOLLOW_UP)
    tables.append_follow_up(notes, str(tmp_path / "log"))
    assert {r.record: r.valid for r in tables.valid_follow_up(tables.read_follow_up(spark, str(tmp_path / "log")), ["a"], ["L"]).collect()} == {1: False, 2: True, 3: False}


def test_stream_scores_as_the_table(spark, tmp_path):
    x, _ = outcome.scaled_outcome(spark, "/root/testdata/sf0.001")
    x.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(x.schema).parquet(str(tmp_path / "in"))
    q = scoring.scored(stream, outcome.fixed_map(), outcome.LEVELS).select("row_id", "level").writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, scoring.scored(x, outcome.fixed_map(), outcome.LEVELS).select("row_id", "level").collect()))


def test_whole_run_and_model(spark, tmp_path):
    from prescriva.plans import prescriptive

    df = outcome.customer_outcome(spark, "/root/testdata/sf0.001")
    options = prescriptive.Options.of({"most_steps": 6, "unknown": 1, "folds": 2, "slopes": (1.0, 2.0), "alphas": (1e-3,), "fold_steps": 4, "search": prescribe.Search(population=20, generations=5)})
    stages = []
    model, metrics, plans = prescriptive.run(df, outcome.FULL_SCHEMA, "row_id", options, stages.append)
    assert stages == ["split", "encode", "select", "learn", "evaluate", "prescribe"] and 0 <= metrics["accuracy"] <= 1 and metrics["prescribed"] == plans.count() > 0
    table = prescriptive.recommendations(model, plans, "row_id")
    assert {"n_orders_now", "n_orders_recommended", "level_goal", "success"} <= set(table.columns)
    model.save(spark, str(tmp_path / "m"))
    again = prescriptive.Model.load(spark, str(tmp_path / "m"))
    a, b = (sorted(map(tuple, m.predict(df, ["row_id"]).collect())) for m in (model, again))
    assert a == b
    assert again.simulate(df, "row_id", {"n_orders": 1.0}).count() == df.count()
    with pytest.raises(ValueError):
        again.simulate(df, "row_id", {"mkt": 1.0})
    with pytest.raises(ValueError):
        prescriptive.Options.of({"test_share": 0.9})


def test_suggested_schema(spark):
    from prescriva.operators import suggest

    rows = [(f"E{i:05d}", 17 + i % 10, i % 31, "Sí" if i % 4 == 0 else "No", i % 5, i % 21, i % 21 < 10) for i in range(300)]
    df = tables.booleans_as_text(spark.createDataFrame(rows, "estudiante_id string, edad long, horas_estudio long, beca string, materias_reprobadas long, Final_Grade long, Dropped_Out boolean"))
    found, notes = suggest.suggest(df)
    roles = {c.name: (c.role, c.encoding) for c in found.columns}
    assert roles["estudiante_id"][0] == "excluir" and roles["horas_estudio"] == ("accion", "numerica") and roles["beca"] == ("mutable", "ordinal")
    assert found.spec("Dropped_Out").order == ("True", "False") and roles["Final_Grade"][0] == "excluir" and any("Final_Grade" in n for n in notes)
    assert suggest.ordered(["H", "L", "M"]) == ("L", "M", "H") and suggest.ordered(["sí", "no"], "beca") == ("no", "sí")
