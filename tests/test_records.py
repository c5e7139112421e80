"""Registry, encodings, wishes, record prescriptions, reports and the run's options."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from prescriva.operators import evaluate, individual, prescribe, quantiles, report
from prescriva.plans import more, outcome, prescriptive
from prescriva.sources import registry, tables


def test_registry_and_two_writers(spark, tmp_path):
    r = registry.Registry(spark, f"file://{tmp_path}/reg")
    assert r.list().count() == 0
    r.create("d1", "dataset", "2024-01-01")
    a = r.create("m1", "model", "2024-01-02", "d1", "training", {"slope": 2})
    r.create("m2", "model", "2024-01-03", "d1", "ready")
    with pytest.raises(registry.Conflict):
        r.create("m1", "model", "2024-01-04")
    with pytest.raises(ValueError):
        r.create("../m", "model", "2024-01-04")

    def write(i):
        try:
            return r.change(a, state=f"ready {i}")
        except registry.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(write, range(16)) if x]
    assert len(won) == 1 and r.get("m1")["state"] == won[0]["state"] and r.get("m1")["version"] == 2
    r.change(r.get("m1"), state="ready", data={"slope": 3})
    assert {x.id: (x.version, x.state) for x in r.list().collect()} == {"d1": (1, "new"), "m1": (3, "ready"), "m2": (1, "ready")}
    assert [x.model for x in r.active().collect()] == ["m2"]
    r.delete("m2")
    assert [x.model for x in r.active().collect()] == ["m1"]
    with pytest.raises(KeyError):
        r.get("m2")
    with pytest.raises(ValueError):
        r.change(r.get("m1"), id="x")
    for name in "ab":
        (tmp_path / name).write_text(name)
    uri = lambda n: f"file://{tmp_path}/{n}"
    assert registry._renamed_by_context(spark, uri("a"), uri("c")) and not registry._renamed_by_context(spark, uri("b"), uri("c"))
    assert (tmp_path / "c").read_text() == "a"


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_an_encoding_that_shows_far_behind_the_header(spark, tmp_path, encoding):
    lines = ["id;ciudad"] + [f"{i};Lima" for i in range(40_000)] + ["40000;Bogotá"] + [f"{i};Lima" for i in range(40_001, 50_000)]
    (tmp_path / "t.csv").write_bytes("\n".join(lines).encode(encoding))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = tables.read_csv(spark, str(tmp_path / "t.csv"))
        assert df.rdd.getNumPartitions() > 4 and df.where("id = 40000").first().ciudad == "Bogotá" and df.count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.exponential(1e5, 9000), np.full(3000, 7.0), -(10.0 ** rng.uniform(-300, 300, 500)), [1.7e308, -1.7e308]])
    b = np.where(rng.random(len(a)) < 0.1, np.nan, rng.integers(0, 9, len(a)).astype(float))
    rows = [(float(x), None if np.isnan(y) else float(y), "ab"[i % 2]) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(float("inf"), float("nan"), None), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, g string").repartition(6)
    qs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = quantiles.quantiles(df, ["a", "b"], qs)
    assert got["", "a"] == pytest.approx(np.quantile(a, qs), rel=1e-12)
    assert got["", "b"] == pytest.approx(np.quantile(np.append(b[~np.isnan(b)], 1.0), qs))
    by = quantiles.quantiles(df, ["a"], qs, "g")
    assert set(by) == {("a", "a"), ("b", "a")} and by["b", "a"] == pytest.approx(np.quantile(a[1::2], qs), rel=1e-12)
    assert quantiles.quantiles(df.limit(0), ["a"], qs) == {}


def test_costs_of_several_wishes(spark):
    m = outcome.two_moving()
    plan = prescribe.Plan(("n_orders",), weights=(("y", 3.0),))
    ends = np.zeros((2, 1, len(m.ids)))
    ends[:, :, m.ids.index("y")], ends[:, :, m.ids.index("acctbal")] = 0.4, 0.9
    got = prescribe.missed(m, plan, ends, np.array([1.0, 0.2]), np.array([[0.5], [np.nan]]), ["acctbal"])
    assert got[:, 0] == pytest.approx([(3 * 0.6 + 0.4) / 4, 0.0])  # passing the goal costs nothing
    x, _ = outcome.scaled_outcome(spark, "/root/testdata/sf0.001")
    own = x.where("row_id <= 20").withColumns({"goal": F.lit(0.9), "want": F.when(F.col("row_id") % 2 == 0, 0.1)})
    found = prescribe.genetic_prescriptions(own, m, plan, "row_id", "goal", prescribe.Search(generations=8), wanted={"acctbal": "want"}).collect()
    assert all(len(r.history) == len(r.action_history) == r.generations + 1 and r.action_history[-1] == r.actions for r in found)
    for bad in ("n_orders", "y"):
        with pytest.raises(ValueError):
            prescribe.genetic_prescriptions(own, m, plan, "row_id", "goal", wanted={bad: "want"})


def test_records_with_wishes(spark):
    model = more._model(spark, "/root/testdata/sf0.001")
    df = outcome.customer_outcome(spark, "/root/testdata/sf0.001").where("row_id between 1 and 12")
    wish = lambda *rows: spark.createDataFrame(list(rows), "row_id long, column string, value string")
    key = 7
    options = prescriptive.Options(search=prescribe.Search(generations=10), condition="urgent_share")
    got = {r.row_id: r for r in model.prescribe_records(df, "row_id", options, wishes=wish((key, "outcome", "M"), (10**9, "outcome", "H"))).collect()}
    assert len(got) == 12 and got[key].goal_level == "M" and got[key].goal == 0.5
    for r in got.values():
        assert r.observed in outcome.LEVELS and r.cost <= max(r.goal - r.base, 0) + 1e-9 and r.report.startswith(r.plan)
        assert [abs(c.after) for c in r.contributions] == sorted((abs(c.after) for c in r.contributions), reverse=True)
    best = model.prescribe_records(df, "row_id", options, goal_level="H", subject="el cliente").collect()
    assert {r.goal_level for r in best} == {"H"} and any("el cliente" in r.report or "al cliente" in r.report for r in best)
    for bad in (("n_orders", "3"), ("nowhere", "1"), ("acctbal", "much")):
        with pytest.raises(ValueError):
            model.prescribe_records(df, "row_id", options, wishes=wish((key, *bad)))
    with pytest.raises(ValueError):
        model.prescribe_records(df, "row_id", options, wishes=wish((key, "acctbal", "1"), (key, "acctbal", "2")))
    with pytest.raises(ValueError):
        model.prescribe_records(df, "row_id", options, goal_level="X")
    with pytest.raises(ValueError):
        individual.goal_of(outcome.SCHEMA, "X")


def test_report_of_binary_and_ordered_actions(spark):
    actions = [report.Action("a", "correo", 0, 1, ("no", "yes")), report.Action("b", "llamada", 0, 1, ("no", "yes")), report.Action("c", "horas", 0, 40), report.Action("d", "nivel", 0, 2, ("bajo", "medio", "alto")), report.Action("e", "visita", 0, 1, ("no", "yes"))]
    rows = [(1, 0.0, 1.0, 0.0, 1.0, 10.0, 12.0, 0.0, 2.0, 1.0, 1.0, 0.2, 0.7, 0.5, "M", "L"), (2, 0.0, 0.0, 0.0, 0.0, 10.0, 10.0, 1.0, 1.0, 0.0, 0.0, 0.6, 0.6, 0.5, "M", "L"), (3, 0.0, 0.0, 1.0, 0.0, 10.0, 9.0, 1.0, 1.0, 0.0, 0.0, 0.1, 0.15, 0.5, "M", "L")]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{a}_{k} double" for a in "abcde" for k in ("now", "new")) + ", base double, activation double, goal double, goal_level string, observed string")
    got = {r.id: r for r in report.individual_reports(df, "id", actions, "nota", outcome.LEVELS, 0.25).collect()}
    assert got[1].plan == "Para este perfil se recomienda activar correo y llamada, aumentar horas de 10 a 12 (+2; 5 % de su rango) y pasar nivel de «bajo» a «alto». Además, mantener activa visita: el modelo no espera un beneficio que compense el esfuerzo de cambiarla."
    assert got[1].result == "Con este plan, el FCM estima que nota pasa de 0,2 (L) a 0,7 (M) y alcanza la meta (M)." and got[1].reaches
    assert got[2].plan.startswith("Con sus acciones actuales, el FCM ya ubica a este perfil en M, en su meta (M)") and "Su nivel observado es L" in got[2].plan
    assert got[3].plan.startswith("Para este perfil se recomienda desactivar llamada y reducir horas de 10 a 9 (−1; 2 % de su rango).") and not got[3].reaches
    assert got[3].keeps == ["No activar correo y visita.", "Mantener nivel en «medio»."] and "cambiarlas." in got[3].plan


def test_options_of_a_run(spark):
    df = outcome.customer_outcome(spark, "/root/testdata/sf0.001")
    short = {"most_steps": 6, "folds": 2, "slopes": (1.0,), "alphas": (1e-3,), "fold_steps": 4, "search": {"population": 20, "generations": 5, "unknown": 1}}
    options = prescriptive.Options.of({**short, "smote": True, "binarize": "M", "segment": ("region", "ASIA"), "forest": True, "forest_trees": 5, "balance_levels": None, "division": "random"})
    _, metrics, plans = prescriptive.run(df, outcome.FULL_SCHEMA, "row_id", options)
    assert {r["level"] for r in metrics["levels"]} == {"<M", "≥M"} and set(metrics["goals"]) == {"≥M"} and metrics["prescribed"] == plans.count()
    assert metrics["config"]["smote"] and {"mae_before", "mae_after", "success_before", "success_after", "mean_change"} <= set(metrics) and 0 <= metrics["macro_f1"] <= 1
    assert sum(s["n"] for s in metrics["segments"]) == metrics["prescribed"] and set(metrics["forest"]) == {"confirmed_before", "confirmed_after"}
    assert metrics["iterations"] >= 1 and len(metrics["concepts"]) == 1 and len(metrics["selection"]) == 1
    for bad in ({"method": "x"}, {"division": "x"}, {"excluded_edges": [("a",)]}, {"folds": 11}):
        with pytest.raises(ValueError):
            prescriptive.Options.of(bad)
    assert prescriptive.Options().quick().folds == 3
    odd = df.withColumn("outcome", F.when(F.col("row_id") == 1, "?").otherwise(F.col("outcome")))
    with pytest.raises(ValueError, match="outcome"):
        prescriptive.run(odd, outcome.FULL_SCHEMA, "row_id", options)


def test_population_and_command_line(spark, tmp_path, capsys):
    from prescriva import __main__

    model = more._model(spark, "/root/testdata/sf0.001")
    df = outcome.customer_outcome(spark, "/root/testdata/sf0.001")
    plans = tables.written(model.prescribe_records(df.where("outcome <> 'H'"), "row_id", prescriptive.Options(search=prescribe.Search(generations=6))), "plans")
    told = report.population(plans, "row_id", model.actions(), outcome.LEVELS, "observed", "outcome", confirmed=(1.0, 2.0))
    assert told["n"] == plans.count() and f"a {told['n']} registros de prueba con nivel «L» o «M»" in told["text"] and "cifra prudente" in told["text"]
    assert [r["level"] for r in told["levels"]] == ["L", "M"] and len(told["gains"]) == 5
    for r in told["actions"]:
        assert r["up"] + r["down"] + r["same"] == pytest.approx(100)
    assert report.population(plans, "row_id", model.actions(), outcome.LEVELS, "observed", "outcome", level="X")["n"] == 0
    df.write.parquet(f"{tmp_path}/t.parquet")
    (tmp_path / "s.json").write_text(outcome.FULL_SCHEMA.to_json())
    __main__.main([f"{tmp_path}/t.parquet", f"{tmp_path}/s.json", f"{tmp_path}/out", "--folds", "0", "--most-steps", "5", "--segment", "region=ASIA", "--search", "generations=4", "--search", "population=10", "--exclude", "C1:C99"])
    said = capsys.readouterr().out
    assert "prescribed: " in said and "region = ASIA" in said and "macro F1" in said
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/recommendations").count() > 0


def test_what_a_model_is(spark):
    model = more._model(spark, "/root/testdata/sf0.001")
    told = model.info()
    assert told["best_level"] == "H" and [x["weight"] for x in told["influences"]] == [0.8, -0.15, 0.1, -0.1, 0.05] and len(told["edges"]) == 5
    odd = outcome.customer_outcome(spark, "/root/testdata/sf0.001").where("row_id between 1 and 3").withColumn("outcome", F.lit("?"))
    with pytest.raises(ValueError, match="outcome"):
        model.prescribe_records(odd, "row_id")


def test_curve_of_a_selection(spark):
    rows = [(1.0, 1e-3, 0.6, 0.1, 0.2), (2.0, 1e-3, 0.8, 0.1, 0.2), (2.0, 1e-2, 0.7, 0.1, 0.2), (0.5, 1e-3, 0.8, 0.2, 0.3)]
    table = spark.createDataFrame(rows, "slope double, alpha double, accuracy double, spread double, mae double")
    assert [r.slope for r in evaluate.selection_curve(table).collect()] == [0.5, 1.0, 2.0]
    assert [r.accuracy for r in evaluate.selection_curve(table, 1e-2).collect()] == [0.7]
