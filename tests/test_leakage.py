from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from prescriva.operators import leakage, ranks, schema, suggest


def purity(counts):
    return sum(float(n) * n for n in counts) / sum(counts)


def plain_tree(rows, most):
    """Best-first growth by plain loops: counts of the leaves in order."""
    labels = sorted({y for _, y in rows})
    count = lambda part: [sum(1 for _, y in part if y == k) for k in labels]

    def cut(part):
        best = None
        for v in sorted({x for x, _ in part})[:-1]:
            low, high = [r for r in part if r[0] <= v], [r for r in part if r[0] > v]
            score = purity(count(low)) + purity(count(high))
            if best is None or score > best[0]:
                best = (score, low, high)
        return best

    leaves = [rows]
    while len(leaves) < most:
        able = [(cut(p)[0] - purity(count(p)), -i) for i, p in enumerate(leaves) if sum(n > 0 for n in count(p)) > 1 and cut(p)]
        if not able:
            break
        at = -max(able)[1]
        leaves[at : at + 1] = cut(leaves[at])[1:]
    return [count(p) for p in leaves]


def test_trees_against_plain_loops(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        a, b = rng.randint(0, 80), rng.random()
        rows.append((float(a), b, None if a < 3 else float(a % 7), "L" if a < 20 or 40 < a < 45 else "M" if b < 0.6 else "H"))
    df = spark.createDataFrame(rows, "a double, b double, c double, y string").repartition(5)
    got = leakage.trees(df, ["a", "b", "c"], "y")
    for i, c in enumerate("abc"):
        assert [x.counts for x in got[c]] == plain_tree([(r[i], r[3]) for r in rows if r[i] is not None], 6), c


def test_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("nan"), "x"), (1.0, None, 2.0, "y"), (2.0, None, 3.0, None)], "one double, none double, nan double, y string")
    got = leakage.trees(df, ["one", "none", "nan"], "y")
    assert [x.counts for x in got["one"]] == [[1, 1]] and "none" not in got and [x.counts for x in got["nan"]] == [[0, 1]]
    assert leakage.column_accuracy(df.limit(0), ["one", "none"], "y").count() == 0


def test_a_continuous_grade_that_defines_the_objective(spark):
    """Left out by the suggestion, and named by the validation."""
    df = spark.range(400).select("id", (F.col("id") * 37 % 400 / 40).alias("grade"), (F.col("id") % 50).cast("double").alias("study_hours"), (F.col("id") % 3).alias("age"))
    df = df.withColumn("status", F.when(F.col("grade") < 4, "fail").otherwise("pass"))
    found, notes = suggest.suggest(df)
    roles = {c.name: c.role for c in found.columns}
    assert roles["grade"] == "excluir" and roles["status"] == "objetivo" and roles["study_hours"] == "accion"
    assert any(n.startswith("grade acierta el nivel de status en el 100 %") for n in notes)
    s = schema.Schema("t", (schema.ColumnSpec("grade", "mutable"), schema.ColumnSpec("study_hours", "accion"), schema.ColumnSpec("status", "objetivo", "ordinal", ("fail", "pass"))))
    told = [r for r in schema.problems(df, s).collect() if r.kind == "leak"]
    assert [(r.column, r.severity) for r in told] == [("grade", "notice")]


def test_positions_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "Z", "é", "b"]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert [(r.k, r.i) for r in ranks.positions(df, ["k", "i"], "p").orderBy("p").collect()] == [r[:2] for r in ordered]
    total, want = 0, {}
    for _, i, n in ordered:
        total += n
        want[i] = total
    assert {r.i: r.upto_n for r in ranks.running_sums(df, ["k", "i"], ["n"]).collect()} == want
    assert {r.k: r.number for r in ranks.dense_numbers(df, ["k"]).collect()} == {None: 0, "Z": 1, "a": 2, "b": 3, "é": 4}
    assert ranks.positions(df.limit(0), ["k"]).count() == 0
    assert Counter(r.p for r in ranks.positions(df, ["n"], "p").collect()) == Counter(range(500))


def test_notes_of_a_suggestion(spark):
    df = spark.range(200).select((F.col("id") % 90).cast("double").alias("dropout"), (F.col("id") % 7).alias("edad"))
    found, notes = suggest.suggest(df)
    assert found.inverted and any("menos es mejor" in n for n in notes) and any("No se reconocieron acciones" in n for n in notes)
    odd = spark.range(60).select((F.col("id") % 5).alias("horas"), F.when(F.col("id") % 2 == 0, "verde").otherwise("azul").alias("grupo"))
    found, notes = suggest.suggest(odd)
    assert found.objective.name == "grupo" and any("se propone la última (grupo)" in n for n in notes) and any("Revise el orden de grupo" in n for n in notes)
    assert suggest.certain(["L", "M", "H"]) and suggest.certain(["Graduate", "other"]) and not suggest.certain(["verde", "azul"])
