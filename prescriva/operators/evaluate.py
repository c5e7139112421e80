"""Quality of predictions and prescriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prescriva.functions import numeric


def confusion(df: DataFrame, truth: str, predicted: str, levels: list[str]) -> DataFrame:
    """(truth, predicted, n) for all pairs of levels, 0 included."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(a, b) for a in levels for b in levels], "truth string, predicted string")
    return every.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str, levels: list[str]) -> DataFrame:
    """(level, precision, recall, f1, support); a division by 0 gives 0."""
    t, p = F.col(truth), F.col(predicted)
    parts = [x for i, k in enumerate(levels) for x in (F.sum(((t == k) & (p == k)).cast("long")).alias(f"hit_{i}"), F.sum((p == k).cast("long")).alias(f"said_{i}"), F.sum((t == k).cast("long")).alias(f"is_{i}"))]
    rows = [F.struct(F.lit(k).alias("level"), F.coalesce(F.try_divide(f"hit_{i}", f"said_{i}"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(f"hit_{i}", f"is_{i}"), F.lit(0.0)).alias("recall"), F.col(f"is_{i}").alias("support")) for i, k in enumerate(levels)]
    own = df.agg(*parts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return own.select("level", "precision", "recall", f1.alias("f1"), "support")


def summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, balanced accuracy over levels that occur, share of the largest level."""
    by = df.groupBy(F.col(truth).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(predicted) == F.col(truth)).cast("long")).alias("hits"))
    return by.agg((F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced_accuracy"), (F.max("n") / F.sum("n")).alias("majority"))


def errors(df: DataFrame, value: str, wanted: str) -> DataFrame:
    e = F.col(value) - F.col(wanted)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"))


def prescription_metrics(df: DataFrame, before: str, after: str, goal: str, tolerance: float, change: str) -> DataFrame:
    """One row: errors and success shares before and after, and the mean change of actions."""
    parts = []
    for name, c in (("before", before), ("after", after)):
        e = F.col(c) - F.col(goal)
        parts += [F.avg(F.abs(e)).alias(f"mae_{name}"), F.avg(e * e).alias(f"mse_{name}"), F.sqrt(F.avg(e * e)).alias(f"rmse_{name}"), (F.avg(numeric.within(F.col(c), F.col(goal), tolerance).cast("double")) * 100).alias(f"success_{name}")]
    return df.agg(F.count(F.lit(1)).alias("n"), *parts, F.avg(change).alias("mean_change"))


def success_by_segment(df: DataFrame, column: str, value: str, before: str, after: str) -> DataFrame:
    """(segment, n, before, after): success shares of rows with the value and of the others."""
    segment = F.when(F.col(column) == value, F.concat(F.lit(f"{column} = "), F.lit(value))).otherwise(F.concat(F.lit(f"{column} ≠ "), F.lit(value)))
    return df.groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col(before).cast("double")) * 100).alias("before"), (F.avg(F.col(after).cast("double")) * 100).alias("after"))


def selection_curve(table: DataFrame, alpha: float | None = None) -> DataFrame:
    """(slope, accuracy, spread) of a cross-validation's ``table`` at one alpha, by default that of its best row, in the order of the slopes."""
    best = table.orderBy(F.desc("accuracy"), "mae", "slope", "alpha").first() if alpha is None else None
    chosen = alpha if best is None else best.alpha
    return table.where(F.col("alpha") == F.lit(chosen)).select("slope", "accuracy", "spread").orderBy("slope")


def reached(value: str, levels: dict[str, float]) -> Column:
    """Whether a column's level is the row's ``goal_level`` or a better one."""
    return numeric.reaches(numeric.nearest_level(F.col(value), levels), F.col("goal_level"), levels)


def macro_f1(df: DataFrame, truth: str, predicted: str, levels: list[str]) -> DataFrame:
    """One row: the mean of the levels' F1."""
    return class_metrics(df, truth, predicted, levels).agg(F.avg("f1").alias("macro_f1"))


def concept_errors(df: DataFrame, concepts: list[str]) -> DataFrame:
    """(concept, mae, rmse) of final against observed values (``end_<id>``, ``true_<id>``), all in one aggregation."""
    off = {c: F.col(f"end_{c}") - F.col(f"true_{c}") for c in concepts}
    row = df.agg(*(x for i, e in enumerate(off.values()) for x in (F.avg(F.abs(e)).alias(f"a{i}"), F.sqrt(F.avg(e * e)).alias(f"r{i}"))))
    rows = [F.struct(F.lit(c).alias("concept"), F.col(f"a{i}").alias("mae"), F.col(f"r{i}").alias("rmse")) for i, c in enumerate(concepts)]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def prediction_metrics(df: DataFrame, truth: str, predicted: str, levels: list[str], moving: list[str]) -> dict:
    """All of a prediction's figures: shares, levels, macro F1, confusion, errors of each moving concept, and the steps that inference took."""
    taken = df.agg(F.max("taken").alias("iterations"), F.min("converged").alias("converged")).first()
    return {
        **summary(df, truth, predicted).first().asDict(),
        **macro_f1(df, truth, predicted, levels).first().asDict(),
        "levels": [r.asDict() for r in class_metrics(df, truth, predicted, levels).collect()],
        "confusion": [r.asDict() for r in confusion(df, truth, predicted, levels).collect()],
        "concepts": [r.asDict() for r in concept_errors(df, moving).collect()],
        **taken.asDict(),
    }


def plan_metrics(plans: DataFrame, actions: list[str], levels: dict[str, float], tolerance: float, step_goals: bool) -> dict:
    """All of the plans' figures: errors and success before and after, mean change of an action, mean generations, and how many aim at each level. With step goals, success is a level at the goal or better."""
    change = sum((F.abs(F.col(f"{a}_new") - F.col(a)) for a in actions), F.lit(0.0)) / float(len(actions))
    out = prescription_metrics(plans.withColumn("_change", change), "base", "activation", "goal", tolerance, "_change").first().asDict()
    more = plans.agg((100 * F.avg(reached("base", levels).cast("double"))).alias("before"), (100 * F.avg(reached("activation", levels).cast("double"))).alias("after"), F.avg("generations").alias("generations")).first()
    out["prescribed"] = out.pop("n")
    if step_goals:
        out |= {"success_before": more.before, "success_after": more.after}
    goals = plans.groupBy("goal_level").count().collect()  # a row for each level
    return {**out, "success": out["success_after"], "generations": more.generations, "goals": {r.goal_level: r["count"] for r in goals}}


def forest_validation(train: DataFrame, plans: DataFrame, features: list[str], level: str, levels: dict[str, float], trees: int = 100, seed: int = 42) -> DataFrame:
    """One row: the shares of prescribed rows that a random forest puts at their goal or better, before and after.

    ``plans`` has the features, the same ones with the suffix ``_new``, and ``goal_level``.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(levels)
    coded = train.withColumn("label", sum((F.when(F.col(level) == k, float(i)).otherwise(0.0) for i, k in enumerate(names)), F.lit(0.0)))
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(assemble.transform(coded).select("features", "label"))
    goal = numeric.level_value(F.col("goal_level"), levels)
    shares = []
    own = plans.withColumn("_goal", goal)
    for name, columns in (("before", features), ("after", [f"{f}_new" for f in features])):
        told = model.transform(VectorAssembler(inputCols=columns, outputCol="features").transform(own))
        value = sum((F.when(F.col("prediction") == float(i), v).otherwise(0.0) for i, v in enumerate(levels.values())), F.lit(0.0))
        shares.append(told.agg((F.avg((value >= F.col("_goal")).cast("double")) * 100).alias(f"confirmed_{name}")))
    return shares[0].crossJoin(F.broadcast(shares[1]))  # one row each
