"""Queries of single records, profiles, folds and charts, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from prescriva.operators import evaluate, individual, learn, prescribe, split
from prescriva.plans import outcome as o
from prescriva.plans import prescriptive, registry
from prescriva.plans.registry import query, rounded
from prescriva.sources import registry as store
from prescriva.sources import tables

_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in o.SCALED)


def _ids() -> dict[str, str]:
    return {c.column: c.id for c in o.SCHEMA.concepts}


@query(o.sql("SELECT row_id, outcome, n_orders, ROUND(acctbal, 6) AS acctbal FROM co WHERE row_id = 77"))
def record_lookup(spark, sf_dir):
    return rounded(individual.record(o.customer_outcome(spark, sf_dir), "row_id", 77).select("row_id", "outcome", "n_orders", "acctbal"))


@query("SELECT asked AS name, n_name AS \"column\" FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '-' || lower(replace(n_name, ' ', '.')) END AS asked, n_name FROM nation UNION ALL SELECT 'nowhere', NULL)")
def resolved_columns(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    asked = nations.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("-"), F.lower(F.replace("n_name", F.lit(" "), F.lit("."))))).alias("name"))
    return individual.resolved(asked.unionByName(spark.createDataFrame([("nowhere",)], "name string")), "name", nations, "n_name")


@query(o.scaled_sql("SELECT c.row_id, ROUND(s.n_orders, 6) AS n_orders, ROUND(s.y, 6) AS outcome FROM co c JOIN sx s USING (row_id)"))
def normalized_values(spark, sf_dir):
    _, p = o.scaled_outcome(spark, sf_dir)
    own = o.customer_outcome(spark, sf_dir).select("row_id", F.col("n_orders").cast("string"), "outcome")
    return rounded(own.select("row_id", *(individual.normalized_value(p, c, F.col(c)).alias(c) for c in ("n_orders", "outcome"))))


@query(o.scaled_sql(f", {registry._PREDICTED} SELECT outcome, level AS category, COUNT(*) AS n FROM pr GROUP BY 1, 2"))
def nearest_categories(spark, sf_dir):
    _, p = o.scaled_outcome(spark, sf_dir)
    predicted = registry._predicted(spark, sf_dir)
    return predicted.groupBy("outcome", individual.nearest_category(p, "outcome", F.col("v")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(o.scaled_sql("SELECT c.row_id, " + _NOT_NULL + " AS complete, " + ", ".join(f"CASE WHEN {_NOT_NULL} THEN ROUND(s_{c}, 6) END AS {c}" for c in o.SCALED) + f", CASE WHEN {_NOT_NULL} THEN ROUND((SELECT AVG(y) FROM sx), 6) END AS y FROM co c JOIN (SELECT row_id, " + ", ".join(f"{c} AS s_{c}" for c in o.SCALED) + " FROM sx) s USING (row_id)"))
def profile_state(spark, sf_dir):
    """Customers as profiles: everything but the outcome, as text."""
    x, p = o.scaled_outcome(spark, sf_dir)
    profiles = o.customer_outcome(spark, sf_dir).select("row_id", *(F.col(c).cast("string").alias(c) for c in o.SCALED))
    ids = _ids()
    out = individual.profile_states(p, profiles, {ids["outcome"]: x.agg(F.avg("y")).first()[0]}, ["row_id"])
    return rounded(out.select("row_id", "complete", *(F.col(ids[c]).alias(c) for c in o.SCALED), F.col(ids["outcome"]).alias("y")))


@query(o.sql("SELECT DISTINCT outcome AS level, CASE outcome WHEN 'L' THEN 0.0 WHEN 'M' THEN 0.5 ELSE 1.0 END::DOUBLE AS value, 0.25::DOUBLE AS tolerance FROM co"))
def goal_descriptors(spark, sf_dir):
    seen = o.customer_outcome(spark, sf_dir).select(F.col("outcome").alias("level")).distinct()
    return individual.goals(o.SCHEMA, spark).join(seen, "level")


@query(registry._planned_sql("SELECT row_id, ROUND(e, 6) AS activation, CASE ve WHEN 0.0 THEN 'L' WHEN 0.5 THEN 'M' ELSE 'H' END AS level, e >= goal - 0.25 - 1e-9 AS success FROM pg"))
def described_final(spark, sf_dir):
    plans = registry._planned(spark, sf_dir)
    told = individual.described(F.col("end"), F.col("goal"), o.SCHEMA)
    return rounded(plans.select("row_id", F.col("end").alias("activation"), *(v.alias(k) for k, v in told.items())))


@query(o.scaled_sql("SELECT row_id, 'Como «Urgent share» está activo, cada acción puede subir como máximo un 15 % de su rango: con esa condición, los datos casi no registran el mejor nivel.' AS sentence FROM sx WHERE urgent_share >= 0.5"))
def restriction_sentences(spark, sf_dir):
    x, _ = o.scaled_outcome(spark, sf_dir)
    return x.where(prescribe.capped(prescribe.Plan(("n_orders",), condition="urgent_share"))).select("row_id", individual.restriction("urgent_share", 0.15).alias("sentence"))


@query(o.sql("SELECT CASE WHEN region = 'ASIA' THEN 'Sí' ELSE 'No' END AS category, outcome AS level, COUNT(*) AS n FROM co GROUP BY 1, 2"))
def yes_no_by_level(spark, sf_dir):
    return individual.yes_no_by_level(o.customer_outcome(spark, sf_dir), "region", "ASIA", "outcome")


@query(o.sql("SELECT a.level, a.acctbal, b.nation FROM (SELECT outcome AS level, ROUND(AVG(acctbal), 6) AS acctbal FROM co GROUP BY 1) a JOIN (SELECT level, nation FROM (SELECT outcome AS level, nation, ROW_NUMBER() OVER (PARTITION BY outcome ORDER BY COUNT(*) DESC, nation) AS r FROM co GROUP BY 1, 2) WHERE r = 1) b USING (level)"))
def centres_by_level(spark, sf_dir):
    return rounded(individual.centres(o.customer_outcome(spark, sf_dir), "outcome", ["acctbal"], ["nation"]))


@query(o.sql("SELECT row_id, ROUND(2 * (s - floor(s)) - 1, 6) AS dx FROM (SELECT row_id, sin(row_id * 12.9898::DOUBLE + 3 * 78.233::DOUBLE) * 43758.5453::DOUBLE AS s FROM co)"))
def jittered_points(spark, sf_dir):
    return rounded(o.customer_outcome(spark, sf_dir).select("row_id", individual.jitter(F.col("row_id"), 3).alias("dx")))


@query(registry._planned_sql("SELECT CAST(ROW_NUMBER() OVER (ORDER BY ROUND(b, 9), row_id) AS INTEGER) AS place, row_id, ROUND(b, 6) AS base, ROUND(e, 6) AS \"end\" FROM pg ORDER BY ROUND(b, 9), row_id LIMIT 200"))
def before_after(spark, sf_dir):
    return rounded(individual.before_after(registry._planned(spark, sf_dir), "row_id", "base", "end", 200))


@query(registry._planned_sql("SELECT ROUND(MAX(abs(e - b)), 6) AS widest FROM pg"))
def bar_domain(spark, sf_dir):
    return rounded(registry._planned(spark, sf_dir).agg(F.max(F.abs(F.col("end") - F.col("base"))).alias("widest")))


@query(o.sql("SELECT ROUND(MIN(n) / SUM(n), 6) AS share, MIN(n) / SUM(n) < 0.25 AS balance FROM (SELECT COUNT(*) AS n FROM co GROUP BY outcome)"))
def minority_share(spark, sf_dir):
    return rounded(individual.minority(o.customer_outcome(spark, sf_dir), "outcome"))


@query(o.scaled_sql(f", {registry._PREDICTED}, c AS (SELECT k, COUNT(*) FILTER (outcome = k AND level = k) AS h, COUNT(*) FILTER (level = k) AS s, COUNT(*) FILTER (outcome = k) AS t FROM pr, {registry._LV} AS l(k) GROUP BY k) SELECT ROUND(AVG(COALESCE(2.0 * h / NULLIF(s + t, 0), 0)), 6) AS macro_f1 FROM c"))
def macro_f1(spark, sf_dir):
    return rounded(evaluate.macro_f1(registry._predicted(spark, sf_dir), "outcome", "level", list(o.LEVELS)))


@query(o.sql(", oy AS (SELECT row_id % 5 AS f, nation, CASE outcome WHEN 'L' THEN 0.0 WHEN 'M' THEN 0.5 ELSE 1.0 END AS y FROM co), fs AS (SELECT DISTINCT f AS fold FROM oy), a AS (SELECT fold, AVG(y) AS overall FROM fs JOIN oy ON f <> fold GROUP BY fold), m AS (SELECT fold, nation, (SUM(y) + 10 * ANY_VALUE(overall)) / (COUNT(*) + 10) AS encoded FROM a JOIN oy ON f <> fold GROUP BY fold, nation), b AS (SELECT fold, MIN(v) AS lo, MAX(v) AS hi FROM (SELECT fold, COALESCE(encoded, overall) AS v FROM a JOIN oy ON f <> fold LEFT JOIN m USING (fold, nation)) GROUP BY fold) SELECT CAST(fold AS INTEGER) AS fold, nation, f = fold AS held, COUNT(*) AS n, ROUND(ANY_VALUE((COALESCE(encoded, overall) - lo) / (hi - lo)), 6) AS encoded FROM a JOIN b USING (fold) JOIN oy ON true LEFT JOIN m USING (fold, nation) GROUP BY fold, nation, f = fold"))
def cv_fold_encoding(spark, sf_dir):
    """What each fold's encoders, fitted without it, make of its own and the other rows."""
    from prescriva.operators.schema import ColumnSpec, Schema

    s = Schema("t", (ColumnSpec("nation", "inmutable", "nominal"), *o.SCHEMA.columns[:1], o.SCHEMA.columns[-1]))
    df = o.customer_outcome(spark, sf_dir).select("row_id", "nation", "n_orders", "outcome", F.pmod("row_id", F.lit(5)).cast("int").alias("part"))
    parts = learn.fold_parts(tables.written(df, "outcome"), s, "part", ["row_id", "nation"])
    x = parts.groupBy("fold", "nation", "held").agg(F.count(F.lit(1)).alias("n"), F.max(s.concepts[0].id).alias("encoded"))
    return rounded(x)


@query(o.sql("SELECT COUNT(*) AS searched, 0::BIGINT AS outside, 0::BIGINT AS lowered FROM co WHERE outcome <> 'H'"))
def prescribed_discrete(spark, sf_dir):
    """A search with an action that has five admissible values: none outside, none below what it was."""
    x, _ = o.scaled_outcome(spark, sf_dir)
    values = (0.0, 0.25, 0.5, 0.75, 1.0)
    x = x.withColumn("n_orders", F.round(F.col("n_orders") * 4) / 4)
    goals = prescribe.step_goals(x, "outcome", o.LEVELS)
    found = prescribe.genetic_prescriptions(goals, o.fixed_map(), prescribe.Plan(("n_orders", "avg_qty"), grids=(("n_orders", values),)), "row_id", "goal")
    own = found.join(goals.select("row_id", "n_orders"), "row_id").withColumn("new", F.get("actions", F.lit(0)))
    count = lambda c: F.sum(c.cast("long"))
    return own.agg(F.count(F.lit(1)).alias("searched"), count(~F.col("new").isin(*values)).alias("outside"), count(F.col("new") < F.col("n_orders")).alias("lowered"))


@query(o.sql(", g AS (SELECT MIN(row_id) AS grp, COUNT(*) AS n FROM co GROUP BY region, mkt, nation) SELECT COUNT(*) AS profiles, SUM(n)::BIGINT AS \"rows\", 1::BIGINT AS folds_of_a_profile, 5::BIGINT AS folds FROM g"))
def profile_folds(spark, sf_dir):
    """Folds by profile: every row has one, and a profile is in one only."""
    own = split.group_id(tables.written(o.customer_outcome(spark, sf_dir).select("row_id", "region", "mkt", "nation", "outcome"), "outcome"), ["region", "mkt", "nation"], "row_id")
    folded = tables.written(split.grouped_folds(own, "group", "outcome"), "folds")
    by = folded.groupBy("group").agg(F.count_distinct("fold").alias("k"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("profiles"), F.sum("n").alias("rows"), F.max("k").alias("folds_of_a_profile")).crossJoin(folded.agg(F.count_distinct("fold").alias("folds")))  # one row each


@query("SELECT c_custkey AS model, n_name AS dataset FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def named_models(spark, sf_dir):
    models = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("model"), F.col("c_nationkey").alias("dataset"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return store.with_dataset_names(models, nations).select("model", F.col("name").alias("dataset"))


@query("SELECT o_custkey AS id, MAX(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY 1 HAVING arg_max(o_orderpriority, o_orderkey) <> '5-LOW'")
def registry_latest(spark, sf_dir):
    """Orders as states of customers' entries: the last one of each, without those that it deletes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    states = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state"), (F.col("o_orderpriority") == "5-LOW").alias("deleted"))
    return store.latest(states).drop("deleted")



def _model(spark, sf_dir):
    """The fixed map as a model: its concepts by the schema's ids, moving ones from their means; 30 steps."""
    x, p = o.scaled_outcome(spark, sf_dir)
    ids = _ids()
    names = [ids[k] for k in o.SCALED] + [ids["outcome"]]
    m = replace(o.fixed_map(), ids=names, dynamic=[names[-1]], objective=names[-1], tolerance=0.0, start={names[-1]: x.agg(F.avg("y")).first()[0]})
    return prescriptive.Model(p, m, {})


_WHOLE = " AND ".join(f"c.{k} IS NOT NULL" for k in o.SCALED)
_PROFILES = f"""w AS (SELECT s.*, {_WHOLE} AS whole, CASE WHEN s.row_id % 5 = 0 THEN GREATEST(LEAST((1000 - low_acctbal) / (high_acctbal - low_acctbal), 1.0), 0.0) ELSE s.acctbal END AS a, (SELECT AVG(y) FROM sx) AS m FROM sx s JOIN co c USING (row_id), lx),
v AS (SELECT row_id, {o.infer_sql(start='m')} AS b FROM (SELECT row_id, m, {o.pull_sql().replace('* acctbal', '* a')} AS p FROM w WHERE whole))"""


@query(o.scaled_sql(f", {_PROFILES} SELECT row_id, ROUND(b, 6) AS base, CASE WHEN row_id % 3 = 0 OR b > 0.25 THEN 'H' ELSE 'M' END AS goal_level, true AS never_worse, true AS raised FROM v"))
def prescribed_profile(spark, sf_dir):
    """Customers as profiles without an outcome: plans for the next level after the inferred one; every third wants the best level, every fifth another account balance."""
    model = _model(spark, sf_dir)
    profiles = o.customer_outcome(spark, sf_dir).select("row_id", *(F.col(c).cast("string").alias(c) for c in o.SCALED))
    keys = profiles.select("row_id")
    wishes = keys.where("row_id % 3 = 0").select("row_id", F.lit("outcome").alias("column"), F.lit("H").alias("value"))
    wishes = wishes.unionByName(keys.where("row_id % 5 = 0").select("row_id", F.lit("acctbal").alias("column"), F.lit("1000").alias("value")))
    found = model.prescribe_records(tables.written(profiles, "profiles"), "row_id", wishes=wishes, profiles=True)
    missed = F.greatest(F.col("goal") - F.col("base"), F.lit(0.0))
    raised = F.col("n_orders_new") >= F.col("n_orders_now") - 1e-9
    return rounded(found.select("row_id", "base", "goal_level", (F.col("cost") <= missed + 1e-9).alias("never_worse"), raised.alias("raised")))


@query(o.scaled_sql(f", {registry._PREDICTED} SELECT 'y' AS concept, ROUND(AVG(abs(v - y)), 6) AS mae, ROUND(SQRT(AVG((v - y) * (v - y))), 6) AS rmse FROM pr"))
def concept_errors(spark, sf_dir):
    own = registry._predicted(spark, sf_dir).select(F.col("v").alias("end_y"), F.col("y").alias("true_y"))
    return rounded(evaluate.concept_errors(own, ["y"]))


@query(o.scaled_sql(f", v AS (SELECT row_id, outcome, n_orders, avg_qty, avg_discount, {o.infer_sql(start='m')} AS v FROM (SELECT *, (SELECT AVG(y) FROM sx) AS m, {o.pull_sql()} AS p FROM sx)) SELECT row_id, outcome AS observed, ROUND(v, 6) AS activation, {o.LEVEL_SQL} AS level, row_id % 3 = 0 AS tested, " + ", ".join(f"ROUND({a} * (high_{a} - low_{a}) + low_{a}, 6) AS {a}_now" for a in o.ACTIONS) + " FROM v, lx"))
def record_views(spark, sf_dir):
    """Each customer's level, prediction and actions; every third is one of the test."""
    df = tables.written(o.customer_outcome(spark, sf_dir), "outcome")
    return rounded(_model(spark, sf_dir).record_view(df, "row_id", df.where("row_id % 3 = 0")).drop("taken", "converged"))
