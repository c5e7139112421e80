"""The example table: one row per customer, with an outcome by spending; and its schema and a fixed map."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.operators.encode import Preprocessor
from prescriva.operators.fcm import CognitiveMap
from prescriva.operators.schema import ColumnSpec, Schema
from prescriva.sources.tables import written

LEVELS = {"L": 0.0, "M": 0.5, "H": 1.0}
ACTIONS = ["n_orders", "avg_qty", "avg_discount"]
SCALED = [*ACTIONS, "acctbal", "urgent_share"]
WEIGHTS = {"n_orders": 0.8, "avg_qty": 0.1, "avg_discount": -0.1, "acctbal": 0.05, "urgent_share": -0.15}
BIAS, SLOPE, STEPS = -0.9, 2.0, 30

SCHEMA = Schema(
    "customer_outcome",
    (
        ColumnSpec("n_orders", "accion"),
        ColumnSpec("avg_qty", "accion"),
        ColumnSpec("avg_discount", "accion"),
        ColumnSpec("acctbal", "mutable"),
        ColumnSpec("urgent_share", "mutable"),
        ColumnSpec("outcome", "objetivo", "ordinal", ("L", "M", "H")),
    ),
)
FULL_SCHEMA = Schema(
    "customer_outcome",
    (
        ColumnSpec("mkt", "inmutable", "nominal"),
        ColumnSpec("nation", "inmutable", "nominal"),
        ColumnSpec("region", "inmutable", "one_hot", categories=("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")),
        *SCHEMA.columns[:-1],
        ColumnSpec("last_order", "mutable", "fecha"),
        SCHEMA.columns[-1],
    ),
)


def customer_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregations below the joins, so that each side is one row per customer before it is shuffled."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("long")
    # Sums of decimals are the same in any order, so that the table is the same whenever it is made.
    total = lambda c: F.sum(F.col(c).cast("decimal(20,4)")).cast("double")
    by_customer = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), total("o_totalprice").alias("spend"), F.max("o_orderdate").alias("last_order"), (F.sum(urgent) / F.count(F.lit(1))).alias("urgent_share"))
    lines = read("lineitem").select("l_orderkey", "l_quantity", "l_discount").join(orders.select("o_orderkey", F.col("o_custkey").alias("li_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    by_line = lines.groupBy("li_custkey").agg((total("l_quantity") / F.count("l_quantity")).alias("avg_qty"), (total("l_discount") / F.count("l_discount")).alias("avg_discount"))
    by_event = read("events").select("user_id", "event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("n_purchases"))
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    out = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.join(by_customer, F.col("c_custkey") == F.col("o_custkey"), "left").join(by_line, F.col("c_custkey") == F.col("li_custkey"), "left").join(by_event, F.col("c_custkey") == F.col("user_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    spend = F.coalesce("spend", F.lit(0.0))
    return out.select(
        F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("mkt"), "nation", "region", F.col("c_acctbal").alias("acctbal"), zero("n_orders"), "avg_qty", "avg_discount", zero("n_events"), zero("n_purchases"), "urgent_share", "last_order",
        spend.alias("spend"), F.when(spend < 2_000_000, "L").when(spend < 3_000_000, "M").otherwise("H").alias("outcome"),
    )


def scaled_outcome(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Preprocessor]:
    """(row_id, outcome, scaled columns by their own names and ``y``), and what was fitted."""
    # Fitting passes over the table several times; joined once, it is read from then on.
    df = written(customer_outcome(spark, sf_dir).select("row_id", "region", *(c.name for c in SCHEMA.columns)), "outcome")
    p = Preprocessor.fit(df, SCHEMA)
    names = {c.id: (c.column if c.column != "outcome" else "y") for c in SCHEMA.concepts}
    x = p.transform(df, ["row_id", "region", "outcome"])
    return x.select("row_id", "region", "outcome", *(F.col(k).alias(v) for k, v in names.items())), p


def fixed_map(rule: str = "kosko_modificada", activation: str = "sigmoide") -> CognitiveMap:
    """One moving concept, ``y``, with the fixed weights."""
    ids = [*SCALED, "y"]
    w, b = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
    for k, v in WEIGHTS.items():
        w[ids.index(k), ids.index("y")] = v
    b[ids.index("y")] = BIAS
    return CognitiveMap(ids, ["y"], "y", w, b, rule, activation, SLOPE, steps=STEPS)


def two_moving() -> CognitiveMap:
    """``acctbal`` moves too, driven by ``n_orders`` and the outcome's other drivers."""
    m = fixed_map()
    w, b = m.weights.copy(), m.bias.copy()
    a = m.ids.index("acctbal")
    w[m.ids.index("n_orders"), a], w[m.ids.index("avg_qty"), a], b[a] = 0.4, -0.2, -0.5
    return CognitiveMap(m.ids, ["acctbal", "y"], "y", w, b, m.rule, m.activation, m.slope, steps=STEPS)


OUTCOME_CTE = """
ord AS (SELECT o_custkey, COUNT(*) AS n_orders, SUM(o_totalprice::DECIMAL(20,4))::DOUBLE AS spend, MAX(o_orderdate) AS last_order,
  AVG(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS urgent_share FROM orders GROUP BY o_custkey),
li AS (SELECT o_custkey, SUM(l_quantity::DECIMAL(20,4))::DOUBLE / COUNT(l_quantity) AS avg_qty, SUM(l_discount::DECIMAL(20,4))::DOUBLE / COUNT(l_discount) AS avg_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
ev AS (SELECT user_id, COUNT(*) AS n_events, SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n_purchases FROM events GROUP BY user_id),
co AS (SELECT c_custkey AS row_id, c_mktsegment AS mkt, n_name AS nation, r_name AS region, c_acctbal AS acctbal, COALESCE(n_orders, 0) AS n_orders, avg_qty, avg_discount,
  COALESCE(n_events, 0) AS n_events, COALESCE(n_purchases, 0) AS n_purchases, urgent_share, last_order, COALESCE(spend, 0) AS spend,
  CASE WHEN COALESCE(spend, 0) < 2000000 THEN 'L' WHEN COALESCE(spend, 0) < 3000000 THEN 'M' ELSE 'H' END AS outcome
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN ord ON c_custkey = ord.o_custkey LEFT JOIN li ON c_custkey = li.o_custkey LEFT JOIN ev ON c_custkey = ev.user_id)
"""


def _limits_cte(columns: list[str]) -> str:
    """Medians, filled values and robust limits of each column, then the scaled table ``sx``."""
    filled = ", ".join(f"COALESCE({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM co)) AS {c}" for c in columns)
    q = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}, MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}" for c in columns)
    tails = ", ".join(f"AVG(CASE WHEN {c} < a_{c} - 3 * (b_{c} - a_{c}) THEN 1.0 ELSE 0.0 END) AS t_{c}, AVG(CASE WHEN {c} > b_{c} + 3 * (b_{c} - a_{c}) THEN 1.0 ELSE 0.0 END) AS u_{c}" for c in columns)
    ends = ", ".join(
        f"CASE WHEN b_{c} > a_{c} AND lo_{c} < a_{c} - 3 * (b_{c} - a_{c}) AND t_{c} <= 0.01 THEN a_{c} - 3 * (b_{c} - a_{c}) ELSE lo_{c} END AS low_{c}, CASE WHEN b_{c} > a_{c} AND hi_{c} > b_{c} + 3 * (b_{c} - a_{c}) AND u_{c} <= 0.01 THEN b_{c} + 3 * (b_{c} - a_{c}) ELSE hi_{c} END AS high_{c}"
        for c in columns
    )
    scaled = ", ".join(f"GREATEST(LEAST(({c} - low_{c}) / (CASE WHEN high_{c} = low_{c} THEN 1 ELSE high_{c} - low_{c} END), 1.0), 0.0) AS {c}" for c in columns)
    return f"""
fx AS (SELECT row_id, region, outcome, CASE outcome WHEN 'L' THEN 0.0::DOUBLE WHEN 'M' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS y, {filled} FROM co),
qx AS (SELECT {q} FROM fx), tx AS (SELECT {tails} FROM fx, qx), lx AS (SELECT {ends} FROM qx, tx),
sx AS (SELECT row_id, region, outcome, y, {scaled} FROM fx, lx)
"""


def sql(body: str) -> str:
    """``body`` over ``co``."""
    return f"WITH {OUTCOME_CTE} {body}"


def scaled_sql(body: str) -> str:
    """``body`` over ``sx``, the scaled table, and ``lx``, its limits."""
    return f"WITH {OUTCOME_CTE}, {_limits_cte(SCALED)} {body}"


def pull_sql(prefix: str = "", a: float = 1.0, c: float = 0.0) -> str:
    return "(" + " + ".join([str(BIAS), *(f"({v}) * ({a} * {prefix}{k} + {c})" for k, v in WEIGHTS.items())]) + ")"


def infer_sql(start: str = "0.5", pull: str | None = None, steps: int = STEPS, memory: float = 1.0, a: float = 1.0, c: float = 0.0, slope: float = SLOPE) -> str:
    """The unrolled recurrence."""
    out = start
    for _ in range(steps):
        out = f"1 / (1 + exp(-{slope} * ({memory} * ({a} * {out} + {c}) + p)))" if memory else f"1 / (1 + exp(-{slope} * p))"
    return out


LEVEL_SQL = "CASE WHEN v <= 0.25 THEN 'L' WHEN v <= 0.75 THEN 'M' ELSE 'H' END"
