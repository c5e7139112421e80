"""Single records and hypothetical profiles, and the small views of a chart: always tables, of one row or of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prescriva.functions import numeric, text
from prescriva.operators.encode import Preprocessor
from prescriva.operators.fcm import CognitiveMap, entered
from prescriva.operators.schema import Concept, Schema


def record(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with a key; an unknown one is an error."""
    found = df.where(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise ValueError(f"no row with {key} {value}")
    return found


def resolved(asked: DataFrame, name: str, columns: DataFrame, column: str) -> DataFrame:
    """(name, column): what each asked name means: a column's exact name, else one that is equal without case, accents and signs; null for none."""
    plain = lambda c: F.regexp_replace(text.folded(F.col(c)), "[^a-z0-9]+", "")
    known = columns.select(F.col(column).alias("_exact"), plain(column).alias("_plain"))
    exact = asked.join(known.select("_exact"), F.col(name) == F.col("_exact"), "left")
    loose = known.groupBy("_plain").agg(F.min("_exact").alias("_loose"))
    return exact.join(loose, plain(name) == F.col("_plain"), "left").select(name, F.coalesce("_exact", "_loose").alias("column"))


def normalized_value(p: Preprocessor, column: str, shown: Column) -> Column:
    """A value as text (a level of the objective, a category of an ordered column, or a number) in [0, 1]; null for what is none of them."""
    spec = p.schema.spec(column)
    concept = next(c for c in p.schema.concepts if c.column == column)
    number = shown.try_cast("double")
    for i, k in enumerate(spec.order):
        number = F.when(shown == k, float(i)).otherwise(number)
    scaled = numeric.min_max(number, p.lows[concept.id], p.highs[concept.id])
    if spec.role == "objetivo":
        for k, v in p.schema.level_values.items():
            scaled = F.when(shown == k, v).otherwise(scaled)
    return scaled


def nearest_category(p: Preprocessor, column: str, value: Column) -> Column:
    """The category whose code is nearest to a value of [0, 1]; of two equally near ones the lower."""
    spec = p.schema.spec(column)
    concept = next(c for c in p.schema.concepts if c.column == column)
    code = p.original(concept.id, value) if spec.role != "objetivo" else value * float(len(spec.order) - 1)
    options = F.array(*(F.struct(F.lit(float(i)).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(spec.order)))
    far = F.transform(options, lambda x: F.struct(F.abs(x.i - code).alias("d"), x.i.alias("i"), x.k.alias("k")))
    return F.when(value.isNotNull(), F.array_min(far).k)


def profile_states(p: Preprocessor, profiles: DataFrame, starts: dict[str, float], keep: list[str]) -> DataFrame:
    """Start states of profiles: all columns but the objective, as text or numbers.

    Moving concepts start from their training means (``starts``). ``complete`` is false
    for a profile that lacks a value, and its concepts are null.
    """
    o = p.schema.objective.name
    needed = list(dict.fromkeys(c.column for c in p.schema.concepts if c.column != o))
    numbers = [c for c in needed if p.schema.spec(c).encoding == "numerica"]
    own = profiles.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numbers})
    complete = F.lit(True)
    for c in needed:
        complete = complete & F.col(c).isNotNull()
    own = own.withColumn("complete", complete)
    own = own if o in own.columns else own.withColumn(o, F.lit(None).cast("string"))
    out = p.transform(own, [*keep, "complete"])
    return out.select(*keep, "complete", *(F.when(F.col("complete"), F.lit(starts[c.id]) if c.id in starts else F.col(c.id)).alias(c.id) for c in p.schema.concepts))


def goals(schema: Schema, spark) -> DataFrame:
    """(level, value, tolerance) of each level of the objective."""
    return spark.createDataFrame([(k, float(v), float(schema.tolerance)) for k, v in schema.level_values.items()], "level string, value double, tolerance double")


def goal_of(schema: Schema, level: str) -> float:
    if level not in schema.level_values:
        raise ValueError(f"unknown level {level}; there are {', '.join(schema.level_values)}")
    return float(schema.level_values[level])


def described(activation: Column, goal: Column, schema: Schema) -> dict[str, Column]:
    """Level of a final activation, and success: the goal is missed by no more than the tolerance; better is success as well."""
    return {"level": numeric.nearest_level(activation, schema.level_values), "success": activation >= goal - schema.tolerance - 1e-9}


def restriction(column: str, delta: float) -> Column:
    """The sentence on a condition that holds for a record."""
    # Fixed text.
    return F.concat(F.lit("Como «"), text.readable(F.lit(column)), F.lit("» está activo, cada acción puede subir como máximo un "), text.percent(F.lit(100.0 * delta), 0), F.lit(" de su rango: con esa condición, los datos casi no registran el mejor nivel."))


def yes_no_by_level(df: DataFrame, column: str, category: str, level: str) -> DataFrame:
    """(category, level, n) of a one-hot concept: rows with the category and rows without."""
    shown = F.when(text.canonical(df, column) == category, "Sí").otherwise("No")
    return df.groupBy(shown.alias("category"), F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def centres(df: DataFrame, level: str, numbers: list[str], categories: list[str]) -> DataFrame:
    """A row for each level: means of numbers and most frequent categories; of equally frequent ones the first by name."""
    out = df.groupBy(F.col(level).alias("level")).agg(*(F.avg(c).alias(c) for c in numbers))
    for c in categories:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(level).alias("level"), c).agg(F.count(F.lit(1)).alias("n"))
        most = counts.groupBy("level").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(c).alias("c"))).alias("b"))
        out = out.join(most.select("level", F.col("b.c").alias(c)), "level", "left")
    return out


def jitter(key: Column, seed: int) -> Column:
    """A displacement in [-1, 1] that depends on the key alone; fixed constants of the usual sine hash."""
    s = F.sin(key * 12.9898 + seed * 78.233) * 43758.5453
    return 2 * (s - F.floor(s)) - 1


def contributions(m: CognitiveMap, concepts: list[Concept], before: Column, after: Column) -> Column:
    """(id, name, role, weight, before, after) of each concept with an edge into the objective, by its share after, the largest first; ``before`` and ``after`` are arrays of states."""
    i = m.ids.index(m.objective)
    parts = []
    for j, c in enumerate(concepts):
        w = float(m.weights[j, i])
        if w:
            share = lambda state, j=j, w=w: F.lit(m.influence * w) * entered(F.get(state, F.lit(j)), m)
            parts.append(F.struct((-F.abs(share(after))).alias("size"), F.lit(j).alias("place"), F.lit(c.id).alias("id"), F.lit(c.name).alias("name"), F.lit(c.role).alias("role"), F.lit(w).alias("weight"), share(before).alias("before"), share(after).alias("after")))
    return F.transform(F.array_sort(F.array(*parts)), lambda p: F.struct(p.id.alias("id"), p["name"].alias("name"), p.role.alias("role"), p.weight.alias("weight"), p.before.alias("before"), p.after.alias("after")))


def before_after(plans: DataFrame, key: str, base: str, end: str, count: int) -> DataFrame:
    """(place, key, base, end) of the first ``count`` plans by what they are before: the points of a chart."""
    first = plans.select(key, base, end).orderBy(F.round(base, 9), key).limit(count)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.round(base, 9), key)))  # at most count rows


def minority(df: DataFrame, level: str, limit: float = 0.25) -> DataFrame:
    """(share, balance): the share of the rarest level, and whether levels should be balanced for it."""
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    share = F.min("n") / F.sum("n")
    return counts.agg(share.alias("share"), (share < limit).alias("balance"))
