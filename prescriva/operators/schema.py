"""The semantic schema of a table: roles, encodings, levels, rules and JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescriva.functions import dates, numeric, text

# Roles and encodings of the wire format.
ROLES = ("inmutable", "accion", "mutable", "objetivo", "excluir")
ENCODINGS = ("numerica", "ordinal", "nominal", "one_hot", "numero_en_texto", "fecha")
NUMERIC_LEVELS = {"Bajo": 0.0, "Medio": 0.5, "Alto": 1.0}
ONE_HOT_MOST, LEAST_ROWS, LEAST_LEVEL_ROWS, NOMINAL_MOST = 30, 30, 20, 50


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    role: str
    encoding: str = "numerica"
    order: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    dynamic: bool = False


@dataclass(frozen=True)
class Concept:
    """A node of the map: a column, or a category of a one-hot column."""

    id: str
    column: str
    name: str
    role: str
    dynamic: bool
    category: str | None = None


@dataclass(frozen=True)
class Schema:
    name: str
    columns: tuple[ColumnSpec, ...]
    threshold: float | None = None
    inverted: bool = False
    levels: dict[str, float] = field(default_factory=dict)

    @property
    def objective(self) -> ColumnSpec:
        return next(c for c in self.columns if c.role == "objetivo")

    def spec(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)

    @property
    def concepts(self) -> list[Concept]:
        """Sorted by role and numbered; the objective is a dynamic mutable and last."""
        rank = {"inmutable": 0, "accion": 1, "mutable": 2, "objetivo": 3}
        out: list[Concept] = []
        for c in sorted((c for c in self.columns if c.role in rank), key=lambda c: rank[c.role]):
            parts = [(f"{c.name}={k}", k) for k in c.categories] if c.encoding == "one_hot" else [(c.name, None)]
            for name, category in parts:
                dynamic = c.role == "objetivo" or (c.dynamic and c.role == "mutable" and category is None)
                out.append(Concept(f"C{len(out) + 1}", c.name, name, "mutable" if c.role == "objetivo" else c.role, dynamic, category))
        return out

    @property
    def level_values(self) -> dict[str, float]:
        """Label -> value in [0, 1]; ordinal levels are equally spaced."""
        if self.levels:
            return dict(self.levels)
        o = self.objective
        if o.encoding == "ordinal":
            return {k: i / max(len(o.order) - 1, 1) for i, k in enumerate(o.order)}
        return dict(NUMERIC_LEVELS)

    @property
    def best_level(self) -> str:
        return max(self.level_values, key=self.level_values.get)

    @property
    def tolerance(self) -> float:
        """Half of the gap below the best level."""
        v = sorted(self.level_values.values())
        return (v[-1] - v[-2]) / 2 if len(v) > 1 else 0.25

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, data: str) -> Schema:
        d = json.loads(data)
        columns = tuple(ColumnSpec(**{**c, "order": tuple(c.get("order", ())), "categories": tuple(c.get("categories", ()))}) for c in d.pop("columns"))
        out = cls(columns=columns, **d)
        if found := out.structural_errors():
            raise ValueError("; ".join(found))
        return out

    def structural_errors(self) -> list[str]:
        """All of them, not only the first."""
        out, names = [], [c.name for c in self.columns]
        out += [f"column {n} is listed more than once" for n in sorted({n for n in names if names.count(n) > 1})]
        objectives = [c for c in self.columns if c.role == "objetivo"]
        if len(objectives) != 1:
            out.append("exactly one column must be the objective")
        if not any(c.role == "accion" for c in self.columns):
            out.append("at least one column must be an action")
        for c in self.columns:
            if c.role not in ROLES or c.encoding not in ENCODINGS:
                out.append(f"column {c.name}: unknown role or encoding")
            if c.role == "excluir":
                continue
            if c.encoding == "ordinal" and (len(c.order) < 2 or len(set(c.order)) < len(c.order)):
                out.append(f"column {c.name}: an order of at least two different categories is needed")
            if c.encoding == "one_hot" and not 2 <= len(c.categories) <= ONE_HOT_MOST:
                out.append(f"column {c.name}: one-hot needs 2 to {ONE_HOT_MOST} categories")
            if c.role == "accion" and c.encoding in ("nominal", "one_hot", "fecha"):
                out.append(f"column {c.name}: an action can't be {c.encoding}")
            if c.role == "objetivo" and c.encoding not in ("ordinal", "numerica"):
                out.append(f"column {c.name}: the objective must be ordinal or numeric")
        return out

    def binarized(self, cut: str | float) -> Schema:
        """The objective with two levels: an ordinal cut (not its worst level) or a numeric threshold."""
        o = self.objective
        if o.encoding == "ordinal":
            if cut not in o.order[1:]:
                raise ValueError(f"the cut must be one of {', '.join(o.order[1:])}")
            at = o.order.index(cut)
            return replace(self, levels={f"<{cut}": 0.0, f"≥{cut}": 1.0}, threshold=at / (len(o.order) - 1))
        return replace(self, levels={f"<{cut:g}": 0.0, f"≥{cut:g}": 1.0}, threshold=float(cut))

    def all_dynamic(self) -> Schema:
        """Every mutable but one-hot indicators is updated by the map."""
        return replace(self, columns=tuple(replace(c, dynamic=c.role == "mutable" and c.encoding != "one_hot") for c in self.columns))


def unknown_categories(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """(category, n): values of an ordinal column that its order hasn't."""
    known = list(spec.order or spec.categories)
    own = df.select(text.canonical(df, spec.name).alias("category")).where(F.col("category").isNotNull() & ~F.col("category").isin(known))
    return own.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def validate(df: DataFrame, schema: Schema) -> DataFrame:
    """One row for each column in use: non-null and readable values and distinct texts, by one aggregation."""
    used = [c for c in schema.columns if c.role != "excluir"]
    missing = [c.name for c in used if c.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    parts = []
    for i, c in enumerate(used):
        own = F.col(c.name)
        shown = text.canonical(df, c.name)
        good = {
            "numerica": own.try_cast("double").isNotNull(),
            "fecha": own.isNotNull() if dict(df.dtypes)[c.name] in ("date", "timestamp") else dates.parsed(own).isNotNull(),
            "numero_en_texto": text.first_number(shown).isNotNull(),
            "ordinal": shown.isin(list(c.order)),
            "one_hot": shown.isin(list(c.categories)),
            "nominal": shown.isNotNull(),
        }[c.encoding]
        parts += [F.count(own).alias(f"present_{i}"), F.sum(F.coalesce(good, F.lit(False)).cast("long")).alias(f"readable_{i}"), F.count_distinct(shown).alias(f"distinct_{i}")]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    rows = [F.struct(F.lit(c.name).alias("column"), F.lit(c.role).alias("role"), F.lit(c.encoding).alias("encoding"), F.col("rows"), *(F.col(f"{k}_{i}").alias(k) for k in ("present", "readable", "distinct"))) for i, c in enumerate(used)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def imputable(schema: Schema) -> list[str]:
    """Columns whose gaps are filled by a median."""
    return [c.name for c in schema.columns if c.role not in ("excluir", "objetivo") and c.encoding in ("numerica", "fecha")]


PROBLEMS = "column string, kind string, severity string, n long"


def problems(df: DataFrame, schema: Schema, segment: tuple[str, str] | None = None) -> DataFrame:
    """(column, kind, severity: error or notice, n) of what is wrong with ``df`` under ``schema``; ``n`` says how many rows, values or categories it concerns.

    Values are judged over complete rows, those without gaps in columns that can't be
    imputed. How far single columns give the objective away and how many rows its levels
    have is asked only where there is no error so far. ``segment``: a column and its value.
    """
    from prescriva.operators import leakage
    from prescriva.operators.encode import objective_value

    spark, used = df.sparkSession, [c for c in schema.columns if c.role != "excluir"]
    make = lambda rows: spark.createDataFrame(rows, PROBLEMS)
    missing = [c.name for c in schema.columns if c.name not in df.columns]
    if missing:
        return make([(c, "missing column", "error", 0) for c in missing])
    filled = imputable(schema)
    whole = df.dropna(subset=[c.name for c in used if c.name not in filled])
    everywhere, seen = ({r["column"]: r for r in validate(d, schema).collect()} for d in (df, whole))  # a row for each column
    rows, complete = (next(iter(x.values())).rows for x in (everywhere, seen))
    out = [(c.name, "no values", "error", rows) for c in used if everywhere[c.name].present == 0]
    out += [(None, "dropped rows", "notice", rows - complete)] * (complete < rows)
    out += [(c, "filled gaps", "notice", complete - seen[c].present) for c in filled if seen[c].present < complete]
    out += [(None, "too few rows", "error", complete)] * (complete < LEAST_ROWS)
    named = {"fecha": "not dates", "numerica": "not numbers", "ordinal": "unknown categories", "numero_en_texto": "without digits"}
    for c in used:
        r = seen[c.name]
        if c.encoding == "one_hot":
            found = {x.category for x in whole.select(text.canonical(whole, c.name).alias("category")).where(F.col("category").isin(list(c.categories))).distinct().collect()}
            out += [(c.name, "categories without a concept", "notice", r.distinct - len(found))] * (r.distinct > len(found))
            out += [(c.name, "listed categories without rows", "notice", len(c.categories) - len(found))] * (len(found) < len(c.categories))
        elif c.encoding in named and r.readable < r.present:
            out.append((c.name, named[c.encoding], "error", r.present - r.readable))
        elif c.encoding == "numerica" and r.distinct < 2:
            out.append((c.name, "a single value", "notice", r.distinct))
        elif c.encoding == "nominal" and r.distinct > NOMINAL_MOST:
            out.append((c.name, "many categories", "notice", r.distinct))
    if not any(x[2] == "error" for x in out):
        goal = schema.objective
        number = F.col(goal.name).try_cast("double")
        ends = tuple(whole.agg(F.min(number), F.max(number)).first()) if goal.encoding == "numerica" else None
        leveled = whole.withColumn("_level", numeric.nearest_level(objective_value(whole, schema, ends), schema.level_values))
        inputs = [c.name for c in used if c.name != goal.name]
        out += [(r.column, "leak", "notice", r.distinct) for r in leakage.determining_columns(leveled, inputs, "_level").orderBy("column").collect()]
        counts = {r["_level"]: r["count"] for r in leveled.groupBy("_level").count().collect()}
        best = schema.best_level
        out += [(goal.name, "nobody in the best level", "error", 0)] * (not counts.get(best))
        out += [(goal.name, f"few rows of {k}", "notice", counts[k]) for k in schema.level_values if 0 < counts.get(k, 0) < LEAST_LEVEL_ROWS]
        out += [(goal.name, "all in the best level", "error", complete)] * (set(counts) <= {best})
    if segment and segment[0] not in df.columns:
        out.append((segment[0], "missing segment column", "error", 0))
    elif segment and df.where(text.canonical(df, segment[0]) == segment[1]).isEmpty():
        out.append((segment[0], "empty segment", "notice", 0))
    return make(out)
