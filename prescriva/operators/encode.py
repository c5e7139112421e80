"""Encoders and scalers: fitted on one table, applied to any as column expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prescriva.functions import dates, numeric, text
from prescriva.operators import quantiles
from prescriva.operators.schema import Schema

SMOOTHING, TAIL, FENCE = 10.0, 0.01, 3.0
#: A nominal column's means are a literal map of at most so many categories; a column of more is an error that names ``target_means``, whose result can be joined.
MAP_MOST = 1000


def ordinal(c: Column, order: tuple[str, ...]) -> Column:
    """Code of a category text; null for an unknown one (``schema.unknown_categories`` lists those)."""
    out = F.lit(None).cast("double")
    for i, k in enumerate(order):
        out = F.when(c == k, float(i)).otherwise(out)
    return out


def one_hot(c: Column, category: str) -> Column:
    """1 for the category and 0 for all else, unknown ones and nulls included."""
    return F.coalesce((c == category).cast("double"), F.lit(0.0))


def objective_value(df: DataFrame, schema: Schema, ends: tuple[float, float] | None = None) -> Column:
    """The objective in [0, 1]: an ordinal code over the largest, a numeric one by ``ends`` (min, max of the fitting table)."""
    o = schema.objective
    if o.encoding == "ordinal":
        code = ordinal(text.canonical(df, o.name), o.order) / float(len(o.order) - 1)
        return code if schema.threshold is None else (code >= schema.threshold - 1e-12).cast("double")
    value = F.col(o.name).cast("double")
    if schema.threshold is not None:
        return (value <= schema.threshold if schema.inverted else value >= schema.threshold).cast("double")
    low, high = ends or (0.0, 1.0)
    scaled = numeric.min_max(value, low, high)
    return 1.0 - scaled if schema.inverted else scaled


def target_means(df: DataFrame, column: str, y: Column, smoothing: float = SMOOTHING) -> DataFrame:
    """(category, n, encoded): each category's mean of ``y``, drawn to the overall mean as if that had ``smoothing`` rows."""
    rows = df.select(text.canonical(df, column).alias("category"), y.alias("y")).where("category is not null and y is not null")
    sums = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    total = sums.agg((F.sum("s") / F.sum("n")).alias("overall"))
    return sums.crossJoin(F.broadcast(total)).select("category", "n", ((F.col("s") + smoothing * F.col("overall")) / (F.col("n") + smoothing)).alias("encoded"))  # one row


def limits_of(df: DataFrame, robust: list[str], plain: list[str] = (), tail: float = TAIL, fence: float = FENCE) -> dict[str, tuple[float, float]]:
    """Column -> (low, high); of ``plain`` columns min and max. An aggregation, the passes of exact quartiles, and one more only if a value lies beyond a fence."""
    number = {c: F.col(c).cast("double") for c in (*robust, *plain)}
    parts = [x for i, (c, v) in enumerate(number.items()) for x in (F.min(v).alias(f"min_{i}"), F.max(v).alias(f"max_{i}"), F.count(v).alias(f"n_{i}"))]
    first = df.agg(*parts).first()
    quartiles = quantiles.quantiles(df, list(robust), (0.25, 0.75)) if robust else {}
    out = {c: (first[f"min_{i}"], first[f"max_{i}"]) for i, c in enumerate(number)}
    beyond = []
    for i, c in enumerate(robust):
        q1, q3 = quartiles.get(("", c), (None, None))
        if q1 is None or q3 <= q1:
            continue
        for side, at, past in ((0, q1 - fence * (q3 - q1), number[c] < q1 - fence * (q3 - q1)), (1, q3 + fence * (q3 - q1), number[c] > q3 + fence * (q3 - q1))):
            if (out[c][0] < at) if side == 0 else (out[c][1] > at):
                beyond.append((c, side, at, F.sum(past.cast("long")), first[f"n_{i}"]))
    shares = df.agg(*(x[3].alias(f"t{k}") for k, x in enumerate(beyond))).first() if beyond else ()
    for (c, side, at, _, n), k in zip(beyond, shares, strict=True):
        if k / n <= tail:
            out[c] = (at, out[c][1]) if side == 0 else (out[c][0], at)
    return out


def robust_limits(df: DataFrame, columns: list[str], tail: float = TAIL, fence: float = FENCE) -> DataFrame:
    """(column, low, high): min and max, where a side whose few outliers lie beyond the fence ends at the fence.

    The fence is ``fence`` interquartile ranges from the quartiles; a side is clipped if
    it reaches beyond and at most ``tail`` of the values do.
    """
    found = limits_of(df, columns, (), tail, fence)
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in columns], "column string, low double, high double")


@dataclass
class Preprocessor:
    """Fitted parameters; plain values, so that they go to JSON and back."""

    schema: Schema
    overall: float = 0.0
    ends: tuple[float, float] | None = None
    nominal: dict[str, dict[str, float]] = field(default_factory=dict)
    first_dates: dict[str, str] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    lows: dict[str, float] = field(default_factory=dict)
    highs: dict[str, float] = field(default_factory=dict)

    def encoded(self, df: DataFrame) -> dict[str, Column]:
        """Concept id -> unscaled number, imputed by the training median where the column may be."""
        out = {}
        for c in self.schema.concepts:
            spec = self.schema.spec(c.column)
            shown = text.canonical(df, c.column)
            if spec.role == "objetivo":
                value = objective_value(df, self.schema, self.ends)
            elif c.category is not None:
                value = one_hot(shown, c.category)
            elif spec.encoding == "ordinal":
                value = ordinal(shown, spec.order)
            elif spec.encoding == "numero_en_texto":
                value = text.first_number(shown)
            elif spec.encoding == "nominal":
                pairs = [F.lit(x) for kv in self.nominal.get(c.column, {}).items() for x in kv]
                value = F.coalesce(F.try_element_at(F.create_map(*pairs), shown), F.lit(self.overall)) if pairs else F.lit(self.overall)
            elif spec.encoding == "fecha":
                own = F.col(c.column)
                date = own.cast("date") if dict(df.dtypes)[c.column] in ("date", "timestamp", "timestamp_ntz") else dates.parsed(own)
                value = dates.days_since(date, self.first_dates.get(c.column))
            else:
                value = F.col(c.column).cast("double")
            if c.id in self.medians:
                value = F.coalesce(value, F.lit(self.medians[c.id]))
            out[c.id] = value
        return out

    @classmethod
    def fit(cls, df: DataFrame, schema: Schema) -> Preprocessor:
        """Passes, one for each level of dependence: objective and first dates; category means; medians; limits."""
        p = cls(schema)
        o = schema.objective
        used = [schema.spec(n) for n in dict.fromkeys(c.column for c in schema.concepts)]
        ends = [F.min(F.col(o.name).cast("double")), F.max(F.col(o.name).cast("double"))] if o.encoding == "numerica" else []
        date_of = lambda n: F.col(n).cast("date") if dict(df.dtypes)[n] in ("date", "timestamp", "timestamp_ntz") else dates.parsed(F.col(n))
        date_columns = [c.name for c in used if c.encoding == "fecha"]
        mean = [] if ends and schema.threshold is None else [F.avg(objective_value(df, schema))]
        row = df.agg(F.count(F.lit(1)), *ends, *(F.min(date_of(n)).cast("string") for n in date_columns), *mean).first()
        if ends:
            p.ends = (row[1], row[2])
        at = 1 + len(ends)
        p.first_dates = dict(zip(date_columns, row[at : at + len(date_columns)], strict=True))
        y = objective_value(df, schema, p.ends)
        p.overall = (row[-1] if mean else df.agg(F.avg(y)).first()[0]) or 0.0
        for c in used:
            if c.encoding == "nominal":
                means = target_means(df, c.name, y).limit(MAP_MOST + 1).collect()
                if len(means) > MAP_MOST:
                    raise ValueError(f"{c.name}: more than {MAP_MOST} categories; join target_means instead")
                p.nominal[c.name] = {r.category: r.encoded for r in means}
        imputable = [c.id for c in schema.concepts if schema.spec(c.column).encoding in ("numerica", "fecha") and schema.spec(c.column).role != "objetivo"]
        raw = df.select(*(v.alias(k) for k, v in p.encoded(df).items()))
        if imputable:
            p.medians = quantiles.medians(raw, imputable)
        filled = df.select(*(v.alias(k) for k, v in p.encoded(df).items()))
        found = limits_of(filled, imputable, [k for k in filled.columns if k not in imputable])
        p.lows = {k: found[k][0] or 0.0 for k in filled.columns}
        p.highs = {k: found[k][1] or 0.0 for k in filled.columns}
        return p

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns and each concept in [0, 1], as one projection."""
        return df.select(*(keep or []), *(numeric.min_max(v, self.lows[k], self.highs[k]).alias(k) for k, v in self.encoded(df).items()))

    def action_grids(self) -> tuple[tuple[str, tuple[float, ...]], ...]:
        """The values in [0, 1] that ordinal actions may have; other actions may have any."""
        scaled = lambda k, v: 0.0 if self.highs[k] == self.lows[k] else min(max((v - self.lows[k]) / (self.highs[k] - self.lows[k]), 0.0), 1.0)
        return tuple((c.id, tuple(sorted({scaled(c.id, float(i)) for i in range(len(self.schema.spec(c.column).order))}))) for c in self.schema.concepts if c.role == "accion" and self.schema.spec(c.column).encoding == "ordinal")

    def original(self, concept: str, c: Column) -> Column:
        """A value of [0, 1] in the column's own unit."""
        return c * (self.highs[concept] - self.lows[concept]) + self.lows[concept]

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "schema": self.schema.to_json()}, ensure_ascii=False)

    @classmethod
    def from_json(cls, data: str) -> Preprocessor:
        d = json.loads(data)
        d["ends"] = tuple(d["ends"]) if d["ends"] else None
        return cls(**{**d, "schema": Schema.from_json(d["schema"])})
