"""The whole run: split, encode, select, learn, evaluate, prescribe; and the model it leaves."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.functions import numeric
from prescriva.operators import evaluate, fcm, individual, learn, prescribe, report, split
from prescriva.operators import wishes as wishes_of
from prescriva.operators.encode import Preprocessor
from prescriva.operators.fcm import CognitiveMap
from prescriva.operators.schema import Schema, unknown_categories
from prescriva.sources import tables

VERSION = 1


@dataclass
class Options:
    """All options with their defaults; unknown ones are ignored, ranges are checked."""

    test_share: float = 0.3
    seed: int = 42
    slope: float = 1.0
    memory: float = 1.0
    influence: float = 1.0
    alpha: float = 1e-3
    rule: str = "kosko_modificada"
    activation: str = "sigmoide"
    method: str = "descent"
    most_steps: int | None = None
    folds: int = 5
    slopes: tuple = learn.SLOPES
    alphas: tuple = learn.ALPHAS
    fold_steps: int = 500
    #: None: where the rarest level has less than a quarter of all rows.
    balance_levels: bool | None = False
    #: Synthetic rows in every training, those of the folds too.
    smote: bool = False
    #: The objective in two levels: a category, not the worst, or a number.
    binarize: str | float | None = None
    #: Rows that share all fixed columns stay on one side ("grouped"), or none do ("random").
    division: str = "grouped"
    all_dynamic: bool = False
    #: A column and its value; success is told for its rows and the others.
    segment: tuple | None = None
    forest: bool = False
    forest_trees: int = 500
    least_profiles: int = 40
    beta: float = 0.4
    reductions: bool = False
    delta_most: float | None = None
    condition: str | None = None
    condition_delta: float | None = 0.15
    step_goals: bool = True
    importance: dict = field(default_factory=dict)
    excluded_edges: tuple = ()
    search: prescribe.Search = field(default_factory=prescribe.Search)

    @classmethod
    def of(cls, given: dict) -> Options:
        known = {f.name for f in fields(cls)}
        out = cls(**{k: v for k, v in given.items() if k in known})
        if isinstance(out.search, dict):
            names = {f.name for f in fields(prescribe.Search)}
            out.search = prescribe.Search(**{k: v for k, v in out.search.items() if k in names})
        wrong = []
        if not 0.1 <= out.test_share <= 0.5:
            wrong.append("test_share must be from 0.1 to 0.5")
        if out.folds and not 2 <= out.folds <= 10:
            wrong.append("folds must be from 2 to 10")
        for name, allowed in (("method", ("descent", "swarm")), ("rule", fcm.RULES), ("activation", fcm.ACTIVATIONS), ("division", ("grouped", "random"))):
            if getattr(out, name) not in allowed:
                wrong.append(f"{name} must be one of {', '.join(allowed)}")
        if not all(isinstance(e, (list, tuple)) and len(e) == 2 for e in out.excluded_edges or ()):
            wrong.append("excluded_edges must be pairs of source and target")
        if wrong:
            raise ValueError("; ".join(wrong))
        out.delta_most, out.excluded_edges = out.delta_most or None, tuple(tuple(map(str, e)) for e in out.excluded_edges or ())
        return out

    def quick(self) -> Options:
        """A cross-validation of three folds, three slopes and one alpha."""
        return replace(self, folds=3, slopes=(0.5, 1.0, 2.0), alphas=(1e-3,))


@dataclass
class Model:
    """What a run learns: encoders and map; plain values that go to JSON and back."""

    preprocessor: Preprocessor
    map: CognitiveMap
    options: dict

    def to_json(self) -> str:
        m = {**asdict(self.map), "weights": self.map.weights.tolist(), "bias": self.map.bias.tolist()}
        return json.dumps({"version": VERSION, "preprocessor": self.preprocessor.to_json(), "map": m, "options": self.options}, default=str)

    @classmethod
    def from_json(cls, data: str) -> Model:
        d = json.loads(data)
        if d.get("version") != VERSION:
            raise ValueError("a model of another version")
        m = {k: v for k, v in d["map"].items() if k in {f.name for f in fields(CognitiveMap)}}
        return cls(Preprocessor.from_json(d["preprocessor"]), CognitiveMap(**{**m, "weights": np.array(m["weights"]), "bias": np.array(m["bias"])}), d["options"])

    def save(self, spark: SparkSession, path: str) -> None:
        tables.save_text(spark, path, self.to_json())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return cls.from_json(tables.load_text(spark, path))

    @property
    def objective(self) -> str:
        return self.map.objective

    def states(self, df: DataFrame, keep: list[str], neutral: bool = False) -> DataFrame:
        """Concepts in [0, 1]; ``neutral``: moving ones start from their training means."""
        x = self.preprocessor.transform(df, keep)
        return x.withColumns({k: F.lit(v) for k, v in self.map.start.items()}) if neutral else x

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep``, ``activation``, ``level``, ``taken`` steps, whether they were enough (``converged``), and of each concept that moves the observed (``true_<id>``) and the final value (``end_<id>``), from the neutral start."""
        levels, m = self.preprocessor.schema.level_values, self.map
        own = self.preprocessor.transform(df, keep).withColumns({f"true_{k}": F.col(k) for k in m.dynamic})
        known = [*keep, *(f"true_{k}" for k in m.dynamic)]
        out = fcm.infer_frame(own.withColumns({k: F.lit(v) for k, v in m.start.items()}), m, known)
        ends = {k: F.get("state", F.lit(m.ids.index(k))) for k in m.dynamic}
        out = out.select(*known, ends[self.objective].alias("activation"), "taken", (F.col("taken") < m.steps).alias("converged"), *(v.alias(f"end_{k}") for k, v in ends.items()))
        return out.withColumn("level", numeric.nearest_level(F.col("activation"), levels))

    def simulate(self, df: DataFrame, key: str, actions: dict[str, float]) -> DataFrame:
        """(key, base, simulated) with actions set to values of [0, 1]; what isn't an action is an error."""
        concepts = {c.column: c for c in self.preprocessor.schema.concepts}
        wrong = [a for a in actions if a not in concepts or concepts[a].role != "accion"]
        if wrong:
            raise ValueError(f"not actions: {', '.join(wrong)}")
        x = self.states(df, [key])
        new = x.withColumns({concepts[a].id: F.lit(float(v)) for a, v in actions.items()})
        value = F.get("state", F.lit(self.map.ids.index(self.objective)))
        base = fcm.infer_frame(x, self.map, [key]).select(key, value.alias("base"))
        return base.join(fcm.infer_frame(new, self.map, [key]).select(key, value.alias("simulated")), key)

    def plan(self, options: Options) -> prescribe.Plan:
        """How actions may change; ``delta_most`` of 0 or less is no limit, a condition that is no concept is none."""
        concepts = self.preprocessor.schema.concepts
        ids = {c.column: c.id for c in concepts}
        most = options.delta_most if options.delta_most and options.delta_most > 0 else None
        weights = tuple((ids[c], w) for c, w in dict(options.importance).items() if c in ids)
        condition = ids.get(options.condition) if options.condition_delta is not None else None
        return prescribe.Plan(tuple(c.id for c in concepts if c.role == "accion"), options.beta, options.reductions, most, condition, options.condition_delta or 0.0, grids=self.preprocessor.action_grids(), weights=weights)

    def prescribe(self, df: DataFrame, key: str, level: str, options: Options) -> DataFrame:
        """Searched plans for rows of ``df`` below the best level (``level`` holds theirs)."""
        schema = self.preprocessor.schema
        levels, actions = schema.level_values, [c.id for c in schema.concepts if c.role == "accion"]
        plan = self.plan(options)
        below = df.where(F.col(level) != schema.best_level)
        goals = prescribe.step_goals(below, level, levels) if options.step_goals else below.withColumn("goal_level", F.lit(schema.best_level)).withColumn("goal", F.lit(levels[schema.best_level]))
        x = self.preprocessor.transform(goals, [key, level, "goal", "goal_level"])
        found = prescribe.genetic_prescriptions(x, self.map, plan, key, "goal", options.search, options.seed)
        news = {f"{a}_new": F.get("actions", F.lit(i)) for i, a in enumerate(actions)}
        return x.join(found.withColumns(news), key)

    def record_view(self, df: DataFrame, key: str, tested: DataFrame | None = None) -> DataFrame:
        """(key, observed, activation, level, taken, converged, tested, <action>_now...) of each row: its level, what the map infers from the neutral start, and its actions in their own units. ``tested`` has the keys of the test rows; without it the column is null."""
        p, ids = self.preprocessor, {c.column: c.id for c in self.preprocessor.schema.concepts}
        told = self.predict(df, [key]).withColumn("observed", numeric.nearest_level(F.col(f"true_{self.objective}"), p.schema.level_values))
        now = p.transform(df, [key]).select(key, *(p.original(ids[a.column], F.col(ids[a.column])).alias(f"{a.column}_now") for a in self.actions()))
        out = told.select(key, "observed", "activation", "level", "taken", "converged").join(now, key)
        if tested is None:
            return out.withColumn("tested", F.lit(None).cast("boolean"))
        marks = tested.select(F.col(key).alias("_key")).distinct()
        return out.join(marks, F.col(key) == F.col("_key"), "left").withColumn("tested", F.col("_key").isNotNull()).drop("_key")

    def info(self) -> dict:
        """What the model is: plain values, of a size that depends on its concepts only."""
        m, schema, i = self.map, self.preprocessor.schema, self.map.ids.index(self.objective)
        names = {c.id: c.name for c in schema.concepts}
        edges = [{"source": a, "target": b, "weight": float(m.weights[j, k])} for j, a in enumerate(m.ids) for k, b in enumerate(m.ids) if m.weights[j, k]]
        return {
            "objective": schema.objective.name, "levels": schema.level_values, "best_level": schema.best_level, "rule": m.rule, "activation": m.activation, "slope": m.slope,
            "concepts": [{"id": c.id, "column": c.column, "name": c.name, "role": c.role, "dynamic": c.dynamic} for c in schema.concepts],
            "edges": edges, "bias": float(m.bias[i]),
            "influences": sorted(({"id": a, "name": names[a], "weight": float(m.weights[j, i])} for j, a in enumerate(m.ids) if m.weights[j, i]), key=lambda x: -abs(x["weight"])),
            "actions": [asdict(a) for a in self.actions()],
        }

    def actions(self) -> list[report.Action]:
        """Names, ranges and categories of the actions, as reports show them."""
        p = self.preprocessor
        specs = [(c, p.schema.spec(c.column)) for c in p.schema.concepts if c.role == "accion"]
        return [report.Action(c.column, c.name, p.lows[c.id], p.highs[c.id], s.order if s.encoding == "ordinal" else ()) for c, s in specs]

    def prescribe_records(self, df: DataFrame, key: str, options: Options | None = None, goal_level: str | None = None, wishes: DataFrame | None = None, profiles: bool = False, subject: str | None = None) -> DataFrame:
        """A plan, in its own units, and a report for each row of ``df``, whatever its level.

        ``profiles``: rows are hypothetical and have no objective; moving concepts start
        from their means, incomplete ones are left out. The goal is ``goal_level``; else, with
        step goals and more than two levels, the level after the observed one (a
        profile's: the one that the map infers); else the best. ``wishes`` (key, column,
        value as text) are wanted values of single rows; one for the objective is its goal.
        """
        o = options or Options()
        p, m = self.preprocessor, self.map
        schema, levels, objective = p.schema, p.schema.level_values, self.objective
        if goal_level is not None and goal_level not in levels:
            raise ValueError(f"unknown level {goal_level}; there are {', '.join(levels)}")
        if not profiles:
            _check_orders(df, schema)
        if profiles:
            x = individual.profile_states(p, df, self.map.start, [key]).where("complete").drop("complete").withColumn("observed", F.lit(None).cast("string"))
        else:
            x = p.transform(df, [key])
            x = x.withColumn("observed", numeric.nearest_level(F.col(objective), levels))
        x, sought, goals = wishes_of.applied(x, p, wishes, key)
        x = tables.written(x, "states")
        best, level = schema.best_level, F.lit(goal_level)
        if goal_level is None and o.step_goals and len(levels) > 2:
            now = F.col("observed")
            if profiles:
                ends = fcm.infer_frame(x, m, [key]).select(key, F.get("state", F.lit(m.ids.index(objective))).alias("_inferred"))
                x = x.join(ends, key)
                now = numeric.nearest_level(F.col("_inferred"), levels)
            level = numeric.next_level(now, levels)
        value = numeric.level_value(F.coalesce(level, F.lit(best)), levels)
        value = F.coalesce(F.col(goals), value) if goals else value
        x = tables.written(x.withColumn("goal", value).withColumn("goal_level", numeric.nearest_level(F.col("goal"), levels)), "goals")
        plan = self.plan(o)
        found = prescribe.genetic_prescriptions(x, m, plan, key, "goal", o.search, o.seed, sought)
        actions = self.actions()
        ids = {c.column: c.id for c in schema.concepts}
        own = found.join(x.select(key, "observed", "goal", "goal_level", *plan.actions, *([plan.condition] if plan.condition and plan.condition not in plan.actions else [])), key)
        units = {f"{a.column}_now": p.original(ids[a.column], F.col(ids[a.column])) for a in actions} | {f"{a.column}_new": p.original(ids[a.column], F.get("actions", F.lit(i))) for i, a in enumerate(actions)}
        limited = F.lit(None).cast("string")
        if plan.condition:
            limited = F.when(prescribe.capped(plan), individual.restriction(next(c.name for c in schema.concepts if c.id == plan.condition), plan.condition_delta))
        own = own.withColumns(units).withColumns({"restriction": limited, "contributions": individual.contributions(m, schema.concepts, F.col("base_state"), F.col("state"))})
        own = tables.written(own, "plans")
        told = report.individual_reports(own, key, actions, schema.concepts[-1].name, levels, schema.tolerance, subject or ("este perfil" if profiles else "este registro"))
        return own.select(key, "observed", "goal", "goal_level", *units, "base", "activation", numeric.nearest_level(F.col("activation"), levels).alias("level"), "cost", "generations", "history", "mean_history", "action_history", "contributions").join(told, key)


def run(df: DataFrame, schema: Schema, key: str, options: Options | None = None, told: Callable[[str], None] = lambda stage: None) -> tuple[Model, dict, DataFrame]:
    """(model, metrics, plans). ``df`` has a unique ``key``; ``told`` hears each stage.

    The table is written as it comes, since the encoders' passes would make it anew each
    time, and once with its levels and split, since every later stage reads it.
    """
    o = options or Options()
    schema = schema.binarized(o.binarize) if o.binarize is not None else schema
    schema = schema.all_dynamic() if o.all_dynamic else schema
    levels = schema.level_values
    told("split")
    df = tables.written(df, "input")
    _check_orders(df, schema)
    probe = Preprocessor.fit(df, schema)
    value = probe.encoded(df)[schema.concepts[-1].id]
    own = df.withColumn("_level", numeric.nearest_level(value, levels))
    fixed = list(dict.fromkeys(c.column for c in schema.concepts if c.role == "inmutable"))
    grouped = split.group_id(own, fixed, key)
    profiles = grouped.select("group").distinct().limit(o.least_profiles).count()
    if fixed and profiles >= o.least_profiles and o.division == "grouped":
        parts = split.grouped_folds(grouped, "group", "_level", 20, o.seed)
        own = parts.withColumn("_test", F.col("fold") < round(o.test_share * 20)).drop("fold", "group")
    else:
        own = split.stratified_split(own, "_level", key, o.test_share, o.seed).withColumnRenamed("test", "_test")
    own = tables.written(own, "run")
    train, test = own.where("not _test"), own.where("_test")
    if o.balance_levels is None:
        o = replace(o, balance_levels=individual.minority(train, "_level").first().balance)

    told("encode")
    p = Preprocessor.fit(train, schema)
    concepts = schema.concepts
    ids, moving, objective = [c.id for c in concepts], [c.id for c in concepts if c.dynamic], concepts[-1].id
    allowed = np.zeros((len(ids), len(ids)), dtype=bool)
    edges = fcm.allowed_edges(fcm.concept_table(df.sparkSession, concepts, objective))
    if o.excluded_edges:
        edges = fcm.masked_edges(edges, df.sparkSession.createDataFrame(list(o.excluded_edges), "source string, target string"))
    for r in edges.collect():
        allowed[ids.index(r.source), ids.index(r.target)] = True
    shape = CognitiveMap(ids, moving, objective, np.zeros(allowed.shape), np.zeros(len(ids)), o.rule, o.activation, o.slope, o.memory, o.influence)
    x = tables.written(learn.training_rows(p.transform(train, [key, "_level"]), ids, "_level", key, bool(o.balance_levels), o.smote), "states")
    weight = "weight" if o.balance_levels else None

    metrics: dict = {}
    if o.folds:
        told("select")
        # Folds by profile: rows that share all fixed columns are never on both sides.
        folded = split.grouped_folds(split.group_id(train, fixed, key), "group", "_level", o.folds, o.seed).drop("group").withColumnRenamed("fold", "part")
        parts = learn.fold_parts(folded, schema, "part", [key, "_level"], "_level", key, bool(o.balance_levels), o.smote)
        table = learn.cross_validation(parts, shape, allowed, "_level", levels, o.slopes, o.alphas, o.fold_steps, weight, bool(o.balance_levels)).collect()  # a row for each combination
        best = table[0]
        o = replace(o, slope=best.slope, alpha=best.alpha)
        shape = replace(shape, slope=best.slope)
        metrics["selection"] = [r.asDict() for r in table]

    told("learn")
    trained, loss = learn.train(x, shape, allowed, o.alpha, weight, o.method, o.most_steps, o.seed)
    model = Model(p, trained, asdict(o))

    told("evaluate")
    predicted = tables.written(model.predict(test, [key, "_level"]), "predicted")
    metrics |= {"config": asdict(o), "loss": loss, "train_rows": train.count(), "test_rows": predicted.count(), **evaluate.prediction_metrics(predicted, "_level", "level", list(levels), moving)}

    told("prescribe")
    plans = tables.written(model.prescribe(test, key, "_level", o), "plans")
    metrics |= evaluate.plan_metrics(plans, [c.id for c in concepts if c.role == "accion"], levels, schema.tolerance, o.step_goals)
    if o.segment:
        column, wanted = o.segment
        marked = plans.join(test.select(key, F.col(column).alias("_segment")), key)
        reached = {f"_{n}": evaluate.reached(c, levels) for n, c in (("before", "base"), ("after", "activation"))}
        metrics["segments"] = [r.asDict() for r in evaluate.success_by_segment(marked.withColumns(reached).withColumnRenamed("_segment", column), column, wanted, "_before", "_after").collect()]
    if o.forest:
        told("forest")
        inputs = [k for k in ids if k != objective]
        news = plans.withColumns({f"{k}_new": F.col(k) for k in inputs if f"{k}_new" not in plans.columns})
        metrics["forest"] = evaluate.forest_validation(p.transform(train, ["_level"]), news, inputs, "_level", levels, o.forest_trees, o.seed).first().asDict()
    return model, metrics, plans


def _check_orders(df: DataFrame, schema: Schema) -> None:
    """Ordered columns with categories that their orders haven't are an error, as they would be no numbers."""
    wrong = []
    for c in schema.columns:
        if c.role != "excluir" and c.encoding == "ordinal":
            found = [r.category for r in unknown_categories(df, c).orderBy("category").limit(8).collect()]
            wrong += [f"{c.name}: {', '.join(found)}"] * bool(found)
    if wrong:
        raise ValueError("categories that are in no order: " + "; ".join(wrong))


def recommendations(model: Model, plans: DataFrame, key: str) -> DataFrame:
    """The plans in the columns' own units, by the columns' names."""
    p = model.preprocessor
    actions = [c for c in p.schema.concepts if c.role == "accion"]
    units = {c.column: (p.lows[c.id], p.highs[c.id]) for c in actions}
    named = plans.withColumns({c.column: F.col(c.id) for c in actions} | {f"{c.column}_new": F.col(f"{c.id}_new") for c in actions})
    return report.recommendations(named, key, [c.column for c in actions], units, p.schema.level_values, "base", "activation", "goal_level")
