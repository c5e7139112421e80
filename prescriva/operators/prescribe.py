"""Prescriptions: bounds, costs, the exhaustive grid and the genetic search for each record."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from prescriva.functions import numeric
from prescriva.operators import quantiles
from prescriva.operators.fcm import CognitiveMap, infer_column, iterate


@dataclass(frozen=True)
class Plan:
    """How actions may change and what a change costs."""

    actions: tuple[str, ...]
    beta: float = 0.4
    reductions: bool = False
    delta_most: float | None = None
    condition: str | None = None
    condition_delta: float = 0.15
    grids: tuple[tuple[str, tuple[float, ...]], ...] = ()
    #: Importance of the objective and of other wanted concepts in the cost; 1 where none is given.
    weights: tuple[tuple[str, float], ...] = ()

    def grid(self, action: str) -> tuple[float, ...] | None:
        return dict(self.grids).get(action)


def capped(plan: Plan) -> Column:
    return F.col(plan.condition) >= 0.5 if plan.condition else F.lit(False)


def bounds(plan: Plan, action: str) -> tuple[Column, Column]:
    """(low, high) of an action: increments only unless reductions are allowed; both sides by ``delta_most``; the upper one lower under the condition; a discrete action may always move one category."""
    now, values = F.col(action), plan.grid(action)
    low, high = (F.lit(0.0) if plan.reductions else now), F.lit(1.0)
    if plan.delta_most:
        low, high = F.greatest(low, now - plan.delta_most), F.least(high, now + plan.delta_most)
    high = F.when(capped(plan), F.least(high, now + plan.condition_delta)).otherwise(high)
    if values:
        steps = F.array(*map(F.lit, sorted(values)))
        above = F.array_min(F.filter(steps, lambda v: v > now + 1e-9))
        below = F.array_max(F.filter(steps, lambda v: v < now - 1e-9))
        high = F.greatest(high, F.coalesce(above, high))
        low = F.least(low, F.coalesce(below, low)) if plan.reductions else low
    return F.least(low, F.lit(1.0)), F.greatest(F.least(high, F.lit(1.0)), F.lit(0.0))


def discretized(value: Column, plan: Plan, action: str) -> Column:
    """The nearest admissible value of a discrete action; others as they are."""
    values = plan.grid(action)
    if not values:
        return value
    low, high = bounds(plan, action)
    options = F.filter(F.array(*map(F.lit, sorted(values))), lambda v: (v >= low - 1e-9) & (v <= high + 1e-9))
    near = F.array_min(F.transform(options, lambda v: F.struct(F.abs(v - value).alias("d"), v.alias("v"))))["v"]
    return F.coalesce(near, F.col(action))


def shortfall(activation: Column, goal: Column | float) -> Column:
    return F.greatest(goal - activation, F.lit(0.0))


def effort(plan: Plan, changed: dict[str, Column]) -> Column:
    return sum((F.abs(changed[a] - F.col(a)) for a in plan.actions), F.lit(0.0)) / float(len(plan.actions))


def cost(m: CognitiveMap, plan: Plan, changed: dict[str, Column], goal: Column | float, start: Column, steps: int | None = None) -> Column:
    """Shortfall of the map's objective plus beta times the mean change."""
    return shortfall(infer_column(m, start, steps, changed), goal) + plan.beta * effort(plan, changed)


def _between(low: Column, high: Column, points: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + (high - low) * i / float(points - 1))


def grid_prescriptions(x: DataFrame, m: CognitiveMap, plan: Plan, key: str, goal: Column | float, points: int = 21, steps: int | None = None) -> DataFrame:
    """(key, one column for each action, cost, activation): the cheapest point of a grid between each action's bounds.

    The grid is generated inside each row, so nothing is joined; equal costs go to the first point.
    """
    own = x
    for a in plan.actions:
        low, high = bounds(plan, a)
        own = own.withColumn(f"_options_{a}", F.array_distinct(_between(low, high, points)))
    for a in plan.actions:
        own = own.select("*", F.posexplode(f"_options_{a}").alias(f"_at_{a}", f"_new_{a}")).drop(f"_options_{a}")
    # Named step by step, so that each is worked out once for a point.
    own = own.select("*", *(discretized(F.col(f"_new_{a}"), plan, a).alias(f"_set_{a}") for a in plan.actions))
    changed = {a: F.col(f"_set_{a}") for a in plan.actions}
    own = own.withColumn("activation", infer_column(m, F.col(m.objective), steps, changed))
    own = own.withColumn("cost", shortfall(F.col("activation"), goal) + plan.beta * effort(plan, changed))
    priced = own.select(key, *(c.alias(a) for a, c in changed.items()), *(f"_at_{a}" for a in plan.actions), "activation", "cost")
    order = F.struct(F.round("cost", 12).alias("c"), *(F.col(f"_at_{a}") for a in plan.actions))
    best = priced.groupBy(key).agg(F.min_by(F.struct(*plan.actions, "cost", "activation"), order).alias("b"))
    return best.select(key, "b.*")


#: Records that are searched as one array: few generations of most, many of some, so that late ones still have rows to fill a call.
SIDE_BY_SIDE = 1024


@dataclass(frozen=True)
class Search:
    """Options of the genetic search."""

    population: int = 50
    generations: int = 100
    tournament: int = 3
    crossover: float = 0.9
    mutation: float = 0.25
    spread: float = 0.15
    elite: int = 2
    patience: int = 25
    one_point: bool = False

    def __post_init__(self):
        shares = {"crossover": self.crossover, "mutation": self.mutation}
        wrong = [k for k, v in shares.items() if not 0 <= v <= 1]
        wrong += [k for k in ("population", "tournament", "patience") if getattr(self, k) < 1] + [k for k in ("generations", "elite", "spread") if getattr(self, k) < 0]
        if wrong or self.elite >= self.population:
            raise ValueError(f"out of range: {', '.join(wrong) or 'elite'}")


def _uniform(seeds: np.ndarray, stream: int, *shape: int) -> np.ndarray:
    """Draws of [0, 1) for each seed: a hash of the seed, the stream and the place, so that they depend on nothing else."""
    place = np.arange(int(np.prod(shape)), dtype=np.uint64) + np.uint64(stream << 32)
    z = (seeds[:, None] ^ (place * np.uint64(0x9E3779B97F4A7C15))[None]) + np.uint64(0x632BE59BD9B4E019)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(odd)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float).reshape(len(seeds), *shape) * 2.0**-53


def _bred(genes: np.ndarray, low: np.ndarray, high: np.ndarray, seeds: np.ndarray, stream: int, s: Search) -> np.ndarray:
    """Children (records, population - elite, genes) of populations that are sorted by cost.

    The best of ``tournament`` draws with replacement has the least of as many uniform
    ranks, so one draw of that least rank picks a parent.
    """
    r, p, k = genes.shape
    pairs = -(-(p - s.elite) // 2)
    rank = (p * -np.expm1(np.log1p(-_uniform(seeds, stream, 2 * pairs)) / s.tournament)).astype(np.int64)
    left, right = np.split(np.take_along_axis(genes, np.minimum(rank, p - 1)[:, :, None], axis=1), 2, axis=1)
    if s.one_point:
        cut = 1 + np.floor(_uniform(seeds, stream + 1, pairs, 1) * max(k - 1, 1))
        other = np.arange(k) >= cut
    else:
        other = _uniform(seeds, stream + 1, pairs, k) < 0.5
    other = other & (_uniform(seeds, stream + 2, pairs, 1) < s.crossover)
    children = np.concatenate([np.where(other, right, left), np.where(other, left, right)], axis=1)[:, : p - s.elite]
    hit = _uniform(seeds, stream + 3, *children.shape[1:]) < s.mutation
    radius = np.sqrt(-2 * np.log1p(-_uniform(seeds, stream + 4, *children.shape[1:])[hit]))
    normal = np.zeros(children.shape)
    normal[hit] = radius * np.cos(2 * np.pi * _uniform(seeds, stream + 5, *children.shape[1:])[hit])
    moved = children + normal * s.spread * (high - low)[:, None]
    return np.clip(moved, low[:, None], high[:, None])


def evolve(price, low: np.ndarray, high: np.ndarray, now: np.ndarray, seeds: np.ndarray, s: Search, tops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All records of a batch at once: (best genes, least cost and mean cost of each generation, generations made) of each; ``tops`` (records, generations + 1, genes), where given, gets the best genes of each generation.

    ``low``, ``high``, ``now``: (records, genes); ``price(genes, records)`` gives costs of
    (records, individuals, genes). What a record does now is one of its first
    individuals. A record leaves when it hasn't improved for ``patience`` generations;
    its costs stay nan from there on.
    """
    records, k = low.shape
    best = np.clip(now, low, high)
    least, mean = (np.full((records, s.generations + 1), np.nan) for _ in range(2))
    made = np.zeros(records, dtype=np.int32)
    live, top, idle = np.arange(records), np.full(records, np.inf), np.zeros(records, dtype=np.int64)
    genes = low[:, None] + (high - low)[:, None] * _uniform(seeds, 0, s.population, k)
    genes[:, 0] = best
    costs = price(genes, live)
    for g in range(s.generations + 1):
        if g:
            children = _bred(genes, low[live], high[live], seeds[live], 8 * g, s)
            genes, costs = np.concatenate([genes[:, : s.elite], children], axis=1), np.concatenate([costs[:, : s.elite], price(children, live)], axis=1)
        order = np.argsort(costs, axis=1, kind="stable")
        genes, costs = np.take_along_axis(genes, order[:, :, None], axis=1), np.take_along_axis(costs, order, axis=1)
        least[live, g], mean[live, g], made[live] = costs[:, 0], costs.mean(axis=1), g
        if tops is not None:
            tops[live, g] = genes[:, 0]
        better = costs[:, 0] < top[live] - 1e-9
        idle[live] = np.where(better | (g == 0), 0, idle[live] + 1)
        top[live] = np.minimum(top[live], costs[:, 0])
        best[live] = genes[:, 0]
        stays = idle[live] < s.patience
        live, genes, costs = live[stays], genes[stays], costs[stays]
        if not len(live):
            break
    return best, least, mean, made


def _snapped(genes: np.ndarray, low: np.ndarray, high: np.ndarray, plan: Plan) -> np.ndarray:
    """Genes (records, individuals, actions) with discrete actions at their nearest value between the record's bounds."""
    out = genes.copy()
    for i, a in enumerate(plan.actions):
        values = np.array(sorted(plan.grid(a) or ()))
        if len(values):
            open_ = (values >= low[:, i, None] - 1e-9) & (values <= high[:, i, None] + 1e-9)
            far = np.where(open_[:, None], np.abs(genes[:, :, i, None] - values), np.inf)
            out[:, :, i] = np.where(open_.any(axis=1)[:, None], values[far.argmin(axis=2)], genes[:, :, i])
    return out


def missed(m: CognitiveMap, plan: Plan, ends: np.ndarray, goal: np.ndarray, wants: np.ndarray, named: list[str]) -> np.ndarray:
    """How far final states (records, individuals, concepts) are from what is wanted, as a weighted mean.

    Of the objective only what it lacks of ``goal`` counts; another concept of ``named``
    counts with its distance from ``wants`` (records, named), unless that is nan.
    """
    weight = dict(plan.weights)
    parts = [np.maximum(goal[:, None] - ends[:, :, m.ids.index(m.objective)], 0)]
    shares = [np.full(len(goal), weight.get(m.objective, 1.0))]
    for i, c in enumerate(named):
        asked = ~np.isnan(wants[:, i])
        parts.append(np.where(asked[:, None], np.abs(ends[:, :, m.ids.index(c)] - wants[:, None, i]), 0.0))
        shares.append(np.where(asked, weight.get(c, 1.0), 0.0))
    return sum(p * w[:, None] for p, w in zip(parts, shares, strict=True)) / sum(shares)[:, None]


def _costs(m: CognitiveMap, plan: Plan, states: np.ndarray, genes: np.ndarray, goal: np.ndarray, wants: np.ndarray, named: list[str], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(costs, final states) of actions (records, individuals, actions) in the records' states."""
    at = [m.ids.index(a) for a in plan.actions]
    whole = np.repeat(states[:, None], genes.shape[1], axis=1)
    whole[:, :, at] = genes
    ends = iterate(m, whole.reshape(-1, len(m.ids)), steps)[0].reshape(whole.shape)
    return missed(m, plan, ends, goal, wants, named) + plan.beta * np.abs(genes - states[:, None, at]).mean(axis=2), ends


def _checked_wishes(m: CognitiveMap, wanted: dict[str, str] | None) -> list[str]:
    named = list(wanted or {})
    wrong = [c for c in named if c not in m.dynamic or c == m.objective]
    if wrong:
        raise ValueError(f"only concepts that move can be sought, and the objective has its goal: {', '.join(wrong)}")
    return named


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns side by side as doubles; nulls are nan."""
    if not columns:
        return np.empty((batch.num_rows, 0))
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])


def priced(x: DataFrame, m: CognitiveMap, plan: Plan, key: str, goal: str, news: dict[str, str], wanted: dict[str, str] | None = None, steps: int | None = None) -> DataFrame:
    """(key, cost, activation): what given actions (concept -> column of ``x``) cost each row; ``wanted``: a moving concept -> the column of its wanted value, null for rows that don't mind."""
    named = _checked_wishes(m, wanted)
    own = x.select(key, F.col(goal).cast("double").alias("_goal"), *m.ids, *(F.col(news[a]).cast("double").alias(f"_new_{a}") for a in plan.actions), *(F.col(wanted[c]).cast("double").alias(f"_want_{c}") for c in named))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states, genes, wants = _matrix(batch, m.ids), _matrix(batch, [f"_new_{a}" for a in plan.actions]), _matrix(batch, [f"_want_{c}" for c in named])
            costs, ends = _costs(m, plan, states, genes[:, None], _matrix(batch, ["_goal"])[:, 0], wants, named, steps)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(costs[:, 0]), pa.array(ends[:, 0, m.ids.index(m.objective)])], names=[key, "cost", "activation"])

    return own.mapInArrow(run, StructType([x.schema[key], StructField("cost", DoubleType()), StructField("activation", DoubleType())]))


def _lists(values: np.ndarray | pa.Array, sizes: np.ndarray | None = None) -> pa.ListArray:
    """The rows of a matrix, or runs of ``sizes`` values, as lists."""
    if sizes is None:
        sizes, values = np.full(len(values), values.shape[1]), values.ravel()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, pa.float64()))


def genetic_prescriptions(x: DataFrame, m: CognitiveMap, plan: Plan, key: str, goal: str, search: Search = Search(), seed: int = 42, wanted: dict[str, str] | None = None) -> DataFrame:
    """(key, actions, cost, base, activation, generations, history, mean_history, action_history, base_state, state) of each row of ``x`` (concepts and the column ``goal``).

    Records are independent and stay in their partitions; a record's draws depend on the
    seed and its key, so that partitions don't matter. A batch's records are searched
    side by side, as arrays of records x individuals x actions. ``wanted``: moving
    concepts that are sought as well, each with the column of its wanted value, which may
    differ from record to record and be null.
    """
    named = _checked_wishes(m, wanted)
    limits = {a: bounds(plan, a) for a in plan.actions}
    ready = x.select(key, F.col(goal).cast("double").alias("_goal"), *m.ids, *(c.alias(f"_{side}_{a}") for a, pair in limits.items() for side, c in zip(("low", "high"), pair, strict=True)), *(F.col(wanted[c]).cast("double").alias(f"_want_{c}") for c in named), F.xxhash64(F.col(key), F.lit(seed)).alias("_seed"))
    numbers = ArrayType(DoubleType())
    fields = [x.schema[key], StructField("actions", numbers), *(StructField(n, DoubleType()) for n in ("cost", "base", "activation")), StructField("generations", IntegerType()), StructField("history", numbers), StructField("mean_history", numbers), StructField("action_history", ArrayType(numbers)), StructField("base_state", numbers), StructField("state", numbers)]
    at, objective = [m.ids.index(a) for a in plan.actions], m.ids.index(m.objective)

    def found(batch: pa.RecordBatch) -> list[pa.Array]:
        states, wants, wanted_goal = _matrix(batch, m.ids), _matrix(batch, [f"_want_{c}" for c in named]), _matrix(batch, ["_goal"])[:, 0]
        low, high = (_matrix(batch, [f"_{side}_{a}" for a in plan.actions]) for side in ("low", "high"))
        seeds = batch.column("_seed").to_numpy().astype(np.int64).view(np.uint64)
        snapped = lambda genes, own: _snapped(genes, low[own], high[own], plan)
        price = lambda genes, own: _costs(m, plan, states[own], snapped(genes, own), wanted_goal[own], wants[own], named)[0]
        tops = np.full((len(states), search.generations + 1, len(at)), np.nan)
        best, least, mean, made = evolve(price, low, high, states[:, at], seeds, search, tops)
        every = np.arange(len(best))
        best, tops = snapped(best[:, None], every)[:, 0], snapped(tops, every)
        changed = states.copy()
        changed[:, at] = best
        base, end = (iterate(m, v)[0] for v in (states, changed))
        upto, sizes = np.arange(search.generations + 1) <= made[:, None], made + 1
        return [batch.column(key), _lists(best), pa.array(least[every, made]), pa.array(base[:, objective]), pa.array(end[:, objective]), pa.array(made), _lists(least[upto], sizes), _lists(mean[upto], sizes), _lists(_lists(tops[upto]), sizes), _lists(base), _lists(end)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SIDE_BY_SIDE):
                yield pa.RecordBatch.from_arrays(found(batch.slice(start, SIDE_BY_SIDE)), names=[f.name for f in fields])

    # The search is what costs, so records are spread over all cores first.
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ready.repartition(parts, key).mapInArrow(run, StructType(fields))


def step_goals(df: DataFrame, level: str, levels: dict[str, float]) -> DataFrame:
    """Rows below the best level, with their next level ``goal_level`` and its value ``goal``."""
    best = max(levels, key=levels.get)
    out = df.where(F.col(level) != best).withColumn("goal_level", numeric.next_level(F.col(level), levels))
    return out.withColumn("goal", numeric.level_value(F.col("goal_level"), levels))


def _padded(results: DataFrame, columns: list[str]) -> DataFrame:
    """Each record and generation of the longest search: a column's value there, or its last one."""
    longest = results.agg(F.max(F.size(columns[0])).alias("n"))
    own = results.crossJoin(F.broadcast(longest)).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("generation"))  # one row
    return own.withColumns({f"{c}_at": F.coalesce(F.get(c, F.col("generation")), F.element_at(c, -1)) for c in columns})


def convergence(results: DataFrame) -> DataFrame:
    """(generation, q1, median, q3) of ``history``, the best costs; records that ended earlier keep their last. ``results`` is read several times."""
    found = quantiles.by_place(results, "history", (0.25, 0.5, 0.75))
    return results.sparkSession.createDataFrame([(g, *values) for g, values in found], "generation int, q1 double, median double, q3 double")


def progress(results: DataFrame) -> DataFrame:
    """(generation, q1, median, q3, mean, best_progress, mean_progress) of ``history`` and ``mean_history``.

    ``mean``: the median of the populations' mean costs. Progress is 0 at the mean cost
    of a record's first population and 1 at its least cost; its medians are over records
    whose range exceeds 1e-9, and 0 where there are none. ``results`` is read several times.
    """
    own = _padded(results.where(F.size("history") > 0), ["history", "mean_history"])
    start, end = F.get("mean_history", F.lit(0)), F.element_at("history", -1)
    moved = lambda c: F.when(start - end > 1e-9, (start - F.col(c)) / (start - end))
    own = own.select("generation", F.col("history_at").alias("best"), F.col("mean_history_at").alias("mean"), moved("history_at").alias("best_progress"), moved("mean_history_at").alias("mean_progress"))
    found = quantiles.quantiles(own, ["best", "mean", "best_progress", "mean_progress"], (0.25, 0.5, 0.75), "generation")
    generations = sorted({int(g) for g, _ in found})
    at = lambda g, c, i: found.get((str(g), c), (0.0,) * 3)[i]
    rows = [(g, *(at(g, "best", i) for i in range(3)), *(at(g, c, 1) for c in ("mean", "best_progress", "mean_progress"))) for g in generations]
    return results.sparkSession.createDataFrame(rows, "generation int, q1 double, median double, q3 double, mean double, best_progress double, mean_progress double")
