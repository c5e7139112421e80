"""Fuzzy cognitive maps: structure, inference to a fixed point, and what it is made of.

The rule, for each dynamic concept at once: with u = a A + c,
A' = sigmoid(slope_e * (memory * u + influence * (sum of w u + bias))), all other concepts
held. A map with one dynamic concept is a scalar recurrence and becomes one unrolled
column expression inside generated code; with several, batches of rows are iterated as
matrices, each row until it no longer moves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from prescriva.functions import numeric
from prescriva.operators.schema import Concept

# The inference rules and activations.
RULES = ("kosko", "kosko_modificada", "reescalada")
ACTIVATIONS = ("sigmoide", "tanh")


def rule_parameters(rule: str = "kosko_modificada", activation: str = "sigmoide", slope: float = 1.0, memory: float = 1.0) -> tuple[float, float, float, float]:
    """(memory, a, c, effective slope)."""
    if rule not in RULES or activation not in ACTIVATIONS:
        raise ValueError("unknown rule or activation")
    centred = rule == "reescalada" or activation == "tanh"
    return (0.0 if rule == "kosko" else memory), (2.0 if centred else 1.0), (-1.0 if centred else 0.0), slope * (2.0 if activation == "tanh" else 1.0)


@dataclass
class CognitiveMap:
    """``weights[j][i]``: from concept j to concept i."""

    ids: list[str]
    dynamic: list[str]
    objective: str
    weights: np.ndarray
    bias: np.ndarray
    rule: str = "kosko_modificada"
    activation: str = "sigmoide"
    slope: float = 1.0
    memory: float = 1.0
    influence: float = 1.0
    steps: int = 100
    tolerance: float = 1e-5
    start: dict[str, float] = field(default_factory=dict)

    @property
    def moving(self) -> np.ndarray:
        return np.array([self.ids.index(k) for k in self.dynamic])

    @property
    def parameters(self) -> tuple[float, float, float, float]:
        return rule_parameters(self.rule, self.activation, self.slope, self.memory)

    def edges(self, spark: SparkSession) -> DataFrame:
        """(source, target, weight) of edges that aren't 0, and the biases from ``sesgo``."""
        rows = [(a, b, float(self.weights[i, j])) for i, a in enumerate(self.ids) for j, b in enumerate(self.ids) if self.weights[i, j] != 0]
        rows += [("sesgo", b, float(self.bias[j])) for j, b in enumerate(self.ids) if self.bias[j] != 0]
        return spark.createDataFrame(rows, "source string, target string, weight double")


def concept_table(spark: SparkSession, concepts: list[Concept], objective: str) -> DataFrame:
    return spark.createDataFrame([(c.id, c.name, c.role, c.dynamic, c.id == objective) for c in concepts], "id string, name string, role string, dynamic boolean, objective boolean")


def allowed_edges(concepts: DataFrame) -> DataFrame:
    """(source, target): fixed and dynamic concepts to dynamic ones; none from the objective, to itself or to a fixed one.

    A map has at most some hundred concepts, so both sides are small.
    """
    a = concepts.where("not objective").select(F.col("id").alias("source"))
    b = concepts.where("dynamic").select(F.col("id").alias("target"))
    return a.join(F.broadcast(b), F.col("source") != F.col("target"))


def masked_edges(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """Edges without the (source, target) pairs that an expert has ruled out."""
    return edges.join(F.broadcast(excluded), ["source", "target"], "left_anti")


def influences(edges: DataFrame) -> DataFrame:
    """``edges`` without biases, the strongest first; of equally strong ones by source."""
    return edges.where("source <> 'sesgo'").orderBy(F.desc(F.abs("weight")), "source")


def entered(c: Column, m: CognitiveMap) -> Column:
    _, a, b, _ = m.parameters
    return c * F.lit(a) + F.lit(b) if (a, b) != (1.0, 0.0) else c


def drive(m: CognitiveMap, target: str, columns: dict[str, Column] | None = None) -> Column:
    """influence * (sum of w u + bias) of the concepts that don't move: constant over the steps."""
    own, i = columns or {}, m.ids.index(target)
    out = F.lit(float(m.bias[i]))
    for j, k in enumerate(m.ids):
        if m.weights[j, i] != 0 and k not in m.dynamic:
            out = out + F.lit(float(m.weights[j, i])) * entered(own.get(k, F.col(k)), m)
    return out * F.lit(m.influence)


def infer_column(m: CognitiveMap, start: Column | float = 0.5, steps: int | None = None, columns: dict[str, Column] | None = None) -> Column:
    """The objective after ``steps`` steps of a map in which it alone moves; ``columns`` replaces concepts' columns."""
    if m.dynamic != [m.objective]:
        raise ValueError("several concepts move; use infer_frame")
    memory, _, _, slope = m.parameters
    pull = drive(m, m.objective, columns)
    a = start if isinstance(start, Column) else F.lit(float(start))
    for _ in range(steps or m.steps):
        a = numeric.sigmoid(F.lit(memory) * entered(a, m) + pull if memory else pull, slope)
    return a


def iterate(m: CognitiveMap, x: np.ndarray, steps: int | None = None, trace: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(final states, steps of each row, states of each step). Rows stop one by one, so that no row depends on its batch."""
    memory, a, c, slope = m.parameters
    moving, x = m.moving, x.astype(float).copy()
    still = np.setdiff1d(np.arange(len(m.ids)), moving)
    # einsum adds in one order whatever the number of rows, which a matrix product doesn't promise.
    times = lambda rows, w: np.einsum("ij,jk->ik", rows, w)
    pull = m.influence * (times(a * x[:, still] + c, m.weights[np.ix_(still, moving)]) + m.bias[moving])
    inner = m.influence * m.weights[np.ix_(moving, moving)]
    # Rows that still move, side by side: their states and pulls shrink as rows stop.
    rows, now, own = np.arange(len(x)), x[:, moving], pull
    taken, states = np.zeros(len(x), dtype=np.int32), [x.copy()] if trace else []
    # The same sums in the same order, without what multiplies by one or adds zero.
    plain, alone = (a, c) == (1, 0), not inner.any()
    for _ in range(steps or m.steps):
        u = now if plain else a * now + c
        new = memory * u
        new += own
        if not alone:
            new += u * inner if len(moving) == 1 else times(u, inner)
        new *= -slope
        np.exp(new, out=new)
        new += 1
        np.divide(1, new, out=new)
        if trace:
            x[np.ix_(rows, moving)] = new
            states.append(x.copy())
        taken[rows] += 1
        if steps is None:
            moved = np.abs(new - now)
            stays = ~((moved[:, 0] if len(moving) == 1 else moved.max(axis=1)) < m.tolerance)
            if not stays.all():
                left = ~stays
                x[np.ix_(rows[left], moving)] = new[left]
                rows, new, own = rows[stays], new[stays], own[stays]
        now = new
        if not len(rows):
            break
    x[np.ix_(rows, moving)] = now
    return x, taken, states


def infer_frame(x: DataFrame, m: CognitiveMap, keep: list[str], steps: int | None = None, trace: bool = False) -> DataFrame:
    """``keep`` columns, final ``state`` (by concept), ``taken`` steps and, where asked for, the ``path`` of states."""
    fields = [x.schema[k] for k in keep] + [StructField("state", ArrayType(DoubleType())), StructField("taken", IntegerType())]
    if trace:
        fields.append(StructField("path", ArrayType(ArrayType(DoubleType()))))
    width = 500 if trace else 1 << 20

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole paths are kept for a few rows at a time.
        for batch in (b.slice(at, width) for b in batches for at in range(0, b.num_rows, width)):
            own = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in m.ids])
            final, taken, states = iterate(m, own, steps, trace)
            arrays = [batch.column(k) for k in keep] + [pa.array(final.tolist(), pa.list_(pa.float64())), pa.array(taken)]
            if trace:
                arrays.append(pa.array(np.stack(states, axis=1).tolist(), pa.list_(pa.list_(pa.float64()))))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return x.select(*keep, *[k for k in m.ids if k not in keep]).mapInArrow(run, StructType(fields))


def trajectory(x: DataFrame, m: CognitiveMap, key: str, steps: int) -> DataFrame:
    """(key, t, concept, activation) of the concepts that move."""
    traced = infer_frame(x, m, [key], steps, trace=True)
    long = traced.select(key, F.posexplode("path").alias("t", "state"))
    pairs = F.array(*(F.struct(F.lit(k).alias("concept"), F.get("state", F.lit(m.ids.index(k))).alias("activation")) for k in m.dynamic))
    return long.select(key, "t", F.explode(pairs).alias("p")).select(key, "t", "p.concept", "p.activation")


def terms(x: DataFrame, m: CognitiveMap, key: str, sources: list[str] | None = None) -> DataFrame:
    """(key, memory, influence, part, bias): the parts of the objective's next input, ``part`` of the given sources only."""
    memory = m.parameters[0]
    i = m.ids.index(m.objective)
    weighted = {k: F.lit(m.influence * float(m.weights[j, i])) * entered(F.col(k), m) for j, k in enumerate(m.ids) if m.weights[j, i] != 0}
    total = lambda ks: sum((weighted[k] for k in ks if k in weighted), F.lit(0.0))
    return x.select(key, (F.lit(memory) * entered(F.col(m.objective), m)).alias("memory"), total(m.ids).alias("influence"), total(sources or m.ids).alias("part"), F.lit(m.influence * float(m.bias[i])).alias("bias"))


def contributions(x: DataFrame, m: CognitiveMap, key: str) -> DataFrame:
    """(key, concept, contribution) of each concept with an edge into the objective."""
    i = m.ids.index(m.objective)
    pairs = F.array(*(F.struct(F.lit(k).alias("concept"), (F.lit(m.influence * float(m.weights[j, i])) * entered(F.col(k), m)).alias("contribution")) for j, k in enumerate(m.ids) if m.weights[j, i] != 0))
    return x.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def account(x: DataFrame, m: CognitiveMap, key: str, steps: int | None = None, actions: list[str] | None = None) -> DataFrame:
    """(key, t, memory, influence, part, bias, input, activation) of the objective, for each step that a row takes: what its value is made of.

    ``memory`` is its own last value's, ``influence`` the weighted sum over all concepts
    (``part``: over ``actions`` alone), ``input`` memory, influence and bias together,
    whose sigmoid is ``activation``. A row's steps are one array that is worked out in its path.
    """
    memory = m.parameters[0]
    i = m.ids.index(m.objective)

    def total(state: Column, names: list[str]) -> Column:
        used = [(j, m.influence * float(m.weights[j, i])) for j, k in enumerate(m.ids) if k in names and m.weights[j, i] != 0]
        return sum((F.lit(w) * entered(F.get(state, F.lit(j)), m) for j, w in used), F.lit(0.0))

    def step(t: Column) -> Column:
        before = F.get("path", t - 1)
        kept, pulled, bias = F.lit(memory) * entered(F.get(before, F.lit(i)), m), total(before, m.ids), F.lit(m.influence * float(m.bias[i]))
        return F.struct(t.alias("t"), kept.alias("memory"), pulled.alias("influence"), total(before, actions or []).alias("part"), bias.alias("bias"), (kept + pulled + bias).alias("input"), F.get(F.get("path", t), F.lit(i)).alias("activation"))

    traced = infer_frame(x, m, [key], steps, trace=True)
    return traced.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.col("taken")), step)).alias("s")).select(key, "s.*")


def radial_layout(concepts: DataFrame, order: str = "number") -> DataFrame:
    """(id, x, y): the objective in the middle, all others evenly round it in the order of the column ``order``."""
    around = concepts.where("not objective")
    n = around.agg(F.count(F.lit(1)).alias("n"))
    angle = F.lit(2.0) * F.pi() * F.col(order) / F.col("n")
    placed = around.crossJoin(F.broadcast(n)).select("id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))  # one row
    return placed.union(concepts.where("objective").select("id", F.lit(0.0), F.lit(0.0)))
