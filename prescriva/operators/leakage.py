"""Columns that give the objective away: how well one column alone can tell the level.

A column of few values is judged by the most frequent level of each value. A number of
many values is judged by a decision tree on it alone with few leaves, grown best first by
Gini impurity. Such a tree cuts the column's order, so all that it needs are running
counts of the levels over the distinct values: these are sorted in ranges once, for all
columns, and each round of growing is one aggregation over them that finds the best cut
of every new leaf of every column. The driver holds the leaves only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescriva.functions import text
from prescriva.operators import explore, ranks
from prescriva.sources import tables

# A column that is right in so many of all rows gives the objective away, unless one level has nearly all rows.
LEAST, MAJORITY, FEW, ROWS_A_VALUE = 0.99, 0.97, 30, 5


@dataclass
class Leaf:
    """Values in (low, high] of a column; None is open. ``start`` and ``end``: counts of the levels up to low and up to high."""

    column: str
    low: float | None
    high: float | None
    start: tuple[int, ...]
    end: tuple[int, ...]
    cut: float | None = None
    gain: float = 0.0
    middle: tuple[int, ...] = ()

    @property
    def counts(self) -> list[int]:
        return [b - a for a, b in zip(self.start, self.end, strict=True)]

    @property
    def purity(self) -> float:
        return sum(float(n) * n for n in self.counts) / sum(self.counts)


def value_counts(df: DataFrame, columns: list[str], label: str, labels: list[str]) -> DataFrame:
    """(column, value, n_0, n_1, ..., upto_n_0, ...): rows of each level at each distinct number, and up to it; the sums go on from column to column in the order of their names."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    long = df.where(F.col(label).isNotNull()).select(F.explode(pairs).alias("p"), F.col(label).cast("string").alias("label")).select("p.*", "label")
    names = [f"n_{i}" for i in range(len(labels))]
    counts = long.where("value is not null and not isnan(value)").groupBy("column", "value").agg(*(F.sum((F.col("label") == k).cast("long")).alias(n) for n, k in zip(names, labels, strict=True)))
    return tables.written(ranks.running_sums(counts, ["column", "value"], names), "values")


def _cut(counts: DataFrame, leaves: list[Leaf], levels: int) -> None:
    """The best cut of each leaf, found in one job; of equally good ones the lowest. A leaf of one value has none."""
    spark = counts.sparkSession
    rows = [(i, x.column, x.low, x.high, list(x.start), list(x.end)) for i, x in enumerate(leaves)]
    of = spark.createDataFrame(rows, "leaf int, of string, low double, high double, start array<long>, end array<long>")
    inside = (F.col("column") == F.col("of")) & (F.col("low").isNull() | (F.col("value") > F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    own = counts.join(F.broadcast(of), inside)  # a row for each leaf
    upto = [F.col(f"upto_n_{i}") for i in range(levels)]
    below, above = ([(u - F.get("start", F.lit(i))).cast("double") for i, u in enumerate(upto)], [(F.get("end", F.lit(i)) - u).cast("double") for i, u in enumerate(upto)])
    purity = lambda parts: sum((p * p for p in parts[1:]), parts[0] * parts[0]) / sum(parts[1:], parts[0])
    own = own.where(sum(above[1:], above[0]) > 0).select("leaf", (purity(below) + purity(above)).alias("score"), "value", F.array(*upto).alias("upto"))
    best = own.groupBy("leaf").agg(F.max_by(F.struct("score", "value", "upto"), F.struct("score", (-F.col("value")).alias("v"))).alias("b"))
    for r in best.collect():  # a row for each leaf
        x = leaves[r.leaf]
        x.cut, x.middle, x.gain = r.b.value, tuple(r.b.upto), r.b.score - x.purity


def trees(df: DataFrame, columns: list[str], label: str, most_leaves: int | None = None) -> dict[str, list[Leaf]]:
    """Column -> leaves in order of a best-first tree of at most ``most_leaves`` leaves (twice the levels). Rows without a level or a number are left out.

    A leaf of one level isn't cut. All columns grow side by side, each by one cut a round.
    """
    labels = [r[0] for r in df.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().orderBy(label).collect()]  # levels are few
    most = most_leaves or 2 * max(len(labels), 2)
    counts = value_counts(df, columns, label, labels)
    ends = {r["column"]: r for r in counts.groupBy("column").agg(*(x for i in range(len(labels)) for x in (F.min(F.col(f"upto_n_{i}") - F.col(f"n_{i}")).alias(f"a{i}"), F.max(f"upto_n_{i}").alias(f"b{i}")))).collect()}
    grown = {c: [Leaf(c, None, None, *(tuple(ends[c][f"{side}{i}"] for i in range(len(labels))) for side in "ab"))] for c in columns if c in ends}
    fresh = [x for leaves in grown.values() for x in leaves]
    while fresh:
        impure = [x for x in fresh if sum(n > 0 for n in x.counts) > 1]
        if impure:
            _cut(counts, impure, len(labels))
        fresh = []
        for leaves in grown.values():
            able = [x for x in leaves if x.cut is not None]
            if able and len(leaves) < most:
                best = max(able, key=lambda x: x.gain)
                at = leaves.index(best)
                leaves[at : at + 1] = [Leaf(best.column, best.low, best.cut, best.start, best.middle), Leaf(best.column, best.cut, best.high, best.middle, best.end)]
                fresh += leaves[at : at + 2]
    return grown


def first_cuts(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, cut, below, above): where a tree cuts first, and the rows up to there and beyond; without a cut all rows are below."""
    found = trees(df, columns, label, 2)
    rows = [(c, x[0].high, sum(x[0].counts), sum(x[1].counts) if len(x) > 1 else 0) for c, x in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, cut double, below long, above long")


def column_accuracy(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, distinct, accuracy, way) of columns that can be judged: ``values`` for few values of several rows each, ``tree`` for other numbers; the share of rows with a value whose level it tells right."""
    shown = {c: text.canonical(df, c) for c in columns}
    known = df.where(F.col(label).isNotNull())
    row = known.agg(*(F.struct(F.count(c).alias("n"), F.count_distinct(shown[c]).alias("k")).alias(f"c{i}") for i, c in enumerate(columns))).first() if columns else ()
    kinds = {c: (r.n, r.k) for c, r in zip(columns, row, strict=True)}
    few = [c for c, (n, k) in kinds.items() if 0 < k <= FEW and n >= ROWS_A_VALUE * k]
    many = [c for c, (n, k) in kinds.items() if k and c not in few and explore.is_numeric(df, c)]
    found = [(c, x, a, "values") for c, x, a in map(tuple, single_column_accuracy(df, few, label).collect())] if few else []
    for c, leaves in (trees(df, many, label) if many else {}).items():
        found.append((c, kinds[c][1], sum(max(x.counts) for x in leaves) / sum(sum(x.counts) for x in leaves), "tree"))
    return df.sparkSession.createDataFrame(found, "column string, distinct long, accuracy double, way string")


def single_column_accuracy(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, distinct, accuracy): how well the most frequent label of each value tells the label; one shuffle for all columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), text.canonical(df, c).alias("value")) for c in columns))
    long = df.where(F.col(label).isNotNull()).select(F.explode(pairs).alias("p"), F.col(label).alias("label")).select("p.column", "p.value", "label").where("value is not null")
    counts = long.groupBy("column", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column", "value").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), (F.sum("best") / F.sum("n")).alias("accuracy"))


def determining_columns(df: DataFrame, columns: list[str], label: str, least: float = LEAST, majority: float = MAJORITY) -> DataFrame:
    """(column, distinct, accuracy, share) of columns that give the label away; none where one label (``share`` of all rows) has nearly all."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = n.agg((F.max("n") / F.sum("n")).alias("share"))
    found = column_accuracy(df, columns, label).where(F.col("accuracy") >= least).drop("way")
    return found.crossJoin(F.broadcast(share)).where(F.col("share") < majority)  # share is one row
