"""Splits, folds, weights and rebalancing; all draws are hashes of the row's key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prescriva.operators import ranks
from prescriva.operators.neighbours import nearest
from prescriva.sources import tables


def draw(key: Column, seed: int, *more: Column) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed), *more), F.lit(1 << 30)) / float(1 << 30)


def group_id(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``df`` with ``group``: the smallest key of the rows that share these columns (nulls share); each row its own without columns."""
    if not columns:
        return df.withColumn("group", F.col(key))
    least = df.groupBy(*columns).agg(F.min(key).alias("group")).withColumnsRenamed({c: f"_of_{c}" for c in columns})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns))
    return df.join(least, same).drop(*(f"_of_{c}" for c in columns))


def group_numbers(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``df`` with ``number``: 0 for the rows that share ``columns`` with the row of the smallest key, 1 for those of the next that differs, and so on."""
    grouped = group_id(df, columns, key)
    numbers = ranks.dense_numbers(grouped, ["group"]).withColumnRenamed("group", "_lead")
    return grouped.join(numbers, F.col("group") == F.col("_lead")).drop("group", "_lead")


def level_weights(df: DataFrame, level: str) -> DataFrame:
    """(level, n, weight): rows over levels times a level's rows; their mean over rows is 1."""
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(F.col(level).alias("level"), "n", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))  # one row


def stratified_split(df: DataFrame, level: str, key: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """``df`` with boolean ``test``: of each level the rows with the smallest hashes, ``share`` of them rounded up.

    Two passes instead of a window over a whole level: hashes fall into fine bins, whose
    counts tell which bins are in; only the bin at the cut is ranked.
    """
    bins = 1 << 12
    own = df.withColumn("h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("bin", F.pmod("h", F.lit(bins)))
    counts = own.groupBy(level, "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(level).orderBy("bin")
    cuts = counts.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("wanted", F.ceil(F.sum("n").over(Window.partitionBy(level)) * share))
    cuts = cuts.select(F.col(level).alias("l"), F.col("bin").alias("b"), "before", "wanted")
    joined = own.join(F.broadcast(cuts), F.col(level).eqNullSafe(F.col("l")) & (F.col("bin") == F.col("b")))  # at most 4096 rows for each level
    rank = F.row_number().over(Window.partitionBy(level, "bin").orderBy("h", key))
    return joined.withColumn("test", F.col("before") + rank <= F.col("wanted")).select(*df.columns, "test")


#: Groups with more than this share of all rows are assigned one by one: at most its inverse of them.
LARGE_SHARE = 0.001


def grouped_folds(df: DataFrame, group: str, level: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: no group is in two folds, and levels are spread evenly.

    Large groups, at most 1/LARGE_SHARE of them, are assigned on the driver, the most
    uneven first, each to the fold whose level shares it evens most. All others, however
    many, are dealt on Spark: groups with the same numbers of rows of each level are
    alike, and each such kind is dealt in turn, so that folds differ by one group of a
    kind. Turns are positions in a global order, so that no kind is in one task.
    """
    import numpy as np

    counts = df.groupBy(group, level).agg(F.count(F.lit(1)).alias("n")).groupBy(group)
    kinds = tables.written(counts.agg(F.array_sort(F.collect_list(F.struct(F.col(level).cast("string").alias("l"), "n"))).alias("kind"), F.sum("n").alias("rows")), "groups")
    total = kinds.agg(F.sum("rows")).first()[0] or 0
    is_large = F.col("rows") > LARGE_SHARE * total
    large = kinds.where(is_large).collect()
    levels = sorted({x.l for r in large for x in r.kind}, key=str)
    table = {r[group]: np.array([sum(x.n for x in r.kind if x.l == k) for k in levels], dtype=float) for r in large}
    whole = np.maximum(sum(table.values()), 1) if table else np.ones(1)
    names = [sorted(table, key=str)[i] for i in np.random.default_rng(seed).permutation(len(table))]
    held, assigned = np.zeros((folds, len(whole))), []
    for g in sorted(names, key=lambda g: -table[g].std()):
        best = min(range(folds), key=lambda f: (_spread(held, f, table[g], whole), held[f].sum()))
        held[best] += table[g]
        assigned.append((g, best))
    of = f"_g {df.schema[group].dataType.simpleString()}, fold int"
    small = kinds.where(~is_large).withColumn("h", F.xxhash64(F.col(group), F.lit(seed))).withColumn("k", F.xxhash64("kind"))
    # Groups of a kind have consecutive positions, and these go round the folds.
    dealt = ranks.positions(small.select(group, "k", "h"), ["k", "h", group], "_at")
    dealt = dealt.select(F.col(group).alias("_g"), F.pmod("_at", F.lit(folds)).cast("int").alias("fold"))
    folds_of = df.sparkSession.createDataFrame(assigned, of).union(dealt)
    return df.join(folds_of, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def _spread(held, fold: int, own, total) -> float:
    changed = held.copy()
    changed[fold] += own
    return float((changed / total).std(axis=0).mean())


def smote(x: DataFrame, features: list[str], level: str, key: str, neighbours: int = 5, seed: int = 42) -> DataFrame:
    """Rows of ``x`` and synthetic ones (``synthetic``) that bring every level to exactly the largest one's count.

    A synthetic row lies between a row and one of its nearest rows of the same level
    (``neighbours.nearest``, exact over the whole level). A level's rows take turns in the
    order of a hash, so that numbers of synthetic rows differ by one at most; a lone row is repeated.
    """
    counts = x.where(F.col(level).isNotNull()).groupBy(F.col(level).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    plan = tables.written(counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).where("n < most"), "levels")  # one row
    few = x.join(F.broadcast(plan.select("l")), F.col(level).cast("string") == F.col("l"))  # a row for each level
    near = nearest(few, features, level, key, neighbours)
    turns = ranks.positions(near.withColumn("h", F.xxhash64("key", F.lit(seed))), ["grp", "h", "key"], "at")
    first = turns.groupBy("grp").agg(F.min("at").alias("start"))
    own = turns.join(F.broadcast(plan), F.col("grp") == F.col("l")).join(F.broadcast(first), "grp").withColumn("at", F.col("at") - F.col("start"))
    made = F.expr("cast((cast(most - n as decimal(38,0)) * (at + 1)) div n - (cast(most - n as decimal(38,0)) * at) div n as int)")
    own = own.withColumn("made", made).where("made > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("made"))).alias("turn"))
    to = F.coalesce(F.get("near", F.pmod(F.xxhash64("key", "turn", F.lit(seed + 1)), F.greatest(F.size("near"), F.lit(1))).cast("int")).x, F.col("x"))
    share = draw(F.col("key"), seed + 2, F.col("turn"))
    drawn = own.select("grp", "x", to.alias("to"), share.alias("u"))
    between = [(F.get("x", F.lit(i)) + F.col("u") * (F.get("to", F.lit(i)) - F.get("x", F.lit(i)))).alias(c) for i, c in enumerate(features)]
    rows = drawn.select(F.col("grp").alias(level), *between, F.lit(True).alias("synthetic"))
    return x.select(F.col(level).cast("string").alias(level), *(F.col(c).cast("double").alias(c) for c in features), F.lit(False).alias("synthetic")).unionByName(rows)
