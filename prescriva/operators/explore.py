"""Profiles, statistics by level, correlations and row queries: aggregations and sorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from prescriva.functions import dates, text
from prescriva.operators import quantiles, ranks

PAGE_MOST = 500


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicates, empty cells, rows with any, numeric and other columns."""
    empty = [F.col(c).isNull().cast("long") for c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(reduce(lambda a, b: a + b, empty)).alias("empty_cells"), F.sum((reduce(lambda a, b: a + b, empty) > 0).cast("long")).alias("rows_with_empty"))
    different = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    numeric = sum(is_numeric(df, c) for c in df.columns)
    return counts.crossJoin(F.broadcast(different)).select("rows", F.lit(len(df.columns)).alias("columns"), "duplicates", "empty_cells", "rows_with_empty", F.lit(numeric).alias("numeric"), F.lit(len(df.columns) - numeric).alias("categorical"))  # one row each


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, distinct, missing, low, q1, median, q3, high, mean, std), all columns together; ``df`` is read several times."""
    parts = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        parts += [F.count(v).alias(f"present_{i}"), F.count_distinct(v).alias(f"distinct_{i}"), (F.count(F.lit(1)) - F.count(v)).alias(f"missing_{i}"), F.min(v).alias(f"low_{i}"), F.max(v).alias(f"high_{i}"), F.avg(v).alias(f"mean_{i}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"std_{i}")]
    names = ("present", "distinct", "missing", "low", "q1", "median", "q3", "high", "mean", "std")
    found = quantiles.quantiles(df, columns, (0.25, 0.5, 0.75))
    middle = {c: dict(zip(("q1", "median", "q3"), found.get(("", c), (None,) * 3), strict=True)) for c in columns}
    rows = [F.struct(F.lit(c).alias("column"), *((F.lit(middle[c][n]).cast("double") if n in middle[c] else F.col(f"{n}_{i}")).alias(n) for n in names)) for i, c in enumerate(columns)]
    return df.agg(*parts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def category_counts(df: DataFrame, column: str, key: str, most: int = 30) -> DataFrame:
    """(category, n): the most frequent values; of equal ones the one that comes first by ``key``."""
    own = df.select(text.canonical(df, column).alias("category"), F.col(key).alias("k")).where("category is not null")
    return own.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).orderBy(F.desc("n"), "first").limit(most).select("category", "n")


def distinct_examples(df: DataFrame, column: str, key: str, most: int = 5) -> DataFrame:
    """(value, first): the first different values by ``key``."""
    own = df.select(text.canonical(df, column).alias("value"), F.col(key).alias("k")).where("value is not null")
    return own.groupBy("value").agg(F.min("k").alias("first")).orderBy("first", "value").limit(most)


def text_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, distinct, with_number, date_like, date_read): what the encoding of a text column is guessed from; dates are told by their shape and by whether they can be read."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), text.canonical(df, c).alias("value")) for c in columns))
    long = df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")
    date = F.col("value").rlike(r"^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})")
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("present"), F.count_distinct("value").alias("distinct"), F.avg(F.col("value").rlike(r"^\D*\d+\D*$").cast("double")).alias("with_number"), F.avg(date.cast("double")).alias("date_like"), F.avg(dates.parsed(F.col("value")).isNotNull().cast("double")).alias("date_read"))


def suggested_encoding(shapes: DataFrame) -> DataFrame:
    """(column, encoding, identifier) by the rules: two values are ordinal, dates, numbers in text, else nominal."""
    rule = F.when(F.col("distinct") == 2, "ordinal").when(F.col("with_number") == 1.0, "numero_en_texto").when((F.col("date_like") >= 0.95) & (F.col("date_read") >= 0.95), "fecha").otherwise("nominal")
    return shapes.select("column", rule.alias("encoding"), (F.col("distinct") >= 0.95 * F.col("present")).alias("identifier"))


def stats_by_level(df: DataFrame, column: str, level: str) -> DataFrame:
    """(level, n, mean, q1, median, q3); ``df`` is read several times."""
    v = F.col(column).cast("double")
    counts = df.groupBy(F.col(level).cast("string").alias("level")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"))
    middle = quantiles.quantile_table(df, [column], {"q1": 0.25, "median": 0.5, "q3": 0.75}, level).withColumnRenamed(level, "_level")
    joined = counts.join(F.broadcast(middle), F.col("level").eqNullSafe(F.col("_level")), "left")  # a row for each level
    return joined.select("level", "n", "mean", "q1", "median", "q3")


def histogram_by_level(df: DataFrame, column: str, level: str, bins: int = 12) -> DataFrame:
    """(bin, level, n): equal bins over the column's range, the last one closed."""
    v = F.col(column).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    own = df.where(v.isNotNull()).select(v.alias("v"), F.col(level).alias("level")).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width) + 1, F.lit(bins))).otherwise(F.lit(1))
    return own.select(place.cast("long").alias("bin"), "level").groupBy("bin", "level").agg(F.count(F.lit(1)).alias("n"))


#: A number of at most so many values has a bin for each of them.
FEW_VALUES = 12


def histogram(df: DataFrame, column: str, level: str, levels: list[str], bins: int = 12) -> DataFrame:
    """(bin, low, high, level, n) for each bin and level, 0 included.

    A number of few values has a bin from half below each value to half below the next,
    the last one to half above it; others have equal bins over their range, the last one
    closed. Rows of other levels and without a number are left out; no number, no bins.
    """
    v = F.col(column).cast("double")
    own = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"), F.col(level).cast("string").alias("level"))
    values = sorted(r.v for r in own.select("v").distinct().limit(FEW_VALUES + 1).collect())
    if not values:
        edges = []
    elif len(values) <= FEW_VALUES:
        edges = [x - 0.5 for x in values] + [values[-1] + 0.5]
    else:
        low, high = own.agg(F.min("v"), F.max("v")).first()
        edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
    # Edges are few, so a value's bin is the number of edges up to it.
    place = F.least(sum(((F.col("v") >= e).cast("int") for e in edges), F.lit(0)), F.lit(max(len(edges) - 1, 1)))
    counts = own.where(F.col("level").isin(levels)).groupBy(place.alias("bin"), "level").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(i + 1, a, b, k) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for k in levels], "bin int, low double, high double, level string")
    return every.join(F.broadcast(counts), ["bin", "level"], "left").select("bin", "low", "high", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # a row for each bin and level


def categories_by_level(df: DataFrame, column: str, level: str, levels: list[str]) -> DataFrame:
    """(category, n, one column n_<level> for each level)."""
    own = df.select(text.canonical(df, column).alias("category"), F.col(level).alias("level")).where("category is not null")
    return own.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("level") == k).cast("long")).alias(f"n_{k}") for k in levels))


def level_means(x: DataFrame, concepts: list[str], level: str) -> DataFrame:
    """(level, concept, mean) of scaled concepts."""
    wide = x.groupBy(F.col(level).alias("level")).agg(*(F.avg(c).alias(c) for c in concepts))
    return wide.unpivot("level", concepts, "concept", "mean")


def average_ranks(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, rank): ranks of the values, equal ones sharing their mean: distinct values alone are sorted, with their counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranks.running_sums(counts, ["v"], ["n"]).select("v", (F.col("upto_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    return df.join(ranked, F.col(column) == F.col("v")).select(key, "rank")


def correlations(x: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson for each ordered pair in one aggregation; null where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    # Not corr(), which fails on a constant column in ANSI mode.
    spread = {c: F.stddev_pop(c) for c in columns}
    row = x.agg(*(F.try_divide(F.covar_pop(a, b), spread[a] * spread[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    structs = []
    for i, (a, b) in enumerate(pairs):
        for p, q in {(a, b), (b, a)}:
            structs.append(F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.when(~F.isnan(f"r{i}"), F.col(f"r{i}")).alias("r")))
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def spearman(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(a, b, r) of average ranks; rows with a null in any column are left out."""
    whole = df.select(key, *columns).dropna()
    ranked = whole.select(key)
    for c in columns:
        ranked = ranked.join(average_ranks(whole, c, key).withColumnRenamed("rank", c), key)
    return correlations(ranked, columns)


def co_moments(x: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, covariance): population covariances, the sums that a shrunk precision matrix starts from."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = x.agg(*(F.covar_pop(a, b).alias(f"s{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)))).alias("s")).select("s.*")


def partial_correlations(x: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) from the precision matrix of the Ledoit-Wolf shrunk covariance.

    Both its sums are aggregations over all rows: the covariances, and the squared norms'
    second moment; only the small matrix is inverted on the driver.
    """
    import numpy as np

    k = len(columns)
    means = x.agg(F.count(F.lit(1)), *(F.avg(c) for c in columns)).first()
    n, centred = means[0], [F.col(c) - F.lit(m) for c, m in zip(columns, means[1:], strict=True)]
    squares = reduce(lambda a, b: a + b, [c * c for c in centred])
    row = x.agg(F.avg(squares * squares), *(F.avg(centred[i] * centred[j]) for i in range(k) for j in range(k))).first()
    s = np.array(row[1:], dtype=float).reshape(k, k)
    mu = np.trace(s) / k
    delta = ((s - mu * np.eye(k)) ** 2).sum() / k
    beta = (row[0] - (s**2).sum()) / (k * n)
    shrink = 0.0 if delta <= 0 else min(max(beta, 0.0), delta) / delta
    p = np.linalg.pinv((1 - shrink) * s + shrink * mu * np.eye(k))
    d = np.sqrt(np.diag(p))
    r = np.clip(-p / np.outer(d, d), -1, 1)
    np.fill_diagonal(r, 1.0)
    return x.sparkSession.createDataFrame([(a, b, float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)], "a string, b string, r double")


def condition(df: DataFrame, column: str, op: str, value) -> Column:
    """One of = != < <= > >= contiene. Numbers compare as numbers; text has = != contiene; a null differs from everything."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column}")
    shown = text.canonical(df, column)
    try:
        number = float(value)
    except (TypeError, ValueError):
        number = None
    numeric = (is_numeric(df, column) or dict(df.dtypes)[column] == "boolean") and number is not None
    own = F.col(column).cast("double") if numeric else shown
    other = F.lit(number) if numeric else F.lit(str(value))
    if op == "contiene":
        return F.coalesce(text.contains(shown, str(value)), F.lit(False))
    if op == "=":
        return F.coalesce(own == other, F.lit(False))
    if op == "!=":
        return F.coalesce(own != other, F.lit(True))
    if op in ("<", "<=", ">", ">=") and numeric:
        return F.coalesce({"<": own < other, "<=": own <= other, ">": own > other, ">=": own >= other}[op], F.lit(False))
    raise ValueError(f"{op} isn't possible for {column}")


def rows_page(df: DataFrame, key: str, filters: list[tuple] = (), order: str | None = None, descending: bool = False, start: int = 0, count: int = 50, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, one row ``total``): rows that pass all filters, sorted with nulls last and then by ``key``; at most PAGE_MOST."""
    own = reduce(lambda d, f: d.where(condition(df, *f)), filters, df)
    by = [] if order is None else [F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()]
    page = own.orderBy(*by, key).offset(max(start, 0)).limit(min(max(count, 1), PAGE_MOST))
    return (page.select(key, *[c for c in columns if c != key]) if columns else page), own.agg(F.count(F.lit(1)).alias("total"))


def typical_row(df: DataFrame, numeric: list[str], categorical: list[str], key: str) -> DataFrame:
    """(column, value): medians of numbers and the most frequent categories (of equal ones the first), as text."""
    found = quantiles.medians(df, numeric)
    medians = df.sparkSession.createDataFrame([(c, found.get(c)) for c in numeric], "column string, value double").select("column", F.col("value").cast("string").alias("value"))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), text.canonical(df, c).alias("value")) for c in categorical))
    long = df.select(F.col(key).alias("k"), F.explode(pairs).alias("p")).select("k", "p.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    best = counts.groupBy("column").agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"))
    return medians.unionByName(best)


def strongest_pairs(r: DataFrame, objective: str, most: int = 10) -> DataFrame:
    """The most correlated pairs a < b without the objective."""
    return r.where((F.col("a") < F.col("b")) & (F.col("a") != objective) & (F.col("b") != objective) & F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "a", "b").limit(most)


def scatter_sample(df: DataFrame, key: str, most: int = 1500, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, by a digest of key and seed: the same whatever the partitions are."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(most)


def axis_positions(means: DataFrame, category: str = "category", value: str = "encoded") -> DataFrame:
    """(category, position): where categories without an order stand on an axis, from the least to the largest mean of the objective; equal means by name."""
    return ranks.positions(means.select(category, value), [value, category], "position").select(category, "position")
