"""Exact quantiles of many columns and groups at once, with memory that doesn't grow with the values.

What is wanted are order statistics: the values at two ranks for each quantile. A first
pass counts the values and finds their ends. Each further pass cuts the intervals that
hold wanted ranks into ``BINS`` equal bins, counts these and keeps the bins that the ranks
fall in, with their own least and largest values; an interval of few rows is counted value
by value. Each pass is one aggregation for all columns, groups and quantiles, and what
comes to the driver is a row for each bin. Three or four passes do for any usual table;
the interval shrinks whatever the distribution is, and repeated values are one value.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, FEW = 1024, 4096


@dataclass
class _Interval:
    group: str | None
    column: str
    low: float
    high: float
    before: int
    rows: int
    wanted: list[int]


def _long(df: DataFrame, columns: list[str], by: str | None) -> DataFrame:
    """(grp, column, v) of all finite numbers."""
    group = F.col(by).cast("string") if by else F.lit("")
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))
    long = df.select(group.alias("grp"), F.explode(pairs).alias("p")).select("grp", "p.*")
    return long.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))


def order_statistics(df: DataFrame, columns: list[str], ranks, by: str | None = None) -> dict[tuple[str | None, str], tuple[int, dict[int, float]]]:
    """(group, column) -> (number of values, rank -> value), ranks from 0; ``ranks(n)`` tells which of n are wanted. Nulls, NaN and infinities are no values; a group or column without any is left out."""
    spark, long = df.sparkSession, _long(df, columns, by)
    firsts = [tuple(r) for r in long.groupBy("grp", "column").agg(F.count(F.lit(1)), F.min("v"), F.max("v")).collect()]

    def counted(todo: list[_Interval]) -> list:
        own = spark.createDataFrame([(i, x.group, x.column, x.low, x.high, x.rows <= FEW) for i, x in enumerate(todo)], "i int, g string, c string, low double, high double, few boolean")
        inside = F.col("grp").eqNullSafe(F.col("g")) & (F.col("column") == F.col("c")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
        # Halves, so that a span of the largest numbers doesn't overflow.
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        place = F.when(F.col("few"), F.col("v")).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("double"))
        # At most 2 rows for each quantile, column and group.
        return long.join(F.broadcast(own), inside).groupBy("i", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()

    return _narrowed(firsts, counted, ranks)


def _narrowed(firsts: list[tuple], counted, ranks) -> dict[tuple[str | None, str], tuple[int, dict[int, float]]]:
    """``firsts``: (group, column, values, least, largest); ``counted(intervals)`` gives (i, place, n, lo, hi) of the bins of each interval i that hold values."""
    todo, found = [], {}
    for group, column, n, low, high in firsts:
        found[group, column] = (n, {})
        todo.append(_Interval(group, column, low, high, 0, n, sorted(set(ranks(n)))))
    while todo:
        for x in todo:
            if x.low == x.high:
                found[x.group, x.column][1].update(dict.fromkeys(x.wanted, x.low))
        todo = [x for x in todo if x.low != x.high and x.wanted]
        if not todo:
            break
        bins = [[] for _ in todo]
        for r in counted(todo):
            bins[r.i].append(r)
        later = []
        for x, parts in zip(todo, bins, strict=True):
            parts.sort(key=lambda r: r.place)
            upto = list(accumulate(r.n for r in parts))
            hits: dict[int, list[int]] = {}
            for k in x.wanted:
                hits.setdefault(bisect_right(upto, k - x.before), []).append(k)
            for at, wanted in hits.items():
                later.append(_Interval(x.group, x.column, parts[at].lo, parts[at].hi, x.before + upto[at] - parts[at].n, parts[at].n, wanted))
        todo = later
    return found


def _between(qs: tuple[float, ...]):
    """(which ranks of n values are wanted, the quantiles of found ones)."""
    places = lambda n: [(int(q * (n - 1)), q * (n - 1) - int(q * (n - 1))) for q in qs]
    ranks = lambda n: [k for at, part in places(n) for k in ((at, at + 1) if part else (at,))]
    values = lambda n, value: tuple(value[at] + part * (value[at + 1] - value[at]) if part else value[at] for at, part in places(n))
    return ranks, values


def quantiles(df: DataFrame, columns: list[str], qs: tuple[float, ...], by: str | None = None) -> dict[tuple[str | None, str], tuple[float, ...]]:
    """(group, column) -> its quantiles, interpolated between neighbouring values; the group is '' without ``by``."""
    ranks, values = _between(qs)
    return {key: values(n, value) for key, (n, value) in order_statistics(df, columns, ranks, by).items()}


#: Bins of an interval where a task counts those of all places at once.
PLACE_BINS = 128


def by_place(df: DataFrame, column: str, qs: tuple[float, ...]) -> list[tuple[int, tuple[float, ...]]]:
    """(place, quantiles) for each place of a column of arrays of numbers, up to the longest; shorter arrays count with their last value, empty ones don't. ``df`` is read several times.

    A task sorts a batch's values of each place and counts the bins of all of them, so that no array is exploded into rows.
    """
    own = df.select(F.col(column).alias("a")).where(F.size("a") > 0)
    longest = own.agg(F.max(F.size("a"))).first()[0] or 0

    def sorted_places(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            lists = batch.column("a")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for s in range(0, len(lists), 10_000):
                starts, ends = offsets[s : s + 10_000 + 1][:-1], offsets[s + 1 : s + 10_000 + 1]
                yield np.sort(flat[np.minimum(starts + np.arange(longest)[:, None], ends - 1)], axis=1)

    def bins(found: dict[tuple[int, float], tuple[int, float, float]]) -> pa.RecordBatch:
        keys, values = zip(*found, strict=True) if found else ((), ()), zip(*found.values(), strict=True) if found else ((), (), ())
        types = (pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*keys, *values), types, strict=True)], names=["i", "place", "n", "lo", "hi"])

    def counted(todo: list[_Interval]) -> list:
        spans = [(int(x.group), x.low, x.high, x.rows <= FEW) for x in todo]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, float], tuple[int, float, float]] = {}
            for places in sorted_places(batches):
                for i, (at, low, high, few) in enumerate(spans):
                    v = places[at]
                    v = v[np.searchsorted(v, low) : np.searchsorted(v, high, "right")]
                    if len(v):
                        bin_of = v if few else np.minimum(np.floor((v / 2 - low / 2) / (high / 2 - low / 2) * PLACE_BINS), PLACE_BINS - 1)
                        cuts = np.concatenate([[0], np.flatnonzero(bin_of[1:] != bin_of[:-1]) + 1, [len(v)]])
                        for place, s, e in zip(bin_of[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                            n, lo, hi = found.get((i, place), (0, np.inf, -np.inf))
                            found[i, place] = n + e - s, min(lo, float(v[s])), max(hi, float(v[e - 1]))
            yield bins(found)

        kinds = "i int, place double, n long, lo double, hi double"
        return own.mapInArrow(run, kinds).groupBy("i", "place").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in sorted_places(batches):
            yield bins({(i, 0.0): (len(v), float(v[0]), float(v[-1])) for i, v in enumerate(places)})

    if not longest:
        return []
    firsts = own.mapInArrow(ends, "i int, place double, n long, lo double, hi double").groupBy("i").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    ranks, values = _between(qs)
    found = _narrowed([(str(r.i), column, r.n, r.lo, r.hi) for r in firsts], counted, ranks)
    return sorted((int(g), values(n, value)) for (g, _), (n, value) in found.items())


def quantile_table(df: DataFrame, columns: list[str], qs: dict[str, float], by: str) -> DataFrame:
    """(``by``, column, one column for each name of ``qs``)."""
    rows = [(g, c, *values) for (g, c), values in quantiles(df, columns, tuple(qs.values()), by).items()]
    return df.sparkSession.createDataFrame(rows, f"`{by}` string, column string, {', '.join(f'{k} double' for k in qs)}")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Column -> median of its values; columns without any are left out."""
    return {c: v[0] for (_, c), v in quantiles(df, columns, (0.5,)).items()} if columns else {}
