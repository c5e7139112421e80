"""Ranges of an integer key of about equal bytes, by exact sums: the same rows give the same ranges, however they are laid out.

``repartitionByRange`` samples, so that its borders change with the session. Here the
key's span is cut to bins whose bytes are summed on Spark; only the sums come to the
driver, at most ``BINS`` for a span. A bin that is heavier than a range may be is cut
again. Ranges end at bins' borders; a single key is never divided.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, AT_ONCE = 1 << 14, 16
LEAST, MOST, RANGES = 8 << 20, 1 << 30, 2000
NONE = -(2**63)


def split_points(rows: DataFrame, key: str, size: Column, least: int = LEAST, most: int = MOST) -> list[int]:
    """The first keys of all ranges but the lowest.

    A range has about a ``RANGES``-th of all bytes, but at least ``least`` and at most
    ``most`` of them. Null keys belong to the lowest range.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return []
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("decimal(20,0)").alias("k"), size.cast("long").alias("n"))
    bins, todo, limit = [], [(low, high + 1)], None
    while todo:
        now, todo = todo[:AT_ONCE], todo[AT_ONCE:]
        found = F.lit(None).cast("struct<j:int,b:bigint>")
        for j, (a, b) in enumerate(now):
            step = max(1, -(-(b - a) // BINS))
            inside = (F.col("k") >= F.lit(a).cast("decimal(20,0)")) & (F.col("k") < F.lit(b).cast("decimal(20,0)"))
            at = F.expr(f"(k - cast('{a}' as decimal(20,0))) div cast('{step}' as decimal(20,0))")
            found = F.when(inside, F.struct(F.lit(j).alias("j"), at.alias("b"))).otherwise(found)
        sums = keyed.groupBy(found.alias("at")).agg(F.sum("n").alias("n")).where("at is not null").collect()
        limit = limit or min(most, max(least, sum(r.n for r in sums) // RANGES))
        for r in sums:
            a, b = now[r["at"].j]
            step = max(1, -(-(b - a) // BINS))
            first = a + step * r["at"].b
            until = min(b, first + step)
            if r.n > limit and until - first > 1:
                todo.append((first, until))
            else:
                bins.append((first, r.n))
    out, held = [], 0
    for first, n in sorted(bins):
        if held and held + n > limit:
            out.append(first)
            held = 0
        held += n
    return out


def range_of(key: str, points: list[int]) -> Column:
    """The number of the range that a key is in."""
    if not points:
        return F.lit(0)
    borders = np.array(points, dtype=np.int64)

    @F.arrow_udf("int")
    def found(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(borders, keys.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return found(F.coalesce(F.col(key).cast("long"), F.lit(NONE)))
