"""Dates in text, by a two-format rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_FIRST = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s")
DAY_FIRST = ("d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy H:m:s", "d/M/yyyy H:m:s")


def parsed(c: Column) -> Column:
    """Text that begins with four digits and a mark has the year first, other text the day; what can't be read is null."""
    own = F.trim(c.cast("string"))
    read = lambda formats: F.coalesce(*(F.try_to_timestamp(own, F.lit(f)) for f in formats))
    return F.when(own.rlike(r"^[0-9]{4}[-/.]"), read(YEAR_FIRST)).otherwise(read(DAY_FIRST)).cast("date")


def days_since(c: Column, first) -> Column:
    return F.datediff(c, F.lit(first).cast("date")).cast("double")
