"""Global positions: the place of each row in an order of the whole table, without a task that sees it all.

The table is written in ranges of its sort keys, a sorted file for each range. A row's
position is then the number of rows in the files before its own, plus its row number in
the file. Ranges differ from run to run, positions don't: equal keys alone may change
places. No window is needed, so no key and no range is held by one task; all that is
sent round is a number for each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prescriva.sources import tables


def _in_files(df: DataFrame, by: list[str | Column], keep: list[str]) -> DataFrame:
    """``keep`` of ``df`` in written ranges of ``by``, with ``_file``, its order ``_part`` and ``_row``, the number in the file."""
    table = tables.written(df.repartitionByRange(*by).sortWithinPartitions(*by).select(*keep), "ordered")
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return table.select(*keep, part.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _before(files: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each file the sums over all files before it: a row for each range, so that one task adds them up."""
    totals = files.groupBy("_part", "_file").agg(*(c.alias(f"_before_{k}") for k, c in sums.items()))
    earlier = Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_file", *(F.coalesce(F.sum(f"_before_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums))


def positions(df: DataFrame, by: list[str | Column], name: str = "position", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (all) with the long ``name``: 0 for the first row in the order of ``by``; nulls come first, texts are in the order of their UTF-8 bytes.

    Rows that are equal in ``by`` take neighbouring positions in any order; very many of
    them need a further key that parts them, or they are sorted by one task.
    """
    keep = columns or df.columns
    files = _in_files(df, by, keep)
    before = F.broadcast(_before(files, {"n": F.count(F.lit(1))}))
    return files.join(before, "_file").select(*keep, (F.col("_before_n") + F.col("_row")).alias(name))


def running_sums(df: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """``df`` with ``upto_<c>`` for each of the integer columns ``sums``: the sum of all rows up to this one in the order of ``by``, which has to be unique."""
    files = _in_files(df, by, df.columns)
    before = F.broadcast(_before(files, {c: F.sum(c) for c in sums}))
    upto = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    own = files.select(*df.columns, "_file", *(F.sum(c).over(upto).alias(f"_own_{c}") for c in sums))
    return own.join(before, "_file").select(*df.columns, *((F.col(f"_own_{c}") + F.col(f"_before_{c}")).alias(f"upto_{c}") for c in sums))


def dense_numbers(df: DataFrame, by: list[str], name: str = "number") -> DataFrame:
    """(``by``, ``name``): the distinct rows of ``by``, numbered from 0 in their order; nulls are values and come first."""
    return positions(df.select(*by).distinct(), by, name)
