"""Readers and sinks."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType

SEPARATORS = (",", ";", "\t", "|")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset and all of Spark runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or spark.conf.get("spark.prescriva.localWork", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="prescriva-")
        spark.conf.set("spark.prescriva.localWork", root)
    return f"{root.rstrip('/')}/prescriva-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """``df`` as a table that outlives executors; ``options`` of Parquet."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line of the file is, else Latin-1. Lines are read as bytes in splits, and no character crosses a line's end, so that splits are judged apart."""
    valid = spark.read.text(path).agg(F.min(F.is_valid_utf8("value"))).first()[0]
    return "ISO-8859-1" if valid is False else "UTF-8"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The separator is the most frequent of SEPARATORS in the header; names are stripped, booleans become text."""
    encoding = encoding_of(spark, path)
    header = (spark.read.text(path).limit(1).first() or [""])[0].lstrip("﻿")
    separator = max(SEPARATORS, key=header.count)
    df = spark.read.option("sep", separator).option("header", True).option("encoding", encoding).option("inferSchema", True).csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    return booleans_as_text(df)


def booleans_as_text(df: DataFrame) -> DataFrame:
    flags = [f.name for f in df.schema if isinstance(f.dataType, BooleanType)]
    return df.withColumns({c: F.when(F.col(c), "True").when(~F.col(c), "False") for c in flags})


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet that isn't empty; a workbook is small, and its reader is an optional package."""
    import pandas as pd

    try:
        sheets = pd.read_excel(path, sheet_name=None)
    except ImportError as e:
        raise RuntimeError("workbooks need the optional package openpyxl") from e
    for sheet in sheets.values():
        sheet = sheet.dropna(how="all").dropna(how="all", axis=1)
        if len(sheet):
            return booleans_as_text(spark.createDataFrame(sheet))
    raise ValueError("the workbook has no rows")


def excel_to_csv(spark: SparkSession, path: str, out: str) -> dict:
    """A workbook's first sheet with rows as delimited text in UTF-8; how many rows and columns there are."""
    df = read_excel(spark, path)
    df.write.mode("overwrite").option("header", True).csv(out)
    return {"rows": df.count(), "columns": len(df.columns)}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By the name's end: workbooks, Parquet, JSON lines, else delimited text."""
    end = path.lower().rsplit(".", 1)[-1]
    if end in ("xlsx", "xlsm", "xls"):
        return read_excel(spark, path)
    if end == "parquet":
        return spark.read.parquet(path)
    if end in ("json", "jsonl"):
        return spark.read.json(path)
    return read_csv(spark, path)


def load(df: DataFrame, columns: list[str], required: list[str], key: str) -> DataFrame:
    """``key`` and ``columns``, text trimmed, without rows that lack a required value; the key survives."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kinds = dict(df.dtypes)
    own = df.select(key, *(F.trim(c).alias(c) if kinds[c] == "string" else F.col(c) for c in columns if c != key))
    return own.dropna(subset=required) if required else own


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities as nulls, which JSON can hold."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in numbers})


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    return without_nan(df).select(F.to_json(F.struct(*df.columns)).alias(column))


def weight_matrix(edges: DataFrame, targets: list[str]) -> DataFrame:
    """Edges as a matrix: a row for each source, a column for each target, 0 where there is none."""
    cells = [F.coalesce(F.sum(F.when(F.col("target") == t, F.col("weight"))), F.lit(0.0)).alias(t) for t in targets]
    return edges.groupBy("source").agg(*cells)


def save_results(directory: str, recommendations: DataFrame, weights: DataFrame, metrics: dict, selection: DataFrame | None = None) -> None:
    recommendations.write.mode("overwrite").option("header", True).csv(f"{directory}/recommendations")
    weights.write.mode("overwrite").option("header", True).csv(f"{directory}/weights")
    if selection is not None:
        selection.write.mode("overwrite").option("header", True).csv(f"{directory}/selection")
    spark = weights.sparkSession
    spark.createDataFrame([(json.dumps(metrics, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/metrics")


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver value (a model, a schema) as one row on any store."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").parquet(path)


def load_text(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(path).first()[0]


FOLLOW_UP = "model string, record long, date date, actions map<string,double>, result string"


def append_follow_up(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_follow_up(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes noted so far; none if the log isn't there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(FOLLOW_UP).json(path)
    except AnalysisException:
        return spark.createDataFrame([], FOLLOW_UP)


def valid_follow_up(rows: DataFrame, actions: list[str], categories: list[str]) -> DataFrame:
    """``rows`` with ``valid``: an action at least, only known ones, a date and a known or numeric result."""
    keys = F.map_keys("actions")
    good = (F.size(keys) > 0) & F.forall(keys, lambda k: k.isin(actions)) & F.col("date").isNotNull() & (F.col("result").isin(categories) | F.col("result").try_cast("double").isNotNull())
    return rows.withColumn("valid", F.coalesce(good, F.lit(False)))


def active_models(models: DataFrame) -> DataFrame:
    """Of (dataset, model, created, state) the newest ready model of each dataset."""
    ready = models.where("state = 'ready'")
    return ready.groupBy("dataset").agg(F.max_by("model", F.struct("created", "model")).alias("model"), F.max("created").alias("created"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
