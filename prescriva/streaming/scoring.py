"""Extensions for streams: score records, watch outcomes, drop repeated notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from prescriva.functions import numeric
from prescriva.operators.fcm import CognitiveMap, infer_column


def scored(stream: DataFrame, m: CognitiveMap, levels: dict[str, float], steps: int = 30) -> DataFrame:
    """Stateless: each record's activation and level, as one expression."""
    return stream.withColumn("activation", infer_column(m, 0.5, steps)).withColumn("level", numeric.nearest_level(F.col("activation"), levels))


def outcomes_by_window(notes: DataFrame, time: str, late: str = "1 day", width: str = "7 days") -> DataFrame:
    """(start, n, reached): follow-up notes (with a boolean ``reached``) by event-time window; state ends with the watermark."""
    own = notes.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("reached").cast("double")).alias("reached")).select(F.col("w.start").alias("start"), "n", "reached")


def without_repeats(notes: DataFrame, ids: list[str], time: str, late: str = "1 day") -> DataFrame:
    return notes.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


def prescribed_batches(stream: DataFrame, prescribe: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """Prescribes each micro-batch; a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        prescribe(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one)
