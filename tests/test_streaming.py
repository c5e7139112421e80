from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from prescriva.operators import explore
from prescriva.streaming import scoring

OF = "id long, time timestamp, reached boolean"
DAY = datetime(2024, 1, 1)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def feed(spark, folder, rows, n):
    spark.createDataFrame(rows, OF).coalesce(1).write.mode("append").parquet(str(folder))
    assert len(list(folder.glob("*.parquet"))) == n


def test_windows_end_with_the_watermark(spark, tmp_path):
    """Two batches: a late note still counts while its window is open, and a window comes out once when the watermark has passed."""
    feed(spark, tmp_path / "in", [(1, DAY, True), (2, DAY + timedelta(days=2), False)], 1)
    source = lambda: spark.readStream.schema(OF).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feed(spark, tmp_path / "in", [(3, DAY + timedelta(days=30), True), (4, DAY + timedelta(days=1), True)], 2)
    feed(spark, tmp_path / "in", [(5, DAY + timedelta(days=60), True)], 3)
    run(scoring.outcomes_by_window(source(), "time"), "windows")
    got = {r.start: (r.n, r.reached) for r in spark.table("windows").collect()}
    whole = {r.start: (r.n, r.reached) for r in scoring.outcomes_by_window(spark.read.parquet(str(tmp_path / "in")), "time").collect()}
    assert got and all(whole[k] == v for k, v in got.items()) and len(got) < len(whole) and sum(n for n, _ in got.values()) >= 3


def test_repeats_within_the_watermark_go(spark, tmp_path):
    feed(spark, tmp_path / "in", [(1, DAY, True), (1, DAY + timedelta(hours=3), True), (2, DAY, False)], 1)
    feed(spark, tmp_path / "in", [(1, DAY + timedelta(hours=5), True), (3, DAY, True)], 2)
    stream = spark.readStream.schema(OF).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(scoring.without_repeats(stream, ["id"], "time"), "repeats")
    assert sorted(r.id for r in spark.table("repeats").collect()) == [1, 2, 3]


def test_a_batch_that_runs_again_replaces_its_folder(spark, tmp_path):
    feed(spark, tmp_path / "in", [(1, DAY, True)], 1)
    feed(spark, tmp_path / "in", [(2, DAY, True)], 2)
    for _ in range(2):  # no checkpoint: the second stream sees all batches again
        stream = spark.readStream.schema(OF).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = scoring.prescribed_batches(stream, lambda df: df.withColumn("plan", F.col("id") * 2), str(tmp_path / "out")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert sorted((r.id, r.plan) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (2, 4)]


def test_histograms(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (3.0, "a"), (None, "a"), (float("nan"), "a"), (3.0, None)], "v double, k string")
    got = sorted((r.bin, r.low, r.high, r.level, r.n) for r in explore.histogram(df, "v", "k", ["a", "b"]).collect())
    assert got == [(1, 0.5, 2.5, "a", 1), (1, 0.5, 2.5, "b", 1), (2, 2.5, 3.5, "a", 1), (2, 2.5, 3.5, "b", 0)]
    assert explore.histogram(df.limit(0), "v", "k", ["a"]).count() == 0
