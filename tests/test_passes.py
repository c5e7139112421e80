from __future__ import annotations

from pyspark.sql import functions as F

from prescriva.operators import learn, prescribe
from prescriva.plans import outcome, prescriptive
from prescriva.sources import tables


def _counted(df):
    """``df``, and how many of its rows have been worked out so far."""
    rows = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), rows


def test_a_run_works_its_input_out_once(spark):
    """The passes of encoders and folds, however many, read what was written."""
    df = tables.written(outcome.customer_outcome(spark, "/root/testdata/sf0.001"), "outcome")
    seen, rows = _counted(df)
    options = prescriptive.Options.of({"most_steps": 2, "folds": 2, "slopes": (1.0,), "alphas": (1e-3,), "fold_steps": 2, "search": prescribe.Search(population=10, generations=2)})
    prescriptive.run(seen, outcome.FULL_SCHEMA, "row_id", options)
    assert rows.value == df.count()


def test_folds_are_worked_out_once(spark):
    df = tables.written(outcome.customer_outcome(spark, "/root/testdata/sf0.001"), "outcome")
    seen, rows = _counted(df.withColumn("part", F.pmod("row_id", F.lit(3)).cast("int")))
    parts = learn.fold_parts(seen, outcome.SCHEMA, "part", ["row_id", "outcome"])
    assert parts.count() == 3 * df.count() and rows.value == df.count()
