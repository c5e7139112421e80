from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from prescriva.llm import sharded


def test_reading_of_10000_blocks_is_linear(spark, monkeypatch):
    """Each footer is parsed once by a reader that goes through its blocks in order, and each row group is read for its own blocks only."""
    rows = spark.range(30_000).selectExpr("cast(id / 3 as long) * 7919 - 40000000 as block", "cast(id % 3 as int) as kind", "cast(repeat(cast(id as string), 40) as binary) as body")
    monkeypatch.setattr(sharded, "GROUP_BYTES", 1 << 14)
    folder = sharded.write_by_block(rows, "many", shards=40)
    assert folder.buckets == 10
    opened, groups = [], []
    own = pq.ParquetFile

    class Counted(own):
        def __init__(self, *a, **b):
            opened.append(1)
            super().__init__(*a, **b)

        def read_row_groups(self, which, *a, **b):
            groups.append(len(which))
            return super().read_row_groups(which, *a, **b)

    monkeypatch.setattr(sharded.pq, "ParquetFile", Counted)
    answers = sharded.Answers(folder)
    blocks = sorted((i * 7919 - 40000000 for i in range(10_000)), key=lambda b: (b % folder.buckets, b))
    for block in blocks:
        assert sorted(answers.of(block)) == [0, 1, 2]
    assert not answers.rows(5, ["kind"])
    assert len(opened) <= 2 * folder.buckets and sum(groups) <= 2.2 * len(blocks)


def test_files_without_blocks(spark):
    folder = sharded.write_by_block(spark.createDataFrame([], "block long, kind int, body binary"), "none")
    assert sharded.Answers(folder).of(3) == {} and isinstance(sharded.pack(), bytes) and pa.__version__
