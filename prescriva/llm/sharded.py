"""Exact counts of very many keys: what blocks of documents ask for, summed by shards and sent back.

A block is a fixed run of rows of a Parquet file; its name comes from the file and the
row numbers, so that every scan names it alike, whatever the splits are. A scan packs
what a block has (sorted keys with values) into one row for each shard; a shard adds up
what all blocks have sent, and answers each block with the totals of its own keys. The
answers are a table in the shared folder, in files of many blocks each that are sorted by
block, which a later scan reads beside the block's documents: texts are never shuffled.
Keys are spread evenly over the shards by their hashes, and a key is sent once by a
block however often it occurs there, so that no key is hot. Rows are numpy arrays in
bytes; Spark partitions, shuffles and spills them.

A shard is what a task holds at once. There is one for each ``SHARD_BYTES`` of the input
files, at least one for each shuffle partition; a task works through its shards one
after another. A block sends one row to each shard, so at very large inputs ``ROWS`` and
``SHARD_BYTES`` should grow together, with the root of the input.
"""

from __future__ import annotations

import itertools
import struct
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescriva.llm import shared

ROWS = 2048
SHARD_BYTES = 32 << 20
#: Bytes of a row group in files of answers; a reader takes those that hold its block.
GROUP_BYTES = 1 << 20
SHARDS_A_FILE = 4
ASKED = "shard int, block long, kind int, body binary"
_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray, ascending: int = 1) -> bytes:
    """Arrays of unsigned integers as bytes; the first ``ascending`` ones are sorted and kept as differences. Equal bytes of numbers lie together and compress."""
    out = []
    for i, a in enumerate(arrays):
        a = np.ascontiguousarray(a, dtype=np.uint64)
        if i < ascending and len(a):
            a = np.concatenate([a[:1], a[1:] - a[:-1]])
        body = _PACK.compress(a.view(np.uint8).reshape(-1, 8).T.tobytes())
        out.append(struct.pack("<II", len(a), len(body)) + body)
    return b"".join(out)


def unpack(body: bytes, ascending: int = 1) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        n, size = struct.unpack_from("<II", body, at)
        at += 8
        planes = np.frombuffer(_UNPACK.decompress(body[at : at + size], max_output_size=8 * n or 1), dtype=np.uint8)
        a = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).reshape(-1)
        out.append(np.cumsum(a, dtype=np.uint64) if len(out) < ascending else a)
        at += size
    return out


def from_files(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows come from files, which numbers them; else a written copy."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return shared.written(docs, "rows")


def with_blocks(docs: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """``columns`` of ``docs`` with the longs ``block`` and ``row`` (the row's number in its file)."""
    shared.small_batches(docs.sparkSession)
    row = F.col("_metadata.row_index")
    return from_files(docs).select(*columns, F.xxhash64("_metadata.file_path", F.floor(row / (rows or ROWS))).alias("block"), row.alias("row"))


def by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches that lie in one block, in order."""
    for batch in batches:
        names = batch.column("block").to_numpy()
        for s, e in itertools.pairwise([0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]):
            if e > s:
                yield int(names[s]), batch.slice(s, e - s)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values)


def shards_of(docs: DataFrame, size: int = SHARD_BYTES) -> int:
    """How many shards the documents of a file-based ``docs`` need."""
    files = docs.select("_metadata.file_path", "_metadata.file_size").distinct()
    total = files.agg(F.sum("file_size")).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def ask(docs: DataFrame, count: Callable, merge: Callable, kind: int = 0) -> DataFrame:
    """ASKED rows of ``docs`` (which has ``block``).

    ``count(batch)`` gives the arrays of a part of a block, ``merge(list of them)`` one of
    all parts as (shard of each entry, arrays, how many of the first are ascending in a shard).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in itertools.groupby(by_block(batches), lambda x: x[0]):
            shard, arrays, ascending = merge([count(p) for _, p in parts])
            order = np.argsort(shard, kind="stable")
            shard, arrays = shard[order], [a[order] for a in arrays]
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else [0]
            spans = list(itertools.pairwise(cuts))
            for at in range(0, len(spans), 64):
                own = spans[at : at + 64]
                bodies = [pack(*(a[s:e] for a in arrays), ascending=ascending) for s, e in own]
                yield asked_rows([int(shard[s]) for s, _ in own], block, kind, bodies)
        shared.give_back()

    return docs.mapInArrow(run, ASKED)


def asked_rows(shards: list[int], block: int, kind: int, bodies: list[bytes]) -> pa.RecordBatch:
    """ASKED rows of one block."""
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([block] * len(bodies), pa.int64()), pa.array([kind] * len(bodies), pa.int32()), pa.array(bodies, pa.binary())], names=["shard", "block", "kind", "body"])


def answer(asked: DataFrame, reply: Callable[[int, list[tuple[int, int, bytes]]], Iterator[tuple[int, int, int, bytes]]]) -> DataFrame:
    """``reply(shard, rows)`` for each shard, where its rows (block, kind, body) are together; it gives (shard, block, kind, body) rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "kind", "body")), strict=True)

        for shard, own in itertools.groupby(rows(), lambda r: r[0]):
            replies = reply(shard, [r[1:] for r in own])
            while part := list(itertools.islice(replies, 64)):
                columns = list(zip(*part, strict=True))
                types = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "block", "kind", "body"])
        shared.give_back()

    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int"))
    return dealt.sortWithinPartitions("shard", "block", "kind").mapInArrow(run, ASKED)


class Folder(NamedTuple):
    """A table that is read by block: files for buckets of blocks."""

    path: str
    buckets: int


def write_by_block(rows: DataFrame, name: str, shards: int = 0) -> Folder:
    """``rows`` (with ``block``) as files of many blocks, sorted by block.

    ``shards``: those of the documents (``shards_of``). A file is for about
    ``SHARDS_A_FILE`` shards' worth of documents at most, so that files don't grow with the input.
    """
    spark = rows.sparkSession
    folder = Folder(shared.shared_dir(spark, name), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_A_FILE)))
    bucket = F.pmod("block", F.lit(folder.buckets)).cast("int")
    dealt = rows.withColumn("bucket", bucket).repartitionById(folder.buckets, F.col("bucket")).sortWithinPartitions("bucket", "block")
    with shared.step(spark):
        dealt.write.partitionBy("bucket").option("parquet.block.size", GROUP_BYTES).parquet(folder.path)
    return folder


def write_answers(answers: DataFrame, name: str, shards: int = 0) -> Folder:
    return write_by_block(answers.select("block", "kind", "body"), name, shards)


class Answers:
    """Reads a block's rows of a folder in a task.

    A file's footer is parsed once: files stay open, the last ``OPEN`` buckets of them,
    and the row groups of a block are found by bisection, as files are sorted by block.
    """

    OPEN = 8

    def __init__(self, folder: Folder):
        self.fs, self.path = shared.store(folder.path)
        self.buckets = folder.buckets
        self.open: OrderedDict[int, list[tuple[pq.ParquetFile, list[int], list[int]]]] = OrderedDict()

    def _bucket(self, bucket: int) -> list[tuple[pq.ParquetFile, list[int], list[int]]]:
        """The bucket's files, with the least and the largest block of each row group."""
        if bucket in self.open:
            self.open.move_to_end(bucket)
            return self.open[bucket]
        files = []
        for file in self.fs.get_file_info(pafs.FileSelector(f"{self.path}/bucket={bucket}", allow_not_found=True)):
            if file.path.endswith(".parquet"):
                own = pq.ParquetFile(self.fs.open_input_file(file.path))
                at = own.schema_arrow.get_field_index("block")
                seen = [own.metadata.row_group(g).column(at).statistics for g in range(own.metadata.num_row_groups)]
                files.append((own, [x.min for x in seen], [x.max for x in seen]))
        self.open[bucket] = files
        if len(self.open) > self.OPEN:
            for own, *_ in self.open.popitem(last=False)[1]:
                own.close(force=True)
        return files

    def table(self, block: int, columns: list[str]) -> pa.Table | None:
        """The block's rows; None for a block without any."""
        out = []
        for own, least, most in self._bucket(block % self.buckets):
            first, end = bisect_left(most, block), bisect_right(least, block)
            if first < end:
                rows = own.read_row_groups(list(range(first, end)), [*columns, "block"])
                out.append(rows.filter(pc.equal(rows.column("block"), block)).select(columns))
        return pa.concat_tables(out) if out else None

    def rows(self, block: int, columns: list[str]) -> list[tuple]:
        table = self.table(block, columns)
        return list(zip(*(table.column(c).to_pylist() for c in columns), strict=True)) if table else []

    def of(self, block: int) -> dict[int, list[bytes]]:
        """kind -> bodies."""
        out: dict[int, list[bytes]] = {}
        for kind, body in self.rows(block, ["kind", "body"]):
            out.setdefault(kind, []).append(body)
        return out
