"""Folders that driver and executors share, and small helpers all operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and all of Spark runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.prescriva.localWork", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="prescriva-")
            spark.conf.set("spark.prescriva.localWork", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root else "file://" + root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is made there yet."""
    return f"{shared_root(spark).rstrip('/')}/prescriva-{name}-{uuid.uuid4().hex[:12]}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a path that ``shared_dir`` gave, on whatever store it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """For jobs that write a table: their shuffle files go when the table is complete, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession, name)
    with step(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, usable in tasks as on the driver."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file:///" + uri.removeprefix("file:").lstrip("/"))


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers live on, and what one stage needed shouldn't be missing in the next."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def commit(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name; if another attempt of the same task has done so, its bytes are the same and stay."""
    try:
        fs.move(temporary, final)
    except OSError:
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(temporary)


def remove_unfinished(directory: str) -> None:
    """Delete what attempts that were lost have left: files whose names begin with an underscore."""
    fs, path = store(directory)
    for file in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if file.base_name.startswith("_"):
            fs.delete_file(file.path)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts; a null is the empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def crc_mod(column: str, n: int):
    """crc32 of the id written as text (a null id: the empty text), modulo n."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Rows and bytes in an Arrow batch: whole texts can be long, so that a batch stays at some MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def small_enough(df: DataFrame, size: Column, most: int) -> bool:
    """Whether the rows of ``df``, of ``size`` bytes each, may be sent to all tasks: at most ``most`` bytes, with 32 more for each row."""
    total = df.agg(F.sum(size + 32)).first()[0]
    return (total or 0) <= most


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        remove_dir(df.sparkSession, files[0].rsplit("/", 1)[0])
