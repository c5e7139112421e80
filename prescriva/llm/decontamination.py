"""Benchmark decontamination by a size-partitioned MinHash containment search (operator 7).

An item is contained in a document when at least ``threshold`` of the item's distinct
shingles (five words each) occur in the document, however long that is. Bands of a
fixed-length MinHash signature can't see a 15-word item in a 20,000-word document, as
their chance depends on the Jaccard similarity, which is near 0. The search therefore
keeps, of each item, its bottom-k MinHash sketch, and k follows from the item's size
partition (sizes up to 8, 16, 32, ... shingles): with u the partition's largest size,
k = u - ceil(threshold * u) + 1. A document that contains the item lacks fewer than k of
its shingles, so it holds one of these k: the search misses nothing. Candidates are
verified by exact containment on the shingles' words.

All of it is DataFrame functions: a document's shingle hashes are exploded and meet the
index of sketches. Whatever is sent to all tasks (the index, the items' lists, the
documents found) is sized by its own bytes first, and both sides are shuffled where it
has more than ``broadcast_bytes``. A shingle of many items and documents, as of a
licence, is one row for each item that has it: in the shuffle join AQE splits it.
Only candidates are read again for the verification.

Words are runs of letters and digits in small letters. Defined results: null or empty
texts, and items or documents of fewer than five words, contain nothing and are
contained in nothing; copies of an item are items of their own; rows that share a
doc_id (null is an id like others) are tested one by one, and the id has the largest
containment of them; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prescriva.llm import sharded, shared

WORDS = 5
THRESHOLD = 0.8
BROADCAST_BYTES = 24 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _windows(array: str, of) -> Column:
    """``of`` applied to each run of WORDS neighbours in the array column; empty where it is shorter."""
    indexes = F.sequence(F.lit(0), F.size(array) - WORDS)
    return F.when(F.size(array) >= WORDS, F.transform(indexes, lambda i: of([F.get(F.col(array), i + k) for k in range(WORDS)])))


def shingle_hashes(array: str) -> Column:
    return _windows(array, lambda w: F.xxhash64(*w))


def shingle_texts(array: str) -> Column:
    return F.array_distinct(_windows(array, lambda w: F.concat_ws(" ", *w)))


def _needed(size: Column, threshold: float) -> Column:
    """The smallest count that is ``threshold`` of ``size``."""
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, hash): the bottom-k MinHash sketch of each item, k by size partition."""
    split = items.select("item_id", words(F.col("text")).alias("w"))
    hashes = split.select("item_id", F.explode(shingle_hashes("w")).alias("hash")).distinct()
    one = Window.partitionBy("item_id")
    sized = hashes.withColumn("size", F.count(F.lit(1)).over(one)).withColumn("rank", F.row_number().over(one.orderBy(F.xxhash64("hash"), "hash")))
    largest = F.greatest(F.lit(8.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size").cast("double")))))
    return sized.where(F.col("rank") <= largest - _needed(largest, threshold) + 1).select("item_id", "hash")


def _sent(df: DataFrame, size: Column, most: int) -> DataFrame:
    """``df`` for a join: sent to all tasks if its rows, of ``size`` bytes each, are at most ``most`` bytes, and shuffled otherwise."""
    return F.broadcast(df) if shared.small_enough(df, size, most) else df.hint("merge")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of all documents (doc_id, text) that contain items (item_id, text); ``by`` has the columns that name a document."""
    index = shared.written(sketches(items, threshold), "index")
    split = docs.select(*by, words(F.col("text")).alias("w"))
    exploded = split.select(*by, F.explode(shingle_hashes("w")).alias("hash"))
    met = exploded.join(_sent(index, F.lit(16), broadcast_bytes), "hash")
    candidates = met.select(*by, "item_id").distinct()
    candidates = shared.written(candidates, "candidates")

    lists = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", shingle_texts("w").alias("item_list")).where(F.size("item_list") > 0)
    bytes_of = F.aggregate("item_list", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    pairs = candidates.join(_sent(lists, bytes_of, broadcast_bytes), "item_id")
    pairs = pairs.withColumnsRenamed({c: f"candidate_{c}" for c in by})
    found = candidates.select(*(F.col(c).alias(f"candidate_{c}") for c in by)).distinct()
    found = _sent(found, F.lit(16 * len(by)), broadcast_bytes)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"candidate_{c}")) for c in by))
    # Few documents are candidates; only those are shuffled to their pairs, as words.
    again = docs.select(*by, "text").join(found, same, "left_semi")
    again = again.select(*by, words(F.col("text")).alias("w")).select(*by, shingle_texts("w").alias("doc_list"))
    checked = again.join(pairs, same)
    counted = checked.select(*by, "item_id", F.size(F.array_intersect("doc_list", "item_list")).cast("long").alias("shared"), F.size("item_list").cast("long").alias("item_shingles"))
    kept = counted.where(F.col("shared") >= _needed(F.col("item_shingles"), threshold))
    best = kept.groupBy(*by, "item_id").agg(F.max(F.struct("shared", "item_shingles")).alias("m"))
    return best.select(*by, "item_id", "m.shared", "m.item_shingles", (F.col("m.shared") / F.col("m.item_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows that contain items, whatever other rows have their doc_id; the rows found are sent to all tasks only if they are few, and shuffled otherwise."""
    docs = sharded.from_files(docs)
    by = ("block", "row")
    found = contaminated(sharded.with_blocks(docs, ["text"]), items, broadcast_bytes=broadcast_bytes, by=by).select(*by).distinct()
    found = shared.written(found, "found")
    found = _sent(found, F.lit(32), broadcast_bytes)
    whole = docs.withColumn("whole", F.struct(*docs.columns))  # docs may have columns called block or row
    return sharded.with_blocks(whole, ["whole"]).join(found, [*by], "left_anti").select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` that contains an item of ``benchmark``, with the item."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, CAST(shared AS DOUBLE) / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE shared >= ceil(0.8 * item_shingles - 1e-9)
"""
