"""Documents into shards of about equal bytes, by longest-processing-time scheduling of groups that stay together.

A group is all rows of one text (a null text is the empty one); its weight is their
bytes. The schedule takes groups from the heaviest to the lightest and gives each to the
shard with the fewest bytes so far, the lowest of equal ones. Groups of one weight are
alike to it, so all that it needs is how many groups there are of each weight: distinct
weights w1 < w2 < ... of T bytes in all number at most sqrt(2 T), 14 million for 100 TB,
whatever the number of groups, and a heap of shards works through them on the driver.
Where very many groups share a weight, all their turns are counted at once.

Groups, places and rows are then joined and sorted on Spark. Which of the equally heavy
groups goes where, and where in its shard a row stands, follows from positions in global
orders, so that no task holds a group, a weight or a shard. Only (doc_id, size, checksum,
digest) are shuffled; ``write`` alone moves texts.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prescriva.llm import shared
from prescriva.operators.ranks import positions

SHARDS = 24
#: Bytes that a document has besides its text's.
ROW_BYTES = 8
#: The schedule is sent to all tasks up to so many bytes, and joined beyond.
SENT_MOST = 8 << 20


def turns(loads: list[int], weight: int, count: int) -> list[int]:
    """How many of ``count`` groups of one weight each shard gets, one after another to the least loaded; ``loads`` is brought up to date."""
    n = len(loads)
    got = [0] * n
    if count > 8 * n:
        # Shard i has its k-th turn when it holds loads[i] + k * weight: all turns below the highest level that isn't too many.
        below = lambda level: [max(0, -(-(level - x) // weight)) for x in loads]
        low, high = min(loads), max(loads) + weight * (count + 1)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
        got = below(low)
    heap = [(x + k * weight, i) for i, (x, k) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        load, i = heap[0]
        heapq.heapreplace(heap, (load + weight, i))
        got[i] += 1
    for i, k in enumerate(got):
        loads[i] += k * weight
    return got


def schedule(histogram: list[tuple[int, int]], shards: int) -> pa.Table:
    """(weight, first, shards, upto) of (weight, groups) pairs, heaviest first.

    ``first``: groups that are heavier. Of the groups of a weight the first ``upto[0]``
    go to ``shards[0]``, those up to ``upto[1]`` to ``shards[1]`` and so on.
    """
    loads, first, rows = [0] * shards, 0, []
    for weight, count in histogram:
        got = turns(loads, weight, count)
        at, of, upto = 0, [], []
        for i, k in enumerate(got):
            if k:
                at += k
                of.append(i)
                upto.append(at)
        rows.append((weight, first, of, upto))
        first += count
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["weight", "first", "shards", "upto"])


def _digest(text):
    return F.unhex(F.md5(text.cast("binary")))


def _text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def group_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(digest, n, shard) of each group of ``rows`` (digest, size); an empty table has none."""
    spark = rows.sparkSession
    groups = rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"))
    ranked = positions(groups, [F.desc("weight"), "digest"], "rank")
    # At most sqrt(2 T) rows for T bytes of documents.
    histogram = ranked.groupBy("weight").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("weight")).toArrow()
    plan = schedule(list(zip(histogram["weight"].to_pylist(), histogram["groups"].to_pylist(), strict=True)), shards)
    plan_df = spark.createDataFrame(plan, "weight long, first long, shards array<int>, upto array<long>")
    plan_df = F.broadcast(plan_df) if plan.nbytes <= SENT_MOST else plan_df
    turn = F.col("rank") - F.col("first")
    place = F.get("shards", F.size(F.filter("upto", lambda u: u <= turn)))
    return ranked.join(plan_df, "weight").select("digest", "n", place.alias("shard"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of ``docs`` (doc_id, text; other columns are not looked at).

    ``slot`` numbers a shard's rows from 0 in the order of the digests of their texts and
    then of doc_id, null ones first. Null and empty texts are one group of 8 bytes a row;
    rows that repeat are rows of their own, with slots of their own.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = _text()
    rows = shared.written(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _digest(text).alias("digest"), F.monotonically_increasing_id().alias("_row")), "sizes")
    groups = shared.written(group_shards(rows, shards), "groups")
    placed = rows.join(groups.select("digest", "shard"), "digest")
    ordered = positions(placed, ["shard", "digest", "doc_id", "_row"], "at", ["doc_id", "size", "text_crc32", "shard"])
    counts = groups.groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))  # a row for each shard
    return ordered.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("start")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """``docs`` with all their columns as Parquet below ``path``/shard=N, rows of a shard in the order of their slots.

    A shard's files are ranges of its rows, so that no task writes a whole shard; names
    sort as the rows do. Columns of ``docs`` that are named ``shard`` or begin with ``_`` are an error.
    """
    taken = [c for c in docs.columns if c == "shard" or c.startswith("_")]
    if taken:
        raise ValueError(f"columns {', '.join(taken)} clash with those of the shards")
    text = _text()
    sized = docs.select((F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), _digest(text).alias("digest"))
    groups = shared.written(group_shards(sized, shards), "groups").select(F.col("digest").alias("_digest"), "shard")
    own = docs.withColumns({"_digest": _digest(text), "_row": F.monotonically_increasing_id()}).join(groups, "_digest")
    order = ["shard", "_digest", "doc_id", "_row"]
    with shared.step(docs.sparkSession):
        own.repartitionByRange(*order).sortWithinPartitions(*order).drop("_digest", "_row").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by the law of equal bytes."""
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same schedule step by step: a list of loads goes from group to group. crc32 is worked out byte by byte from the table of its polynomial.
SQL = f"""WITH RECURSIVE t(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS crc FROM t WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS x, octet_length(encode(coalesce(text, ''))) + {ROW_BYTES} AS size, md5(coalesce(text, '')) AS digest FROM documents),
g AS (SELECT digest, weight, ROW_NUMBER() OVER (ORDER BY weight DESC, digest) AS i, ROW_NUMBER() OVER (PARTITION BY weight ORDER BY digest) AS turn FROM (SELECT digest, SUM(size)::BIGINT AS weight FROM d GROUP BY digest)),
r AS (SELECT 0::BIGINT AS i, -1::BIGINT AS weight, 0::BIGINT AS shard, [0::BIGINT FOR j IN range({SHARDS})] AS loads
UNION ALL SELECT g.i, g.weight, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + g.weight ELSE v END) FROM r JOIN g ON g.i = r.i + 1),
p AS (SELECT weight, shard, ROW_NUMBER() OVER (PARTITION BY weight ORDER BY shard) AS turn FROM r WHERE i > 0),
c AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h[2 * j + 1 : 2 * j + 2])::BIGINT FOR j IN range(octet_length(encode(x)))]), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM (SELECT DISTINCT x, hex(encode(x)) AS h FROM d), tab)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN g USING (digest) JOIN p USING (weight, turn) JOIN c USING (x)"""
