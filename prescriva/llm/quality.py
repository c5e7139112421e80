"""Quality by the perplexity of an interpolated modified Kneser-Ney model (operator 3).

The model is an n-gram model of order 4 over whole bytes, trained on trusted text:
documents labelled of good quality. Other alphabets, such as 64 classes of bytes (small
letters, capitals as one, digits as one, some marks, the bytes of other scripts), can be given. Counts are sharded and joined: each block of
documents sends the distinct n-grams of its texts with their trusted counts; these are
summed by n-gram; continuation counts, discounts (from the counts of counts), context
totals and interpolated probabilities of all orders are made by group-bys and joins of
these tables; and each block gets the log probability of its own n-grams back, from
which it makes each document's perplexity. Texts are never shuffled, and no table of
n-grams is collected.

A document is kept when its perplexity is at most its language's threshold: the
``quantile`` of the perplexities of trusted documents in that language. A language
without trusted documents uses the quantile over all.

Defined results: a null or empty text has no perplexity (null) and is not kept; a null
language is a language of its own; labels of unknown documents and null labels are left
out, and a document is trusted when any of its labels is 1; rows with the same doc_id
are scored one by one; without trusted text all are uniform and kept; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.llm import shared, sharded
from prescriva.llm.wordhash import text_bytes
from prescriva.operators.quantiles import order_statistics

ORDER = 4
QUANTILE = 0.995
#: Tables of at most so many rows are sent to all tasks.
SENT = 64**3
#: Entries that a block's n-grams may have before they are added up.
PENDING = 1 << 22


class Alphabet(NamedTuple):
    """Byte -> symbol from 1; 0 stands before a text. ``size`` is what a symbol is uniform over."""

    symbols: np.ndarray
    bits: int
    size: int


def _classes() -> np.ndarray:
    """Byte -> class from 1 to 63; 0 stands before a text."""
    out = np.full(256, 31, dtype=np.uint32)
    out[97:123] = np.arange(1, 27)
    out[65:91] = 27
    out[48:58] = 28
    out[[9, 11, 12, 13, 32]] = 29
    out[10] = 30
    for i, c in enumerate(b".,'\"-!?:;()"):
        out[c] = 32 + i
    out[128:192] = 43 + np.arange(64) % 16
    out[192:256] = 61
    out[[194, 195]] = 59, 60
    return out


_CLASS = _classes()
CLASSES = Alphabet(_CLASS, 6, 64)
BYTES = Alphabet(np.arange(1, 257, dtype=np.uint32), 9, 256)


def grams(column: pa.Array, alphabet: Alphabet) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram that ends at each byte, bytes of each text), for runs of texts of about a MB."""
    data, offsets = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1)
        sizes = np.diff(offsets[i : j + 1])
        part = alphabet.symbols[data[offsets[i] : offsets[j]]].astype(np.int64)
        code = part.copy()
        within = np.arange(len(part)) - np.repeat(offsets[i:j] - offsets[i], sizes)
        for k in range(1, ORDER):
            code[k:] |= np.where(within[k:] >= k, part[:-k] << (alphabet.bits * k), 0)
        yield code, sizes
        i = j


def trusted_rows(ready: DataFrame, labels: DataFrame, shards: int) -> sharded.Folder:
    """A folder that tells each block the rows of its trusted documents."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return sharded.write_by_block(ready.select("doc_id", "block", "row").join(good, "doc_id").select("block", "row"), "trusted", shards)


class _Trusted:
    def __init__(self, path: sharded.Folder):
        self.answers, self.block, self.rows = sharded.Answers(path), None, set()

    def of(self, block: int, batch: pa.RecordBatch) -> np.ndarray:
        if block != self.block:
            self.block, self.rows = block, {r for (r,) in self.answers.rows(block, ["row"])}
        return np.array([r in self.rows for r in batch.column("row").to_pylist()], dtype=bool)


def block_grams(ready: DataFrame, trusted: sharded.Folder, alphabet: Alphabet) -> DataFrame:
    """(block, gram, n): distinct n-grams of each block's texts and their count in trusted ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, now = _Trusted(trusted), None
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            return sharded.summed(*(np.concatenate([x[i] for x in parts]) for i in (0, 1)))

        def flush() -> Iterator[pa.RecordBatch]:
            own, n = added() if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
            parts.clear()
            for s in range(0, len(own), 1 << 17):
                part = own[s : s + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now, dtype=np.int64)), pa.array(part), pa.array(n[s : s + (1 << 17)])], names=["block", "gram", "n"])

        for block, batch in sharded.by_block(batches):
            if now is not None and block != now:
                yield from flush()
            now, good, at = block, marks.of(block, batch), 0
            for code, sizes in grams(batch.column("text"), alphabet):
                own = np.repeat(good[at : at + len(sizes)], sizes)
                other = np.unique(code[~own])
                parts += [np.unique(code[own], return_counts=True), (other, np.zeros(len(other), np.int64))]
                at += len(sizes)
                if sum(len(x) for x, _ in parts) > PENDING:
                    parts[:] = [added()]
        if now is not None:
            yield from flush()

    return ready.mapInArrow(run, "block long, gram long, n long")


def _discounts(table: DataFrame) -> list[float]:
    """D1, D2 and D3+ of an order, by the counts of counts; each stays between 0 and its count."""
    n1, n2, n3, n4 = (x or 0 for x in table.agg(*(F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4))).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    more = [(1, n1, n2), (2, n2, n3), (3, n3, n4)]
    return [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else 0.5 for k, a, b in more]


def _discount(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def orders(counts: DataFrame, alphabet: Alphabet) -> list[tuple[DataFrame, DataFrame, list[float]]]:
    """For the orders 1 to ORDER: (gram, c), (context, total, gamma) and the discounts. ``counts``: (gram, c), c > 0."""
    table, bits, out = counts, alphabet.bits, []
    for k in range(ORDER, 0, -1):
        if k < ORDER:
            below = table.select((F.col("gram").bitwiseAND((1 << (bits * k)) - 1)).alias("gram"))
            table = shared.written(below.groupBy("gram").agg(F.count(F.lit(1)).alias("c")), "grams")
        d = _discounts(table)
        few = [F.sum((F.col("c") == j).cast("long")) * d[j - 1] for j in (1, 2)] + [F.sum((F.col("c") >= 3).cast("long")) * d[2]]
        contexts = table.groupBy(F.shiftright("gram", bits).alias("context")).agg(F.sum("c").alias("total"), (few[0] + few[1] + few[2]).alias("kept_back"))
        out.append((table, contexts.select("context", "total", (F.col("kept_back") / F.col("total")).alias("gamma")), d))
    return out[::-1]


def log_probabilities(wanted: DataFrame, counts: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(gram, logp): log10 of the interpolated probability of the last class after the others, for each wanted ``gram``."""
    p = wanted.select("gram", F.lit(1.0 / alphabet.size).alias("p"))
    for k, (table, contexts, d) in enumerate(orders(counts, alphabet), start=1):
        own = F.col("gram").bitwiseAND((1 << (alphabet.bits * k)) - 1)
        p = p.withColumn("own", own).withColumn("context", F.shiftright("own", alphabet.bits))
        # An order has at most (size + 1)**k n-grams, whatever the corpus; small ones are sent to all tasks. Of the others a key has at most (size + 1)**(ORDER - rank) rows, so that none is frequent.
        sent = lambda df, rank: F.broadcast(df) if alphabet.size**rank <= SENT else df
        p = p.join(sent(table.select(F.col("gram").alias("own"), "c"), k), "own", "left").join(sent(contexts, k - 1), "context", "left")
        direct = F.coalesce((F.col("c") - _discount(F.col("c"), d)) / F.col("total"), F.lit(0.0))
        p = p.select("gram", F.when(F.col("total").isNull(), F.col("p")).otherwise(direct + F.col("gamma") * F.col("p")).alias("p"))
    return p.select("gram", F.log10("p").alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame, alphabet: Alphabet = CLASSES) -> DataFrame:
    """(doc_id, lang, trusted, perplexity) of each row of ``docs`` (doc_id, text, lang)."""
    docs = sharded.from_files(docs)
    ready = sharded.with_blocks(docs, ["doc_id", "text", "lang"])
    shards = sharded.shards_of(docs)
    trusted = trusted_rows(ready, labels, shards)
    asked = shared.written(block_grams(ready.select("text", "block", "row"), trusted, alphabet), "asked")
    summed = asked.groupBy("gram").agg(F.sum("n").alias("c"))
    summed = shared.written(summed, "grams")
    known = shared.written(log_probabilities(summed.select("gram"), summed.where("c > 0"), alphabet), "logp")
    path = sharded.write_by_block(asked.select("block", "gram").join(known, "gram").select("block", "gram", F.col("logp").cast("float")), "answers", shards)
    for table in (asked, summed, known):
        shared.drop_table(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, answers, now = _Trusted(trusted), sharded.Answers(path), None
        for block, batch in sharded.by_block(batches):
            if block != now:
                now, own = block, answers.table(block, ["gram", "logp"])
                keys, logp = (own.column(c).to_numpy() for c in ("gram", "logp")) if own else (np.empty(0, np.int64), np.empty(0, np.float32))
                order = np.argsort(keys)
                keys, logp = keys[order], logp[order]
            out = []
            for code, sizes in grams(batch.column("text"), alphabet):
                total = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(keys, code)], dtype=np.float64)])
                ends = np.cumsum(sizes)
                out.append(np.where(sizes > 0, 10 ** -((total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)), np.nan))
            value = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(marks.of(block, batch)), pa.array(value, mask=np.isnan(value))], names=["doc_id", "lang", "trusted", "perplexity"])

    return ready.mapInArrow(run, "doc_id long, lang string, trusted boolean, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, alphabet: Alphabet = CLASSES) -> DataFrame:
    """(doc_id, perplexity, threshold, kept) of each row of ``docs``."""
    scored = shared.written(perplexities(docs, labels, alphabet), "perplexity")
    good = scored.where("trusted and perplexity is not null")
    # The least perplexity that so many of the trusted ones don't exceed, exactly.
    rank = lambda n: [max(math.ceil(quantile * n) - 1, 0)]
    limit = lambda by: {group: next(iter(values.values())) for (group, _), (_, values) in order_statistics(good, ["perplexity"], rank, by).items()}
    by_language = docs.sparkSession.createDataFrame(list(limit("lang").items()), "of string, own double")
    common = limit(None).get("")
    out = scored.join(F.broadcast(by_language), F.col("lang").eqNullSafe(F.col("of")), "left")  # a row for each language with trusted rows
    threshold = F.coalesce("own", F.lit(common).cast("double"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexities of all ``documents`` under the trusted ones, and which are kept; over whole bytes."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), alphabet=BYTES)
