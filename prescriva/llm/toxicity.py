"""Toxicity by a convolutional text classifier in numpy (operator 2).

Words (runs of letters and digits, ASCII capitals folded) and their first 4, 6 and 8
bytes are hashed into a fixed number of embedding rows; a word's embedding is the sum
of these four, so that inflected forms of a word share most of it. Filters of widths 1, 2 and 3 slide over the whole text, each
filter's largest response is kept, and a logistic layer gives the score. It is trained
on the driver with Adam on a bounded sample of labelled rows: the ``sample`` rows with
the smallest hash of id, language and text (equal rows count once), whole texts, already
reduced to bucket numbers by the executors. A small sample is read as often as it takes
to make ``LEAST_STEPS`` steps. Scoring sends the fixed-size model to the tasks and needs
no shuffle. The trained weights are rounded to multiples of 2**-``GRID``: every sum and
product of a score is then exact in doubles, so that a text's score is the same bits
alone, in any batch and after any shuffle.

Thresholds are calibrated by language on all labelled rows outside the sample; a quarter
of the rows, by a hash, is never in it. They are scored where they are, and counted by
language and ten-thousandths of the score. A language's threshold is the lowest of these
steps with rows at which at least ``precision`` of its rows at or above it are labelled
toxic, but not below ``lowest``. A language without toxic rows there uses the threshold
of all rows. The language only chooses the threshold of ``flagged``; it is no input of
the score.

Defined results: a null or empty text gets the score of a text without words (the
logistic layer's bias, as no filter responds); rows are independent, so ties, repeated
rows and other columns change nothing; labels of unknown documents or null labels are
left out; without any labelled row every score is 0; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from prescriva.llm import shared
from prescriva.llm.wordhash import NOT_ALNUM, word_hashes

WIDTHS = (1, 2, 3)
PREFIXES = (4, 6, 8)
#: Steps of the score between 0 and 1 at which thresholds may lie.
BINS = 10_000
#: Trained weights are multiples of 2**-GRID; a score's sums stay exact in 53 bits.
GRID = 10
LEAST_STEPS = 300


def bucket_runs(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of documents as rows of bucket numbers, a row for each word, with max(WIDTHS) rows of zeros behind each document; and where each document begins."""
    pad = max(WIDTHS)
    for hashes, counts in word_hashes(column, NOT_ALNUM, 1 << 18, PREFIXES):
        starts = np.concatenate([[0], np.cumsum(counts + pad)])
        row = np.zeros((starts[-1], 1 + len(PREFIXES)), dtype=np.int32)
        at = np.arange(len(hashes)) + np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)
        row[at] = hashes % np.uint64(buckets - 1) + np.uint64(1)
        yield row, starts[:-1]


@dataclass
class TextCnn:
    """Hashed embeddings, filters, and a logistic layer; row 0 of the embeddings pads and stays 0."""

    buckets: int = 1 << 15
    dim: int = 12
    filters: int = 12
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            self.weights = {"embed": rng.normal(0, 0.3, (self.buckets, self.dim)).astype(np.float32)}
            self.weights["embed"][0] = 0
            for w in WIDTHS:
                self.weights[f"filter{w}"] = rng.normal(0, (w * self.dim) ** -0.5, (w * self.dim, self.filters)).astype(np.float32)
                self.weights[f"bias{w}"] = np.full(self.filters, -0.1, np.float32)
            self.weights["out"] = rng.normal(0, 0.1, len(WIDTHS) * self.filters).astype(np.float32)
            self.weights["out_bias"] = np.full(1, -2.0, np.float32)

    @staticmethod
    def _windows(x: np.ndarray, width: int) -> np.ndarray:
        """Rows of ``width`` words side by side; the last rows run into padding."""
        if width == 1:
            return x
        padded = np.concatenate([x, np.zeros((width - 1, x.shape[1]), x.dtype)])
        return np.lib.stride_tricks.as_strided(padded, (len(x), width * x.shape[1]), (padded.strides[0], padded.strides[1]))

    def _responses(self, x: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """Each filter at each window; windows that begin behind a document and reach into the next one never win."""
        z = self._windows(x, width) @ self.weights[f"filter{width}"]
        ends = np.append(starts[1:], len(x))
        for k in range(1, width):
            z[ends - k] = -np.inf
        return z

    def _embed(self, row: np.ndarray) -> np.ndarray:
        return sum(self.weights["embed"][row[:, k]] for k in range(row.shape[1]))

    def logits(self, row: np.ndarray, starts: np.ndarray) -> np.ndarray:
        p = self.weights
        x = self._embed(row)
        pooled = [np.maximum(np.maximum.reduceat(self._responses(x, starts, w), starts, axis=0) + p[f"bias{w}"], 0) for w in WIDTHS]
        return np.concatenate(pooled, axis=1) @ p["out"] + p["out_bias"][0]

    def exact(self) -> TextCnn:
        """The same model with weights on the grid, in doubles."""
        return replace(self, weights={k: np.rint(v.astype(np.float64) * 2**GRID) / 2**GRID for k, v in self.weights.items()})

    def scores(self, column: pa.Array) -> np.ndarray:
        parts = [self.logits(row, starts) for row, starts in bucket_runs(column, self.buckets)]
        logits = np.concatenate(parts).astype(np.float64) if parts else np.empty(0)
        return np.round(1 / (1 + np.exp(-np.clip(logits, -50, 50))), 6)

    def gradient(self, row: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, x, n = self.weights, self._embed(row), len(starts)
        lengths = np.diff(np.append(starts, len(row)))
        owner = np.repeat(np.arange(n), lengths)
        pooled, tops = [], []
        for w in WIDTHS:
            z = self._responses(x, starts, w)
            best = np.maximum.reduceat(z, starts, axis=0)
            at = np.full(best.shape, -1, dtype=np.int64)
            r, c = np.nonzero(z == best[owner])
            at[owner[r], c] = r
            pooled.append(np.maximum(best + p[f"bias{w}"], 0))
            tops.append(at)
        h = np.concatenate(pooled, axis=1)
        error = (1 / (1 + np.exp(-np.clip(h @ p["out"] + p["out_bias"][0], -50, 50))) - labels) / n
        g = {"out": h.T @ error, "out_bias": np.array([error.sum()], np.float32)}
        touched, d_embed = [], []
        for k, w in enumerate(WIDTHS):
            part = slice(k * self.filters, (k + 1) * self.filters)
            dz = np.outer(error, p["out"][part]) * (pooled[k] > 0)
            doc, col = np.nonzero(dz)
            value, at = dz[doc, col].astype(np.float32), tops[k][doc, col]
            words = np.minimum(at[:, None] + np.arange(w), len(row) - 1)
            live = (at[:, None] + np.arange(w) < len(row)).astype(np.float32)[:, :, None]
            seen = (x[words] * live).reshape(len(at), w * self.dim)
            g[f"filter{w}"], g[f"bias{w}"] = np.zeros_like(p[f"filter{w}"]), np.bincount(col, value, self.filters).astype(np.float32)
            np.add.at(g[f"filter{w}"].T, col, seen * value[:, None])
            d_embed.append(np.repeat((p[f"filter{w}"].T[col] * value[:, None]).reshape(-1, self.dim), row.shape[1], axis=0))
            touched.append(row[words].ravel())
        g["rows"], inverse = np.unique(np.concatenate(touched), return_inverse=True)
        g["embed"] = np.zeros((len(g["rows"]), self.dim), np.float32)
        np.add.at(g["embed"], inverse, np.concatenate(d_embed))
        return g

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, dropout: float = 0.1) -> TextCnn:
        """Adam over shuffled batches, at least ``epochs`` times and LEAST_STEPS steps; ``dropout`` of the words of a batch are hidden, and three tenths keep only their beginnings, so that no rare word decides alone."""
        rng, pad = np.random.default_rng(self.seed), max(WIDTHS)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        epochs = max(epochs, -(-LEAST_STEPS // max(1, -(-len(docs) // batch))))
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                starts = np.concatenate([[0], np.cumsum([len(docs[i]) + pad for i in own])])
                row = np.zeros((starts[-1], 1 + len(PREFIXES)), np.int32)
                for s, i in zip(starts, own, strict=False):
                    row[s : s + len(docs[i])] = docs[i]
                row[rng.random(len(row)) < dropout] = 0
                row[rng.random(len(row)) < 0.3, 0] = 0
                g = self.gradient(row, starts[:-1], labels[own].astype(np.float32))
                rows, step = g.pop("rows"), step + 1
                for k, d in g.items():
                    where = rows if k == "embed" else slice(None)
                    m[k][where] += 0.1 * (d - m[k][where])
                    v2[k][where] += 0.001 * (d * d - v2[k][where])
                    self.weights[k][where] -= rate * (m[k][where] / (1 - 0.9**step)) / (np.sqrt(v2[k][where] / (1 - 0.999**step)) + 1e-8)
                self.weights["embed"][0] = 0
        return self


@dataclass
class ToxicityModel:
    cnn: TextCnn | None
    thresholds: dict[str | None, float]
    common: float = 0.5


def _cuts(counts: DataFrame, precision: float, lowest: float) -> tuple[dict[str | None, float], float]:
    """(threshold by language, threshold of all rows) of ``counts`` (lang, bin, n, toxic): where a cut at a bin lets in ``precision`` toxic rows."""
    both = F.explode(F.array(F.lit(False), F.lit(True)))
    own = counts.select("lang", "bin", "n", "toxic", both.alias("all")).withColumn("lang", F.when(~F.col("all"), F.col("lang")))
    own = own.groupBy("all", "lang", "bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    above = Window.partitionBy("all", "lang").orderBy(F.desc("bin"))
    right = F.sum("toxic").over(above) / F.sum("n").over(above)
    good = own.withColumn("good", (right >= precision) & (F.col("bin") >= F.lit(math.ceil(lowest * BINS - 1e-9))))
    found = good.groupBy("all", "lang").agg(F.min(F.when(F.col("good"), F.col("bin"))).alias("cut"), F.sum("toxic").alias("toxic")).where("toxic > 0")
    cuts = {(r["all"], r["lang"]): 0.5 if r["cut"] is None else r["cut"] / BINS for r in found.collect()}
    return {lang: t for (whole, lang), t in cuts.items() if not whole}, cuts.get((True, None), 0.5)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, precision: float = 0.9, lowest: float = 0.3) -> ToxicityModel:
    """Train on at most ``sample`` labelled rows, and calibrate on all others. ``docs``: doc_id, text, lang; ``labels``: doc_id, toxic."""
    shared.small_batches(docs.sparkSession)
    buckets = TextCnn.buckets
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", F.col("lang").isNull(), "lang", "text").alias("h"))
    kept_out = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(4)) == 0

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = max(WIDTHS)
        for batch in batches:
            out = []
            for row, starts in bucket_runs(batch.column("text"), buckets):
                out += [x[:-pad].astype(np.uint16).tobytes() for x in np.split(row, starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())], names=["doc_id", "toxic", "words"])

    def first(pool: DataFrame) -> tuple[DataFrame, pa.Table]:
        """The ``sample`` rows with the smallest hashes (equal rows count once), and their words."""
        chosen = shared.written(pool.join(marked, "doc_id").orderBy("h", "doc_id").limit(sample), "sample")
        rows = hashed.select("doc_id", "h", "text").join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
        return chosen, rows.select("doc_id", "toxic", "text").mapInArrow(reduce, "doc_id long, toxic int, words binary").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])

    keys = hashed.select("doc_id", "h").distinct()
    chosen, got = first(keys.where(~kept_out))
    if not got.num_rows:
        # Too few rows to keep any out: they are learned from and calibrated on.
        chosen, got = first(keys)
        chosen = chosen.limit(0)
    if not got.num_rows:
        return ToxicityModel(None, {})
    words = [np.frombuffer(x, dtype=np.uint16).astype(np.int32).reshape(-1, 1 + len(PREFIXES)) for x in got.column("words").to_pylist()]
    cnn = TextCnn().fit(words, (got.column("toxic").to_numpy() > 0).astype(np.int64)).exact()

    scored = score(hashed, ToxicityModel(cnn, {}), ["doc_id", "lang", "h"])
    outside = scored.join(F.broadcast(chosen.select("doc_id", "h")), ["doc_id", "h"], "left_anti")
    # Scores have six decimals, so that their bins are exact. Rows of an id are counted before they meet its label: no id is hot.
    bins = F.floor(F.round(F.col("toxicity") * 1e6) / (1_000_000 // BINS))
    counts = outside.groupBy("doc_id", "lang", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).join(marked, "doc_id")
    counts = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("toxic"))
    return ToxicityModel(cnn, *_cuts(counts, precision, lowest))


def score(docs: DataFrame, model: ToxicityModel, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with ``toxicity`` (double) and ``flagged`` (score at or above its language's threshold); columns of these names are replaced."""
    shared.small_batches(docs.sparkSession)
    kept = [c for c in (columns or docs.columns) if c not in ("toxicity", "flagged")]
    schema = StructType([docs.schema[c] for c in kept] + [StructField("toxicity", DoubleType()), StructField("flagged", BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            s = m.cnn.scores(batch.column("text")) if m.cnn else np.zeros(batch.num_rows)
            at = np.array([m.thresholds.get(x, m.common) for x in batch.column("lang").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(s), pa.array((s >= at) & (m.cnn is not None))], names=[*kept, "toxicity", "flagged"])
        shared.give_back()

    source = docs.select(*kept, *[c for c in ("text", "lang") if c not in kept])
    return source.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = shared.crc_mod("doc_id", 5) != 0
    model = fit(docs.where(learn), labels.where(learn))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", (~learn).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "flagged")
