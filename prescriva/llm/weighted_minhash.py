"""MinHash near-duplicates by improved consistent weighted sampling (operator 8).

A text's shingles (five words each, by their fingerprints) have the weight
tf * (8 + idf) / 9 with idf = ln(1 + N / df) / ln(1 + N): what many texts share counts
less, but not so much less that the copies of a large group, whose common shingles are
frequent, would fall apart by their few own ones. df is exact and comes from
``sharded``. For each of ROWS * BANDS hash functions, improved consistent weighted
sampling picks one (shingle, level) of a text; two texts pick the same with a chance
that is their weighted Jaccard similarity. Some picks make a band; texts that share a
band meet if enough of all their picks are the same, and every link is verified by the
weighted Jaccard similarity of the whole texts. How many bands of how many picks, and how
many equal picks, follows from the threshold (``layout``): a pair at it shares a band with
a chance of 0.998, and is dropped for its picks with one of 0.0001. ``agree=0`` drops none.

Texts with the same shingles and counts are one class (a group-by that sums before its
shuffle); only classes meet. A band's classes are first compared with one of them, that
whose bands have most classes, in parts of some hundred for large bands. Where that
leaves a band in several components, those outside its largest one are compared with all
others: in small bands pair by pair, in large ones by blocks of rows against blocks of
rows in which a matrix product gives the similarities and only a forest of the links
comes out. So no link that could join two components is left out, and a group of copies
costs rows in proportion to its size.

Texts are never shuffled: tables in the shared folder tell each block of documents which
of its rows are to be compared with what, and only these rows' weights are sent.

Defined results: null and empty texts and those without words have no shingles, link
with nothing and stay; a text of one to four words has one shingle, all of them; rows
with the same doc_id are texts of their own; component_id is the smallest doc_id of the
component (a null one counts as largest); of each component one row stays: of its
smallest doc_id, and of rows that share that, the first in the files. An empty table
gives an empty one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.llm import shared, sharded
from prescriva.llm.components import components
from prescriva.llm.wordhash import NOT_ALNUM, mix, word_hashes

WORDS = 5
THRESHOLD = 0.8
#: Chances that a pair at the threshold shares no band, and that it is dropped for its picks.
UNMET, DROPPED = 0.002, 0.0001
MOST_ROWS, MOST_BANDS = 3, 64
#: A band with at most so many classes is compared across components pair by pair; a centre's fellows are compared in parts of so many.
SMALL, PART = 32, 400
#: Classes and shingles of one side of a block.
BLOCK, BLOCK_SHINGLES = 1000, 300_000
#: Of the weight, the part that depends on the document frequency.
IDF_SHARE = 1 / 9
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _gamma_quantiles(steps: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of equal steps, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(steps) + 0.5) / steps
    low, high = np.zeros(steps), np.full(steps, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_R = _gamma_quantiles()
_LOG_C = np.log(_R).astype(np.float32)
_INVERSE_R = (1 / _R).astype(np.float32)
_R = _R.astype(np.float32)


def shingles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints of shingles in their order, shingles of each text) for runs of texts."""
    for words, counts in word_hashes(column, NOT_ALNUM):
        n = len(words)
        first = np.cumsum(counts) - counts
        if n >= WORDS:
            rolled = words[: n - WORDS + 1].copy()
            for k in range(1, WORDS):
                rolled = rolled * _ODD + words[k : n - WORDS + 1 + k]
            rolled = mix(rolled)
        else:
            rolled = np.empty(0, dtype=np.uint64)
        sizes = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        starts = np.cumsum(sizes) - sizes
        out = np.empty(sizes.sum(), dtype=np.uint64)
        long = np.repeat(counts >= WORDS, sizes)
        at = np.arange(len(out)) + np.repeat(first - starts, sizes)
        out[long] = rolled[at[long]]
        for i in short:
            value = counts[i : i + 1].astype(np.uint64)
            for w in words[first[i] : first[i] + counts[i]]:
                value = value * _ODD + w
            out[starts[i]] = mix(value)[0]
        yield out, sizes


def _distinct(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles sorted within each text, times in it, distinct shingles of each text)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    return keys[starts], np.diff(np.append(starts, len(keys))), np.bincount(owner[starts], minlength=len(sizes))


def _count(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and the texts that have each."""
    parts = []
    for keys, sizes in shingles(batch.column("text")):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys = keys[new]
        parts.append(sharded.summed(keys, np.ones(len(keys), dtype=np.uint64)))
    return sharded.summed(*map(np.concatenate, zip(*parts, strict=True)))


def _reply(shard: int, rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Tells each block which of its shingles several texts have (48 bits of each), and how many."""
    bodies = [(block, *sharded.unpack(b)) for block, _, b in rows]
    flat = np.concatenate([k for _, k, _ in bodies])
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    totals = np.add.reduceat(np.concatenate([c for *_, c in bodies])[order], np.flatnonzero(new)) if len(flat) else flat
    back = np.empty(len(flat), dtype=np.uint64)
    back[order] = totals[np.cumsum(new) - 1]
    at = 0
    for block, keys, _ in bodies:
        total = back[at : at + len(keys)]
        at += len(keys)
        several = total >= 2
        if several.any():
            yield shard, block, 0, sharded.pack(keys[several] >> np.uint64(16), total[several])


def document_frequencies(ready: DataFrame, shards: int) -> sharded.Folder:
    """A folder that tells each block of ``ready`` (text, block) the shingles that several texts have."""

    def merge(parts):
        keys, counts = sharded.summed(*map(np.concatenate, zip(*parts, strict=True)))
        return (keys % np.uint64(shards)).astype(np.int64), [keys, counts], 1

    return sharded.write_answers(sharded.answer(sharded.ask(ready, _count, merge), _reply), "shingles", shards)


class _Weights:
    """Weights of shingles of one block."""

    def __init__(self, path: sharded.Folder, texts: int):
        self.answers, self.texts, self.block = sharded.Answers(path), texts, None

    def of(self, block: int, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        if block != self.block:
            parts = [sharded.unpack(b) for b in self.answers.of(block).get(0, [])]
            known, df = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.uint64)] * 2
            order = np.argsort(known, kind="stable")
            self.block, self.known, self.df = block, known[order], df[order].astype(np.float64)
        df = np.ones(len(keys))
        if len(self.known):
            short = keys >> np.uint64(16)
            at = np.minimum(np.searchsorted(self.known, short), len(self.known) - 1)
            found = self.known[at] == short
            df[found] = self.df[at[found]]
        return times * (1 - IDF_SHARE + IDF_SHARE * np.log1p(self.texts / df) / math.log1p(self.texts))


def layout(threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """(picks of a band, bands, equal picks that a pair must have) for a threshold.

    Bands have as many picks as so few bands allow. A pair at the threshold has a
    binomial number of equal picks, of which the least likely ones below are given up.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold has to be above 0 and at most 1")
    bands_of = lambda rows: 1 if threshold == 1 else math.ceil(math.log(UNMET) / math.log1p(-(threshold**rows)))
    rows = max([r for r in range(1, MOST_ROWS + 1) if bands_of(r) <= MOST_BANDS], default=1)
    bands = bands_of(rows)
    n, below, agree = rows * bands, 0.0, 0
    while agree < n and (below := below + math.comb(n, agree) * threshold**agree * (1 - threshold) ** (n - agree)) <= DROPPED:
        agree += 1
    return rows, bands, agree


def signatures(keys: np.ndarray, weights: np.ndarray, sizes: np.ndarray, rows: int, bands: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(texts, bands) band keys of ``rows`` picks each, and (texts, rows * bands) a byte of each pick; ``sizes`` are distinct shingles of each text, all over 0.

    Ioffe's sampling: with r, c ~ Gamma(2, 1) and b ~ U(0, 1) of the shingle and the
    function, t = floor(ln w / r + b), and the least ln c - r (t - b) - r is picked. r, c
    and b take 16 bits each of one hash.
    """
    starts = np.cumsum(sizes) - sizes
    log_w = np.log(weights).astype(np.float32)
    functions = mix(np.arange(1 + seed, rows * bands + 1 + seed, dtype=np.uint64) * _ODD) | np.uint64(1)
    out, bytes_ = np.zeros((len(sizes), bands), dtype=np.uint64), np.empty((len(sizes), rows * bands), dtype=np.uint8)
    for k, odd in enumerate(functions):
        x = keys * odd
        x ^= x >> np.uint64(31)
        x *= _ODD
        bits = x.view(np.uint16).reshape(-1, 4)
        r, beta = _R[bits[:, 3]], bits[:, 1].astype(np.float32) * np.float32(2**-16)
        t = np.floor(log_w * _INVERSE_R[bits[:, 3]] + beta)
        a = _LOG_C[bits[:, 2]] - r * (t - beta + np.float32(1))
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        at = least[np.searchsorted(least, starts)]
        pick = mix(keys[at] + (t[at].astype(np.int64) * 2 + 1).view(np.uint64) * odd)
        band, bytes_[:, k] = k // rows, pick & np.uint64(255)
        out[:, band] = mix(out[:, band] * _ODD + pick + np.uint64(band + 1))
    return out, bytes_


def signed(ready: DataFrame, frequencies: sharded.Folder, texts: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, block, row, cid, size, bands, picks) of each text; cid names its ``size`` shingles and is null where it has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(frequencies, texts)
        for block, batch in sharded.by_block(batches):
            cids, keyed, picked, counted = [], [], [], []
            for keys, sizes in shingles(batch.column("text")):
                keys, times, sizes = _distinct(keys, sizes)
                own, few = np.zeros((len(sizes), bands + 1), dtype=np.uint64), np.zeros((len(sizes), rows * bands), dtype=np.uint8)
                full = sizes > 0
                if full.any():
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    own[full, 0] = mix(np.add.reduceat(mix(keys + times.astype(np.uint64) * _ODD), starts) + sizes[full].astype(np.uint64))
                    own[full, 1:], few[full] = signatures(keys, weights.of(block, keys, times), sizes[full], rows, bands)
                cids.append(own[:, 0])
                keyed.append(own[:, 1:])
                picked += [x.tobytes() for x in few]
                counted.append(sizes)
            cid, size = np.concatenate(cids).view(np.int64), np.concatenate(counted)
            flat = pa.array(np.concatenate(keyed).reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), batch.column("row"), pa.array(cid, mask=size == 0), pa.array(size.astype(np.int64)), lists, pa.array(picked, pa.binary())], names=["doc_id", "block", "row", "cid", "size", "bands", "picks"])
        shared.give_back()

    return ready.mapInArrow(run, "doc_id long, block long, row long, cid long, size long, bands array<long>, picks binary")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted keys, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    least = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return least / (float(a[1].sum()) + float(b[1].sum()) - least)


def agreeing(pairs: DataFrame, classes: DataFrame, agree: int) -> DataFrame:
    """Those of ``pairs`` (a, b: cids) of which ``agree`` picks are the same; with 0, all."""
    if not agree:
        return pairs.select("a", "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("p", "q"))
                near = (p == q).sum(axis=1) >= agree
                yield batch.select(["a", "b"]).filter(pa.array(near))

    p, q = classes.select(F.col("cid").alias("a"), F.col("picks").alias("p")), classes.select(F.col("cid").alias("b"), F.col("picks").alias("q"))
    return pairs.join(p, "a").join(q, "b").select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


SENT = "a long, part int, role int, cid long, root long, body binary"


class Comparison:
    """Sends the weights of classes from their blocks to where they are compared."""

    def __init__(self, ready: DataFrame, frequencies: sharded.Folder, texts: int, classes: DataFrame, threshold: float, shards: int = 0):
        self.ready, self.frequencies, self.texts, self.threshold, self.shards = ready, frequencies, texts, threshold, shards
        self.classes = classes

    def sent(self, wanted: DataFrame) -> DataFrame:
        """SENT rows for ``wanted`` (a, part, role, cid, root)."""
        frequencies, texts = self.frequencies, self.texts
        path = sharded.write_by_block(wanted.join(self.classes.select("cid", "block", "row"), "cid"), "wanted", self.shards)

        def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, answers, now, asked = _Weights(frequencies, texts), sharded.Answers(path), None, {}
            for block, batch in sharded.by_block(batches):
                if block != now:
                    now, asked = block, {}
                    for row, *what in answers.rows(block, ["row", "a", "part", "role", "cid", "root"]):
                        asked.setdefault(row, []).append(tuple(what))
                rows = batch.column("row").to_pylist()
                own = [i for i, r in enumerate(rows) if r in asked]
                if not own:
                    continue
                out, at = [], 0
                for keys, counts in shingles(batch.column("text").take(pa.array(own))):
                    keys, times, counts = _distinct(keys, counts)
                    w = weights.of(block, keys, times)
                    for e, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                        body = sharded.pack(keys[e - n : e], w[e - n : e].view(np.uint64))
                        out += [(*x, body) for x in asked[rows[own[at]]]]
                        at += 1
                        if len(out) > 200:
                            yield _assigned(out)
                            out = []
                if out:
                    yield _assigned(out)
            shared.give_back()

        sent = self.ready.select("text", "block", "row").mapInArrow(weigh, SENT)
        return sent.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b: cids) whose similarity is at least the threshold."""
        sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
        dealt = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("cid"), F.lit(0).cast("long").alias("root"))
        centres = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("cid"), F.lit(0).cast("long").alias("root"))
        threshold = self.threshold

        def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, of = None, None
            for batch in batches:
                a, b = [], []
                for x, part, role, cid, body in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "cid", "body")), strict=True):
                    own = _vector(body)
                    if role == 0:
                        centre, of = own, (x, part)
                    elif of == (x, part) and weighted_jaccard(centre, own) >= threshold - 1e-9:
                        a.append(x)
                        b.append(cid)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return shared.written(self.sent(dealt.union(centres)).mapInArrow(compare, "a long, b long"), "links")

    def blocks(self, wanted: DataFrame) -> DataFrame:
        """A forest (a, b: cids) of the links in each block of ``wanted`` (a, part, role 0 or 1, cid, root): of role 0 to all of another root."""
        threshold = self.threshold

        def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    yield from zip(*(batch.column(c).to_pylist() for c in ("a", "part", "role", "cid", "root", "body")), strict=True)

            for _, own in itertools.groupby(rows(), lambda r: r[:2]):
                a, b = forest(list(own), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return shared.written(self.sent(wanted).mapInArrow(compare, "a long, b long"), "links")


def _vector(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys, bits = sharded.unpack(body)
    return keys, bits.view(np.float64)


def _overlaps(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], columns: int = 4096) -> np.ndarray:
    """Sums of the lesser weights of each left and right vector.

    A shingle's different weights are levels; a vector has all levels up to its own, so
    that the lesser of two weights is the sum of the steps of the levels that both have,
    and a product of 0-1 matrices gives all sums.
    """
    vectors = [*left, *right]
    owner = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    keys, weights = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
    order = np.lexsort((weights, keys))
    keys, weights, owner = keys[order], weights[order], owner[order]
    new_key = np.ones(len(keys), dtype=bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new = new_key.copy()
    new[1:] |= weights[1:] != weights[:-1]
    level = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    step = weights[firsts].copy()
    later = ~new_key[firsts]
    step[later] -= weights[firsts - 1][later]
    first_level = np.maximum.accumulate(np.where(new_key, level, 0))
    times = level - first_level + 1
    doc = np.repeat(owner, times)
    feature = np.repeat(first_level, times) + np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
    shared_by = np.bincount(feature, minlength=len(step))
    number = np.cumsum(shared_by > 1) - 1
    kept = shared_by[feature] > 1
    doc, feature, step = doc[kept], number[feature[kept]], step[shared_by > 1]
    order = np.argsort(feature, kind="stable")
    doc, feature = doc[order], feature[order]
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(step), columns):
        s, e = np.searchsorted(feature, [at, at + columns])
        dense = np.zeros((len(vectors), min(columns, len(step) - at)))
        dense[doc[s:e], feature[s:e] - at] = 1
        out += (dense[: len(left)] * step[at : at + columns]) @ dense[len(left) :].T
    return out


def forest(rows: list[tuple], threshold: float) -> tuple[list[int], list[int]]:
    """Links that join the components of a block: of role 0 to rows of another root; each class to its new component's smallest class."""
    left, right = [r for r in rows if r[2] == 0], [r for r in rows if r[2] == 1]
    if not left or not right:
        return [], []
    va, vb = [_vector(r[5]) for r in left], [_vector(r[5]) for r in right]
    over = _overlaps(va, vb)
    both = np.array([v[1].sum() for v in va])[:, None] + np.array([v[1].sum() for v in vb])[None]
    roots, inverse = np.unique([r[4] for r in left] + [r[4] for r in right], return_inverse=True)
    ra, rb = inverse[: len(left)], inverse[len(left) :]
    a, b = np.nonzero((over >= (threshold - 1e-9) * (both - over)) & (ra[:, None] != rb[None]))
    label = np.arange(len(roots))
    while len(a):
        low = np.minimum(label[ra[a]], label[rb[b]])
        new = label.copy()
        np.minimum.at(new, ra[a], low)
        np.minimum.at(new, rb[b], low)
        if (new == label).all():
            break
        label = new
    joined = np.flatnonzero(label != np.arange(len(roots)))
    return roots[joined].tolist(), roots[label[joined]].tolist()


def _assigned(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["a", "part", "role", "cid", "root", "body"])


def _mixed(bands: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, cid, n, size, root, rest) of bands with several components; ``rest``: outside the band's largest one."""
    rows = bands.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    counts = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = counts.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    rows = rows.join(mixed, "band").select("band", "cid", "n", "size", "root", (F.col("root") != F.col("main")).alias("rest"))
    return shared.written(rows, "mixed")


def _across(mixed: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs across components in small bands that haven't been compared."""
    small = mixed.where(F.col("n") <= SMALL)
    a = small.where("rest").select("band", F.col("cid").alias("x"), F.col("root").alias("root_x"))
    b = small.select("band", F.col("cid").alias("y"), F.col("root").alias("root_y"))
    pairs = a.join(b, "band").where("root_x <> root_y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.distinct().join(known, ["a", "b"], "left_anti")


def _dealt(mixed: DataFrame) -> DataFrame:
    """Large bands as blocks (a: band, part) of their rest (role 0) against all their rows (role 1)."""
    large = mixed.where(F.col("n") > SMALL)
    sides = large.groupBy("band").agg(*(F.ceil(F.greatest(F.sum(c) / BLOCK, F.sum(c * F.col("size")) / BLOCK_SHINGLES)).cast("int").alias(k) for k, c in (("m", F.lit(1)), ("r", F.col("rest").cast("int")))))
    own = large.join(sides, "band").withColumn("i", F.pmod(F.xxhash64("cid"), F.col("r")).cast("int")).withColumn("j", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("m")).cast("int"))
    left = own.where("rest").select(F.col("band").alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.col("i") * F.col("m") + j)).alias("part"), F.lit(0).alias("role"), "cid", "root")
    right = own.select(F.col("band").alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda i: i * F.col("m") + F.col("j"))).alias("part"), F.lit(1).alias("role"), "cid", "root")
    return left.union(right)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, rows_each: int | None = None, bands_all: int | None = None, agree: int | None = None) -> DataFrame:
    """(doc_id, block, row, component_id, kept) for each row of ``docs`` (doc_id, text).

    ``rows_each``, ``bands_all``: picks of a band and bands; ``agree``: equal picks that a
    pair must have to be verified, 0: every pair of a band is. By default those of ``layout``.
    """
    fitting = layout(threshold)
    rows_each, bands_all, enough = rows_each or fitting[0], bands_all or fitting[1], fitting[2]
    enough = enough if agree is None else agree
    docs = sharded.from_files(docs)
    ready = sharded.with_blocks(docs, ["doc_id", "text"])
    texts = docs.count()
    shards = sharded.shards_of(docs)
    frequencies = document_frequencies(ready.select("text", "block"), shards)
    rows = shared.written(signed(ready, frequencies, texts, rows_each, bands_all), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "block", "row"))
    classes = rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(first.alias("first"), *(F.first(c).alias(c) for c in ("size", "bands", "picks")))
    classes = shared.written(classes.select("cid", "first", "first.block", "first.row", "size", "bands", "picks"), "classes")
    exploded = classes.select("cid", "size", F.explode("bands").alias("band"))
    bands = exploded.join(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band")
    bands = shared.written(bands, "bands")
    fellows = bands.groupBy("cid").agg(F.sum("n").alias("fellows"))
    centres = bands.join(fellows, "cid").groupBy("band").agg(F.max_by("cid", F.struct("fellows", "cid")).alias("centre"))
    pairs = bands.join(centres, "band").where("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    pairs = shared.written(pairs, "pairs")
    compare = Comparison(ready, frequencies, texts, classes, threshold, shards)
    links = compare.pairs(shared.written(agreeing(pairs, classes, enough), "agreeing"))
    roots = shared.written(components(links), "roots")
    mixed = _mixed(bands, roots)
    more = shared.written(agreeing(_across(mixed, pairs), classes, enough), "agreeing")
    if not more.isEmpty():
        links = links.union(compare.pairs(more))
    rest = shared.written(_dealt(mixed), "blocks")
    if not rest.isEmpty():
        links = links.union(compare.blocks(rest))
    roots = shared.written(components(links), "roots")
    rooted = classes.select("cid", "first").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    known = rooted.join(heads, "root").select("cid", "head")
    out = rows.select("doc_id", "block", "row", "cid").join(known, "cid", "left")
    alone = F.col("cid").isNull()
    stays = alone | ((F.col("block") == F.col("head.block")) & (F.col("row") == F.col("head.row")))
    return out.select("doc_id", "block", "row", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), stays.alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component; the rows that go are told to their blocks, so texts aren't shuffled."""
    columns = docs.columns
    docs = sharded.from_files(docs)
    path = sharded.write_by_block(near_duplicates(docs, threshold).where("not kept").select("block", "row"), "gone")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, now, gone = sharded.Answers(path), None, set()
        for block, batch in sharded.by_block(batches):
            if block != now:
                now, gone = block, {r for (r,) in answers.rows(block, ["row"])}
            stays = pa.array([r not in gone for r in batch.column("row").to_pylist()], pa.bool_())
            whole = batch.column("whole")  # a struct, as docs may have columns called block or row
            yield pa.RecordBatch.from_arrays(whole.flatten(), names=columns).filter(stays)
        shared.give_back()

    return sharded.with_blocks(docs.withColumn("whole", F.struct(*columns)), ["whole"]).mapInArrow(run, docs.schema)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` at a weighted similarity of 0.8 of five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "component_id", "kept")
