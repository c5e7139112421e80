"""Embedding near-duplicates by E8 lattice hashing (operator 10).

A table projects a unit vector by a random matrix to two groups of eight numbers, scales
them and decodes each group to the nearest point of the lattice E8; the two points name
the vector's cell. The nearest neighbouring lattice point of each group gives three more
cells to probe. Vectors meet where one's own cell is among the other's probed cells, in
any of ``TABLES`` tables, and each meeting is verified by the cosine in double
precision. The index covers every row; ``measured recall`` is in the tests and README.

Equal vectors are one class with a size, found by a group-by that sums before its
shuffle, so copies are never paired. A cell with more than ``BLOCK`` classes is dealt
out as blocks of its rows against blocks of its rows. A task counts the links that it
verifies and keeps those of a block as a star forest; a link that several tables find
is counted in the first of them only, which both vectors' cells tell. So no list of
pairs is shuffled, and the components come from the stars.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, not even with their copies, and are components of their
own. Vectors of different lengths don't link. Rows with the same vec_id are vectors of
their own that share an id; a null vec_id is never smallest (a component of null ids
alone has component_id null and all its rows are kept). An empty table gives an empty
one; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prescriva.llm import shared
from prescriva.llm.components import components
from prescriva.llm.wordhash import mix

TABLES = 14
GROUPS = 2
SCALE = 1.8
BLOCK = 1000
_PROJECTIONS: dict[int, np.ndarray] = {}


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all halves with an even number of minus signs."""
    pairs = [np.eye(8)[i] * s + np.eye(8)[j] * t for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


_NEAR = minimal_vectors()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer entries of an even sum."""
    r = np.rint(y)
    e = y - r
    rows = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(e[rows]).argmax(axis=1)
    r[rows, worst] += np.where(e[rows, worst] >= 0, 1, -1)
    return r


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 + 1/2."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _projection(dim: int) -> np.ndarray:
    if dim not in _PROJECTIONS:
        _PROJECTIONS[dim] = np.random.default_rng(8 * dim + 1).normal(size=(dim, TABLES * GROUPS * 8)) / SCALE
    return _PROJECTIONS[dim]


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name of each lattice point."""
    h = np.full(len(points), salt, dtype=np.uint64)
    for column in (2 * points).astype(np.int64).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return h


def cells(x: np.ndarray) -> np.ndarray:
    """(vectors, TABLES, 4): each unit vector's own cell in each table, then the three probed ones."""
    y = x @ _projection(x.shape[1])
    out = np.empty((len(x), TABLES, 4), dtype=np.uint64)
    for t in range(TABLES):
        home, near = [], []
        for g in range(GROUPS):
            part = y[:, (t * GROUPS + g) * 8 :][:, :8]
            point = nearest_e8(part)
            # The neighbour of least distance has the largest inner product, less half its length, with the remainder.
            gain = (part - point) @ _NEAR.T
            second = point + _NEAR[gain.argmax(axis=1)]
            home.append(_key(point, 1000 * t + g))
            near.append(_key(second, 1000 * t + g))
        odd = np.uint64(0xD6E8FEB86659FD93)
        for k, (a, b) in enumerate([(home[0], home[1]), (near[0], home[1]), (home[0], near[1]), (near[0], near[1])]):
            out[:, t, k] = mix(a * odd + b)
    return out


def _usable(values: pa.Array) -> Iterator[tuple[np.ndarray | None, int]]:
    """Each embedding as doubles, or None where it can't link."""
    for v in values.to_pylist():
        if not v or any(c is None for c in v):
            yield None, 0
            continue
        x = np.array(v, dtype=np.float64)
        yield (x, len(x)) if np.isfinite(x).all() and x.any() else (None, 0)


def classes_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, cid, unit): the class of each vector by the bits of its embedding; null for those that can't link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, units = [], []
            for x, _ in _usable(batch.column("embedding")):
                if x is None:
                    cids.append(None)
                    units.append(None)
                    continue
                x = x + 0.0  # -0.0 becomes 0.0
                cids.append(xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63)
                top = np.abs(x).max()
                x = x / top
                units.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cids, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "cid", "unit"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cid long, unit binary")


def _cell_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [np.frombuffer(u) for u in batch.column("unit").to_pylist()]
        cid = batch.column("cid").to_numpy()
        for dim in sorted({len(u) for u in units}):
            own = np.flatnonzero([len(u) == dim for u in units])
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                names = cells(np.stack([units[i] for i in part]))
                home = np.tile(np.array([True, False, False, False]), len(part) * TABLES)
                yield pa.RecordBatch.from_arrays([pa.array(names.reshape(-1).view(np.int64)), pa.array(np.repeat(cid[part], TABLES * 4)), pa.array(home)], names=["cell", "cid", "home"])


def _links(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """For rows sorted by cell and block pair: the links counted here, and each class's smallest fellow in its block."""
    names = ["cell", "ib", "qb", "cid", "size", "home", "unit", "side"]
    kept: list[list] = [[] for _ in names]

    def flush(until: int) -> Iterator[pa.RecordBatch]:
        columns = [c[:until] for c in kept]
        for c in kept:
            del c[:until]
        if columns[0]:
            yield from _count(dict(zip(names, columns, strict=True)), least)

    for batch in batches:
        for c, name in zip(kept, names, strict=True):
            c.extend(batch.column(name).to_pylist())
        cell, ib, qb = kept[0], kept[1], kept[2]
        last = len(cell) - 1
        i = last
        while i > 0 and (cell[i - 1], ib[i - 1], qb[i - 1]) == (cell[last], ib[last], qb[last]):
            i -= 1
        yield from flush(i)
    yield from flush(len(kept[0]))


def _count(rows: dict[str, list], least: float) -> Iterator[pa.RecordBatch]:
    """Blocks one after another; which cell a link is found in first is asked for all their links together."""
    units = [np.frombuffer(u) for u in rows["unit"]]
    cell, ib, qb, cid, size = (np.array(rows[k], dtype=np.int64) for k in ("cell", "ib", "qb", "cid", "size"))
    home, side = np.array(rows["home"], dtype=bool), np.array(rows["side"], dtype=np.int64)
    changed = (cell[1:] != cell[:-1]) | (ib[1:] != ib[:-1]) | (qb[1:] != qb[:-1])
    begins = [0, *(np.flatnonzero(changed) + 1).tolist(), len(units)]
    lengths = np.array([len(u) for u in units])
    for dim in np.unique(lengths):
        x = np.zeros((len(units), dim))
        for i in np.flatnonzero(lengths == dim):
            x[i] = units[i]
        starts, lefts, rights = [], [], []
        for s, e in itertools.pairwise(begins):
            if e - s < 2 or not home[s:e].any():
                continue
            left, right = s + np.flatnonzero(side[s:e] != 1), s + np.flatnonzero(side[s:e] != 0)
            a, b = np.nonzero(x[left] @ x[right].T >= least - 1e-12)
            if not len(a):
                continue
            a, b = left[a], right[b]
            ok = (home[a] | home[b]) & (cid[a] < cid[b] if ib[s] == qb[s] else cid[a] != cid[b])
            if ok.any():
                starts.append(np.full(int(ok.sum()), s))
                lefts.append(a[ok])
                rights.append(b[ok])
        if not starts:
            continue
        start, a, b = map(np.concatenate, (starts, lefts, rights))
        kept = _found_first(x, cid, a, b, cell[a])
        start, a, b = start[kept], a[kept], b[kept]
        kept = np.einsum("ij,ij->i", x[a], x[b]) >= least
        start, a, b = start[kept], a[kept], b[kept]
        if not len(a):
            continue
        add = np.bincount(a, size[b], len(x)) + np.bincount(b, size[a], len(x))
        rank = np.searchsorted(np.unique(cid), cid)
        label = rank.copy()  # rows are their block's alone, so that labels stay in blocks
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            if (new == label).all():
                break
            label = new
        seen = np.flatnonzero(add)
        yield pa.RecordBatch.from_arrays([pa.array(cid[seen]), pa.array(add[seen].astype(np.int64)), pa.array(np.unique(cid)[label[seen]])], names=["cid", "add", "low"])


def _found_first(x: np.ndarray, cid: np.ndarray, a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether each pair meets in its cell first: in no earlier table, and in no smaller cell of this one."""
    distinct, at = np.unique(cid[np.concatenate([a, b])], return_index=True)
    names = cells(x[np.concatenate([a, b])[at]])
    ia, ib = np.searchsorted(distinct, cid[a]), np.searchsorted(distinct, cid[b])
    out, far = np.empty(len(a), dtype=bool), np.uint64(2**64 - 1)
    for s in range(0, len(a), 20_000):
        p, q = names[ia[s : s + 20_000]], names[ib[s : s + 20_000]]
        # A table's meetings: own cell of one among the four of the other; the smallest cell of the first such table counts.
        meet = np.minimum(np.where(p[:, :, :1] == q, q, far).min(axis=2), np.where(q[:, :, :1] == p, p, far).min(axis=2))
        table = (meet != far).argmax(axis=1)
        out[s : s + 20_000] = meet[np.arange(len(p)), table] == cell[s : s + 20_000].view(np.uint64)
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    shared.small_batches(spark)
    rows = shared.written(classes_of(vectors), "vectors")
    linkable = rows.where(F.col("cid").isNotNull())
    classes = linkable.groupBy("cid").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least_id"), F.first("unit").alias("unit"))
    classes = shared.written(classes, "classes")
    met = classes.select("cid", "unit").mapInArrow(_cell_rows, "cell long, cid long, home boolean")
    whole = Window.partitionBy("cell")
    met = met.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("homes", F.sum(F.col("home").cast("int")).over(whole)).where("n > 1 and homes > 0")
    # Blocks of a large cell: a row is on the left in its block's row of the grid and on the right in its column.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    grid = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(F.col("own"), o).alias("ib"), F.greatest(F.col("own"), o).alias("qb"), F.when(o == F.col("own"), 2).when(F.col("own") < o, 0).otherwise(1).alias("side")),
    )
    dealt = met.select("cell", "cid", "home", F.explode(grid).alias("g")).select("cell", "cid", "home", "g.*")
    dealt = dealt.join(classes.select("cid", "size", "unit"), "cid")
    dealt = dealt.select("cell", "ib", "qb", "cid", "size", "home", "unit", "side").repartition("cell", "ib", "qb").sortWithinPartitions("cell", "ib", "qb")
    found = shared.written(dealt.mapInArrow(lambda b: _links(b, least), "cid long, add long, low long"), "links")
    links = found.groupBy("cid").agg(F.sum("add").alias("links"))
    stars = components(found.where("cid <> low").select("cid", "low"))
    rooted = classes.select("cid", "size", "least_id").join(stars.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least_ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.join(least_ids, "root").join(links, "cid", "left").select("cid", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cid").join(known, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all ``embeddings`` at a cosine of 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
