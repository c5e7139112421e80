"""Exact nearest rows of the same group, block against block.

Rows are dealt to the cells of a tree of cuts, made from some rows of their group, and
each cell is cut into blocks of about ``BLOCK`` rows along a curve through it. Within its
own block a row finds k rows and with them a bound on how far its k nearest can be. A
block holds a nearer row only if its box, by its rows' least and largest features, meets
the ball of that bound, so blocks are paired with the blocks whose boxes can't be ruled
out. In a pair only the rows whose own balls meet the other's box are compared, as one
array computation; the short lists that come of it are merged by row. No group, cell or
row's candidates have to fit a task, only two blocks. Any number of cells gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prescriva.operators import ranks
from prescriva.sources import tables

BLOCK, CELLS = 256, 2048
#: Rows of a group by which a cell is cut, and the least number of them.
SEEN_A_CELL, SEEN_LEAST = 16, 64


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b; each is summed in the order of the features, so that it is the same in any block."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return out


@dataclass
class _Tree:
    """Cuts of a complete tree over one group's rows: a node's feature and where it is cut; the box of each leaf; and some rows."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    some: np.ndarray

    @classmethod
    def of(cls, seen: np.ndarray, depth: int) -> _Tree:
        nodes, leaves, width = (1 << depth) - 1, 1 << depth, seen.shape[1]
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        rows, box = {0: seen}, {0: (seen.min(axis=0), seen.max(axis=0))}
        for i in range(nodes):
            own = rows.pop(i)
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(width)
            left = np.ones(len(own), dtype=bool)
            if spread.max() > 0:
                f = int(spread.argmax())
                middle = np.median(own[:, f])
                middle = middle if middle > own[:, f].min() else own[own[:, f] > middle, f].min()
                feature[i], cut[i], left = f, middle, own[:, f] < middle
            for child, part in ((2 * i + 1, own[left]), (2 * i + 2, own[~left])):
                rows[child] = part
                box[child] = (part.min(axis=0), part.max(axis=0)) if len(part) else box[i]
        low, high = (np.array([box[nodes + j][side] for j in range(leaves)]) for side in (0, 1))
        return cls(feature, cut, low, high, seen[:SEEN_LEAST])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, place on a curve through it) of rows: bits of the features take turns."""
        node = np.zeros(len(x), np.int64)
        while len(self.cut) and node[0] < len(self.cut):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] >= self.cut[node])
        leaf = node - len(self.cut)
        width = min(x.shape[1], 60)
        bits = 60 // width
        low, span = self.low[leaf], self.high[leaf] - self.low[leaf]
        share = np.clip((x - low) / np.where(span > 0, span, 1.0), 0.0, 1.0)[:, :width]
        steps, curve = np.minimum(share * (1 << bits), (1 << bits) - 1).astype(np.int64), np.zeros(len(x), np.int64)
        for bit in range(bits - 1, -1, -1):
            for f in range(width):
                curve = (curve << 1) | ((steps[:, f] >> bit) & 1)
        return leaf.astype(np.int32), curve


def _blocks(points: DataFrame, trees: dict[str, _Tree], width: int) -> DataFrame:
    """(key, grp, x, cell, block): blocks of ``BLOCK`` to twice as many rows of a cell, along its curve."""

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").dictionary_encode()
            of, names = groups.indices.to_numpy(), groups.dictionary.to_pylist()
            cell, curve = np.zeros(len(of), np.int32), np.zeros(len(of), np.int64)
            x = _matrix(batch.column("x"), width)
            for i, g in enumerate(names):
                own = of == i
                cell[own], curve[own] = trees[g].place(x[own])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "grp", "x")), pa.array(cell), pa.array(curve)], names=["key", "grp", "x", "cell", "curve"])

    kinds = dict(points.dtypes)
    own = points.select("key", "grp", "x").mapInArrow(placed, f"key {kinds['key']}, grp string, x array<double>, cell int, curve long")
    ordered = ranks.positions(tables.written(own, "cells"), ["grp", "cell", "curve", "key"], "at")
    cells = ordered.groupBy("grp", "cell").agg(F.min("at").alias("start"), F.greatest(F.expr(f"count(*) div {BLOCK}"), F.lit(1)).alias("blocks"))
    block = F.least(F.expr(f"(at - start) div {BLOCK}"), F.col("blocks") - 1)
    return ordered.join(F.broadcast(cells), ["grp", "cell"]).select("key", "grp", "x", "cell", block.alias("block"))  # CELLS cells and one a group at most


def _outside(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a box."""
    return (np.maximum(np.maximum(low - x, x - high), 0.0) ** 2).sum(axis=1)


def nearest(df: DataFrame, features: list[str], group: str, key: str, k: int = 5, most_cells: int = CELLS) -> DataFrame:
    """(key, grp, x, near) of each row with all ``features``: ``near`` lists (distance, key, x) of its k nearest other rows of its group, nearest first and of equally near ones by key; fewer where the group is smaller.

    ``key`` has to be unique. Rows without a group or a feature are left out. A row for
    each group, some rows for each of ``most_cells`` cells and some for each group are on
    the driver, and cells' boxes are sent to all tasks.
    """
    width = len(features)
    x = F.array(*(F.col(c).cast("double") for c in features))
    points = tables.written(df.where(F.col(group).isNotNull()).dropna(subset=features).select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), x.alias("x")), "points")
    counts = {r.grp: r.n for r in points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(sum(counts.values()), 1)
    depths = {g: max(min(most_cells * n // total, n // (2 * BLOCK)), 1).bit_length() - 1 for g, n in counts.items()}
    # Half more than are wanted, as draws are by hashes.
    shares = [(g, min(1.5 * max(SEEN_A_CELL << depths[g], SEEN_LEAST) / n, 1.0)) for g, n in counts.items()]
    chosen = points.join(F.broadcast(df.sparkSession.createDataFrame(shares, "grp string, share double")), "grp")  # a row for each group
    chosen = chosen.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= F.col("share") * (1 << 30)).select("grp", "key", "x").orderBy("grp", F.xxhash64("key"), "key").collect()
    seen: dict[str, list] = {g: [] for g in counts}
    for r in chosen:
        seen[r.grp].append(r.x)
    trees = {g: _Tree.of(np.array(v, dtype=float).reshape(-1, width) if v else np.zeros((1, width)), depths[g]) for g, v in seen.items()}
    some = {g: trees[g].some if v else np.empty((0, width)) for g, v in seen.items()}
    rows = tables.written(_blocks(points, trees, width), "blocks")
    of = f"key {dict(rows.dtypes)['key']}"

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block with its rows' bounds and its box."""
        for batch in batches:
            for i in range(batch.num_rows):
                g, xs = batch.column("grp")[i].as_py(), _matrix(batch.column("xs").slice(i, 1).flatten(), width)
                inside = _squares(xs, xs)
                np.fill_diagonal(inside, np.inf)
                bound = np.partition(inside, k - 1, axis=1)[:, k - 1] if len(xs) > k else np.full(len(xs), np.inf)
                if len(some[g]) > k:
                    # One of these rows may be the row itself.
                    bound = np.minimum(bound, np.partition(_squares(xs, some[g]), k, axis=1)[:, k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, 1) for c in ("grp", "cell", "block", "keys", "xs")] + [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (bound, xs.min(axis=0), xs.max(axis=0))],
                    names=["grp", "cell", "block", "keys", "xs", "bound", "low", "high"],
                )

    grouped = rows.groupBy("grp", "cell", "block").agg(F.array_sort(F.collect_list(F.struct("key", "x"))).alias("r")).select("grp", "cell", "block", F.col("r.key").alias("keys"), F.col("r.x").alias("xs"))
    kinds = f"grp string, cell int, block long, keys array<{of.split()[1]}>, xs array<array<double>>, bound array<double>, low array<double>, high array<double>"
    blocks = tables.written(grouped.mapInArrow(packed, kinds), "blocks")
    side = lambda f, c: F.array(*(f(F.get(c, F.lit(i))) for i in range(width)))
    boxes: dict[str, list] = {g: [] for g in counts}
    for r in blocks.groupBy("grp", "cell").agg(side(F.min, "low").alias("low"), side(F.max, "high").alias("high")).collect():
        boxes[r.grp].append((r.cell, r.low, r.high))
    cells = {g: tuple(np.array(v) for v in zip(*own, strict=True)) for g, own in boxes.items() if own}

    def reaching(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that a block's rows reach, each with the box of those rows' balls."""
        for batch in batches:
            for i in range(batch.num_rows):
                xs, bound = _matrix(batch.column("xs").slice(i, 1).flatten(), width), batch.column("bound").slice(i, 1).flatten().to_numpy()
                names, low, high = cells[batch.column("grp")[i].as_py()]
                # Room for what rounding does.
                slack = 1e-9 * (1 + np.abs(xs).max())
                reach = np.sqrt(bound)[:, None] + slack
                near = np.flatnonzero(((low <= (xs + reach).max(axis=0)) & (high >= (xs - reach).min(axis=0))).all(axis=1))
                out = []
                for j in near.tolist():
                    own = np.sqrt(_outside(xs, low[j], high[j])) <= reach[:, 0]
                    if own.any():
                        out.append((int(names[j]), (xs[own] - reach[own]).min(axis=0).tolist(), (xs[own] + reach[own]).max(axis=0).tolist()))
                n = len(out)
                to, lows, highs = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c)[i].as_py()] * n, t) for c, t in (("grp", pa.string()), ("cell", pa.int32()), ("block", pa.int64()))] + [pa.array(to, pa.int32()), pa.array(lows, pa.list_(pa.float64())), pa.array(highs, pa.list_(pa.float64()))], names=["grp", "_cell", "_block", "cell", "from", "to"])

    reach = blocks.select("grp", "cell", "block", "xs", "bound").mapInArrow(reaching, "grp string, _cell int, _block long, cell int, from array<double>, to array<double>")
    there = blocks.select("grp", "cell", "block", "low", "high")
    meets = reduce(and_, ((F.get("from", F.lit(i)) <= F.get("high", F.lit(i))) & (F.get("to", F.lit(i)) >= F.get("low", F.lit(i))) for i in range(width)))
    # A block meets itself as well.
    pairs = reach.join(there, ["grp", "cell"]).where(meets).select("grp", "_cell", "_block", "cell", "block")
    asking = blocks.select("grp", F.col("cell").alias("_cell"), F.col("block").alias("_block"), F.col("keys").alias("own"), F.col("xs").alias("own_xs"), "bound")
    met = pairs.join(asking, ["grp", "_cell", "_block"]).join(blocks.select("grp", "cell", "block", "keys", "xs", "low", "high"), ["grp", "cell", "block"])
    met = met.select("own", "own_xs", "bound", "keys", "xs", "low", "high", ((F.col("_cell") == F.col("cell")) & (F.col("_block") == F.col("block"))).alias("itself"))

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, keys = batch.column("own").slice(i, 1).flatten(), batch.column("keys").slice(i, 1).flatten()
                a, b = (_matrix(batch.column(c).slice(i, 1).flatten(), width) for c in ("own_xs", "xs"))
                bound, low, high = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("bound", "low", "high"))
                asks = np.flatnonzero(np.sqrt(_outside(a, low, high)) <= np.sqrt(bound) + 1e-9 * (1 + np.abs(a).max()))
                d = _squares(a[asks], b)
                if batch.column("itself")[i].as_py():
                    d[np.arange(len(asks)), asks] = np.inf
                hits = (d <= bound[asks][:, None]) & np.isfinite(d)
                many = np.flatnonzero(hits.sum(axis=1) > k)
                if len(many):
                    # Keys of a block are sorted, so a stable sort puts equally near ones in their order.
                    first = np.argsort(np.where(hits[many], d[many], np.inf), axis=1, kind="stable")[:, :k]
                    hits[many] = False
                    hits[many[:, None], first] = True
                row, to = np.nonzero(hits)
                if len(row):
                    near = pa.ListArray.from_arrays(pa.array(np.arange(len(to) + 1) * width, pa.int32()), pa.array(b[to].ravel()))
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(asks[row])), pa.array(np.sqrt(d[row, to])), keys.take(pa.array(to)), near], names=["key", "distance", "other", "other_x"])

    found = met.mapInArrow(lists, f"{of}, distance double, {of.replace('key', 'other')}, other_x array<double>")
    near = found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", F.col("other").alias("key"), F.col("other_x").alias("x")))), 1, k).alias("near"))
    return points.join(near, "key", "left").select("key", "grp", "x", F.coalesce("near", F.array().cast(near.schema["near"].dataType)).alias("near"))
