"""Boosted regression trees over sparse rows, one series of trees for each class against the rest.

A row is held as the bins in which it differs from an all-zero row, so what is read for each level of the
trees follows the stored numbers, not rows times features. Tasks count bins by node over their rows, Spark
brings the counts of neighbouring bins together, and the best split of each such group goes to the driver.
The trees of all classes grow side by side. Bins, gains, residuals and weights are those of Spark's
``GBTClassifier``: variance, logistic loss, all features, and thresholds from 10,000 rows.
Residuals are whole multiples of 2^-30, so their sums, and the trees, do not depend on how rows are
divided. Among equal gains the first feature and threshold win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

MAX_BINS = 32
SAMPLE_ROWS = 10_000
STEP = 0.1
SCALE = float(1 << 30)
#: Stored bins of one block of rows, and rows of it at most.
BLOCK_ENTRIES, BLOCK_ROWS = 1 << 20, 1 << 16
#: Stored numbers that a task works on at once, where a row has no more.
SLICE_ENTRIES = 1 << 18
#: Stored numbers of a partition of blocks, about: what is worth a task of its own, and at most.
TASK_ENTRIES, PART_ENTRIES = 1 << 17, 1 << 22
#: Bins whose counts are brought together, and nodes that are split in one pass.
SHARD_CELLS, MAX_SLOTS = 4096, 512

BLOCK = "n int, labels binary, cells binary, places binary"
PARTIAL = "shard int, keys binary, counts binary, sums binary, totals binary"
BEST = "slot int, gain double, cell int, n_left long, sum_left long, n long, total long"


@dataclass
class Space:
    """Bins of all features that have a threshold, numbered one feature after another."""

    features: np.ndarray
    bounds: np.ndarray
    sizes: np.ndarray  # thresholds of each feature
    first: np.ndarray = field(init=False)
    begin: np.ndarray = field(init=False)
    end: np.ndarray = field(init=False)
    zero: np.ndarray = field(init=False)  # bin of the value 0
    shards: np.ndarray = field(init=False)  # first feature of each shard, and the end

    def __post_init__(self):
        self.first = np.cumsum(self.sizes) - self.sizes
        self.begin = self.first + np.arange(len(self.sizes))
        self.end = self.begin + self.sizes + 1
        self.zero = self.begin + (np.add.reduceat(self.bounds < 0, self.first) if len(self.first) else 0)
        shard = self.begin // SHARD_CELLS
        self.shards = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(shard) else np.array([0, 0])

    def cells(self, features: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which stored numbers stand in another bin than 0 does, and that bin."""
        if not len(self.features):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        known = np.flatnonzero(self.features[at] == features)
        at, values = at[known], values[known]
        above, left = np.zeros(len(known), np.int64), np.arange(len(known))
        while len(left):
            left = left[above[left] < self.sizes[at[left]]]
            left = left[self.bounds[self.first[at[left]] + above[left]] < values[left]]
            above[left] += 1
        cell = self.begin[at] + above
        other = cell != self.zero[at]
        return known[other], cell[other]


@dataclass
class Tree:
    """Nodes in the order of their making; a row goes left if its bin of the feature is ``cell`` at most. A leaf has cell -1."""

    cell: list[int] = field(default_factory=list)
    span: list[tuple[int, int, bool]] = field(default_factory=list)  # bins of the feature, and whether 0 goes left
    children: list[tuple[int, int]] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)

    def add(self, value: float, depth: int) -> int:
        for items, item in ((self.cell, -1), (self.span, (0, 0, True)), (self.children, (-1, -1)), (self.value, value), (self.depth, depth)):
            items.append(item)
        return len(self.cell) - 1

    def nodes(self, n: int, cells: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Node at which each of ``n`` rows ends; ``cells`` ascend, ``places`` are their rows."""
        out, todo = np.zeros(n, np.int32), [(0, np.arange(n))]
        while todo:
            node, rows = todo.pop()
            if self.cell[node] < 0 or not len(rows):
                out[rows] = node
                continue
            begin, end, zero_left = self.span[node]
            lo, mid, hi = np.searchsorted(cells, np.array([begin, self.cell[node] + 1, end], cells.dtype))
            is_left = np.full(n, zero_left)
            is_left[places[lo:mid]] = True
            is_left[places[mid:hi]] = False
            goes = is_left[rows]
            todo += [(self.children[node][0], rows[goes]), (self.children[node][1], rows[~goes])]
        return out


def thresholds(values: np.ndarray, counts: np.ndarray, n_rows: float, most: int) -> np.ndarray:
    """At most ``most`` thresholds between the ascending values of a feature, of which those other than 0 are counted."""
    if n_rows - counts.sum() > 1e-9 * n_rows:
        at = int(np.searchsorted(values, 0.0))
        values, counts = np.insert(values, at, 0.0), np.insert(counts.astype(np.float64), at, n_rows - counts.sum())
    if len(values) - 1 <= most:
        return (values[:-1] + values[1:]) / 2.0
    stride = n_rows / (most + 1)
    target, seen, out = stride, float(counts[0]), []
    for i in range(1, len(values)):
        before, seen = seen, seen + float(counts[i])
        if abs(before - target) < abs(seen - target):
            out.append((values[i - 1] + values[i]) / 2.0)
            target += stride
    return np.array(out)


def _stored(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, feature, value`` of the stored numbers of vectors; a dense one has no indices."""
    indices, values = vectors.field("indices"), vectors.field("values")
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sparse = indices.is_valid().to_numpy(zero_copy_only=False)[row]
    feature[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, feature, values.flatten().to_numpy(zero_copy_only=False)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in runs of rows that store about ``SLICE_ENTRIES`` numbers, so that long rows take no more memory than short ones."""
    for batch in batches:
        ends = np.cumsum(_column(batch, "v").field("values").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_ENTRIES, side="right")), lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _value_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: how often a feature has a value other than 0."""
    for batch in _slices(batches):
        _, feature, value = _stored(_column(batch, "v"))
        feature, value = feature[value != 0], value[value != 0]
        order = np.lexsort((value, feature))
        feature, value = feature[order], value[order]
        at = np.flatnonzero(np.r_[True, (feature[1:] != feature[:-1]) | (value[1:] != value[:-1])]) if len(order) else order
        n = np.diff(np.r_[at, len(order)])
        yield pa.RecordBatch.from_arrays([pa.array(feature[at], pa.int32()), pa.array(value[at]), pa.array(n, pa.int64())], names=["feature", "value", "n"])


def space_of(rows: DataFrame, n_rows: int, seed: int) -> Space:
    """Thresholds of all features, from all rows or from a sample of about ``SAMPLE_ROWS``."""
    share = min(1.0, SAMPLE_ROWS / n_rows)
    sample = rows if share == 1.0 else rows.sample(share, seed)
    most = min(MAX_BINS, n_rows) - 1

    def bounds(table: pa.Table) -> pa.Table:
        table = table.sort_by([("feature", "ascending"), ("value", "ascending")])
        feature, value, n = (table[c].to_numpy() for c in ("feature", "value", "n"))
        at = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]])
        ends = np.r_[at[1:], len(feature)]
        found = [thresholds(value[lo:hi], n[lo:hi], share * n_rows, most) for lo, hi in zip(at, ends, strict=True)]
        return pa.table({"feature": pa.array(feature[at], pa.int32()), "bounds": pa.array(found, pa.list_(pa.float64()))})

    counted = sample.select("v").mapInArrow(_value_counts, "feature int, value double, n long").groupBy("feature", "value").agg(F.sum("n").alias("n"))
    shard = F.pmod(F.hash("feature"), F.lit(256))
    table = counted.groupBy(shard).applyInArrow(bounds, "feature int, bounds array<double>").filter(F.size("bounds") > 0).toArrow()
    table = table.sort_by("feature").combine_chunks()  # at most 31 numbers a feature
    sizes = table["bounds"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return Space(table["feature"].to_numpy(), table["bounds"].combine_chunks().flatten().to_numpy(zero_copy_only=False), sizes)


def _packed(shared):
    """Kernel: blocks of rows, each with its bins in ascending order."""

    def block(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        n = np.cumsum([0, *[len(labels) for labels, _, _ in parts]])
        cells = np.concatenate([c for _, c, _ in parts])
        places = np.concatenate([p + at for (_, _, p), at in zip(parts, n, strict=False)])
        order = np.argsort(cells, kind="stable")
        arrays = (np.concatenate([x for x, _, _ in parts]).astype(np.int32), cells[order].astype(np.int32), places[order].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([n[-1]], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=["n", "labels", "cells", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, parts, entries, rows = shared.value, [], 0, 0
        for batch in _slices(batches):
            row, feature, value = _stored(_column(batch, "v"))
            found, cell = space.cells(feature, value)
            parts.append((_column(batch, "label").to_numpy(), cell, row[found]))
            entries, rows = entries + len(cell), rows + batch.num_rows
            if entries >= BLOCK_ENTRIES or rows >= BLOCK_ROWS:
                yield block(parts)
                parts, entries, rows = [], 0, 0
        if rows:
            yield block(parts)

    return run


def _arrays(batch: pa.RecordBatch, i: int, **kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(_column(batch, name)[i].as_buffer(), kind) for name, kind in kinds.items()]


def _residuals(series: list[list[Tree]]):
    """Kernel: blocks with what each class still lacks, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = _column(batch, "n")[i].as_py()
                labels, cells, places = _arrays(batch, i, labels=np.int32, cells=np.int32, places=np.int32)
                lacks = np.empty((len(series), n), np.int64)
                for k, trees in enumerate(series):
                    y = np.where(labels == k, 1.0, -1.0)
                    lacks[k] = np.rint((4.0 * y / (1.0 + np.exp(2.0 * y * margin(trees, n, cells, places))) if trees else y) * SCALE)
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*[_column(one, c) for c in ("n", "cells", "places")], pa.array([lacks.tobytes()], pa.binary())], names=["n", "cells", "places", "lacks"])

    return run


def margin(trees: list[Tree], n: int, cells: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Weighted sum of the trees; the first has the weight 1, the others ``STEP``."""
    out = np.zeros(n)
    for i, tree in enumerate(trees):
        out += (STEP if i else 1.0) * np.array(tree.value)[tree.nodes(n, cells, places)]
    return out


def _histograms(shared, trees: list[Tree], slots: list[tuple[int, int]]):
    """Kernel: rows and residuals by bin and node, for each shard of bins. Sums of whole numbers below 2^53 are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        begins = np.r_[space.begin, space.end[-1] if len(space.end) else 0][space.shards]
        maps = [np.full(len(t.cell), -1) for t in trees]
        for s, (k, node) in enumerate(slots):
            maps[k][node] = s
        for batch in batches:
            for i in range(batch.num_rows):
                n = _column(batch, "n")[i].as_py()
                cells, places, lacks = _arrays(batch, i, cells=np.int32, places=np.int32, lacks=np.int64)
                lacks = lacks.reshape(len(trees), n)
                used = []  # first and last slot of a class, slot of each row, its residual
                for m, t, r in zip(maps, trees, lacks, strict=True):
                    if (mine := m[m >= 0]).size:
                        used.append((mine.min(), mine.max() + 1, m[t.nodes(n, cells, places)], r.astype(np.float64)))
                totals = np.zeros((2, len(slots)))
                for _, _, at, r in used:
                    here = at >= 0
                    totals += np.bincount(at[here], minlength=len(slots)), np.bincount(at[here], r[here], len(slots))
                cuts = np.searchsorted(cells, begins.astype(np.int32))
                out = []
                for s in range(len(begins) - 1):
                    lo, hi, width = cuts[s], cuts[s + 1], int(begins[s + 1] - begins[s])
                    row, cell, found = places[lo:hi], cells[lo:hi] - begins[s], []
                    for a, b, at, r in used:
                        key = (at - a)[row] * width + cell
                        here = np.flatnonzero(at[row] >= 0)
                        key = key[here]
                        counts = np.bincount(key, minlength=(b - a) * width)
                        keys = np.flatnonzero(counts)
                        found.append((keys + a * width, counts[keys], np.bincount(key, r[row[here]], (b - a) * width)[keys]))
                    keys, counts, sums = (np.concatenate(x) for x in zip(*found, strict=True))
                    out.append((s, keys.astype(np.int32), counts.astype(np.int32), sums.astype(np.int64), totals.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[j].tobytes() for x in out], pa.binary()) for j in range(1, 5)]],
                    names=["shard", "keys", "counts", "sums", "totals"],
                )

    return run


def _best(shared, n_slots: int):
    """Kernel: the best split of each node within a shard of bins, from the histograms of all blocks."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, shard = shared.value, key[0].as_py()
        these = slice(*space.shards[shard : shard + 2])
        begin, end, zero = space.begin[these], space.end[these], space.zero[these]
        width = int(end[-1] - begin[0]) if len(begin) else 0
        n, total = np.zeros((n_slots, width), np.int64), np.zeros((n_slots, width), np.int64)
        totals = np.zeros((2, n_slots), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, sums, added = _arrays(batch, i, keys=np.int32, counts=np.int32, sums=np.int64, totals=np.int64)
                np.add.at(n.reshape(-1), keys, counts)
                np.add.at(total.reshape(-1), keys, sums)
                totals += added.reshape(2, n_slots)
        gain, cell = np.full(n_slots, -1.0), np.full(n_slots, -1)
        n_left, sum_left = np.zeros(n_slots, np.int64), np.zeros(n_slots, np.int64)
        if width:
            at, sizes = begin - begin[0], end - begin
            last = np.zeros(width, bool)
            last[at + sizes - 1] = True
            for table, whole in ((n, totals[0]), (total, totals[1])):
                table[:, zero - begin[0]] = whole[:, None] - np.add.reduceat(table, at, axis=1)
                np.cumsum(table, axis=1, out=table)
                before = np.concatenate([np.zeros((n_slots, 1), np.int64), table[:, at[1:] - 1]], axis=1)
                table -= np.repeat(before, sizes, axis=1)
            for s in range(n_slots):
                left, right = n[s].astype(np.float64), (totals[0, s] - n[s]).astype(np.float64)
                ok = np.flatnonzero((left > 0) & (right > 0) & ~last)
                if len(ok):
                    left, right, sums = left[ok], right[ok], total[s, ok]
                    gains = (sums * right - (totals[1, s] - sums) * left) ** 2 / (left * right)
                    best = int(np.argmax(gains))
                    gain[s], cell[s], n_left[s], sum_left[s] = gains[best], ok[best] + begin[0], n[s, ok[best]], sums[best]
        arrays = [np.arange(n_slots, dtype=np.int32), gain, cell.astype(np.int32), n_left, sum_left, totals[0], totals[1]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[c.split()[0] for c in BEST.split(", ")])

    return run


def _grow(held: DataFrame, shared, n_classes: int, max_depth: int) -> list[Tree]:
    """One tree for each class, level by level."""
    space, trees = shared.value, [Tree() for _ in range(n_classes)]
    tasks = min(len(space.shards) - 1, 4 * held.sparkSession.sparkContext.defaultParallelism)
    todo = [(k, t.add(0.0, 0)) for k, t in enumerate(trees)]
    while todo:
        slots, todo = todo[:MAX_SLOTS], todo[MAX_SLOTS:]
        partial = held.mapInArrow(_histograms(shared, trees, slots), PARTIAL).repartition(tasks, "shard")
        found = partial.groupBy("shard").applyInArrow(_best(shared, len(slots)), BEST)
        best: dict[int, dict] = {}
        for row in found.toArrow().to_pylist():  # a row for each node and shard of bins
            s = row["slot"]
            if s not in best or (row["gain"], -row["cell"]) > (best[s]["gain"], -best[s]["cell"]):
                best[s] = row
        for s, row in sorted(best.items()):
            k, node = slots[s]
            tree = trees[k]
            if not row["n"]:
                continue
            tree.value[node] = row["total"] / row["n"] / SCALE
            if row["gain"] <= 0 or tree.depth[node] >= max_depth:
                continue
            at = int(np.searchsorted(space.begin, row["cell"], side="right")) - 1
            n_right = row["n"] - row["n_left"]
            sides = ((row["sum_left"], row["n_left"]), ((row["total"] - row["sum_left"]), n_right))
            children = tuple(tree.add(total / n / SCALE, tree.depth[node] + 1) for total, n in sides)
            tree.cell[node], tree.children[node] = row["cell"], children
            tree.span[node] = (int(space.begin[at]), int(space.end[at]), bool(space.zero[at] <= row["cell"]))
            if tree.depth[node] + 1 < max_depth:
                todo += [(k, child) for child, (_, n) in zip(children, sides, strict=True) if n > 1]
    return trees


def boosted(rows: DataFrame, n_trees: int, max_depth: int, seed: int) -> tuple[Space, list[list[Tree]]]:
    """Thresholds and the trees of each class. ``rows``: ``label`` double from 0, and ``v``, a struct of indices and values."""
    n_rows, top, entries = rows.agg(F.count("*"), F.max("label"), F.sum(F.size("v.values"))).first()
    if not n_rows:
        raise ValueError("no rows to learn from")
    spark, n_classes, entries = rows.sparkSession, int(top) + 1, entries or 0
    shared = spark.sparkContext.broadcast(space_of(rows, n_rows, seed))
    parts = max(min(spark.sparkContext.defaultParallelism, math.ceil(entries / TASK_ENTRIES)), math.ceil(entries / PART_ENTRIES), 1)
    blocks = rows.select("label", "v").coalesce(parts).mapInArrow(_packed(shared), BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    series, held = [[] for _ in range(n_classes)], None
    try:
        for _ in range(n_trees):
            new = blocks.mapInArrow(_residuals(series), "n int, cells binary, places binary, lacks binary").persist(StorageLevel.MEMORY_AND_DISK)
            if held is not None:
                held.unpersist()
            held = new
            for trees, tree in zip(series, _grow(held, shared, n_classes, max_depth), strict=True):
                trees.append(tree)
        return shared.value, series
    finally:
        if held is not None:
            held.unpersist()
        blocks.unpersist()


def predicted(vector: Column, space: Space, series: list[list[Tree]]) -> Column:
    """Class with the largest sum of its trees, the first of equal ones, for a struct of indices and values."""

    @arrow_udf("double")
    def label(vectors: pa.Array) -> pa.Array:
        row, feature, value = _stored(vectors)
        found, cell = space.cells(feature, value)
        order = np.argsort(cell, kind="stable")
        cells, places = cell[order], row[found][order]
        margins = [margin(trees, len(vectors), cells, places) for trees in series]
        return pa.array(np.argmax(margins, axis=0).astype(np.float64))

    return label(vector)
