"""Random forests over sparse rows: the trees of Spark's ``RandomForestClassifier``, read from what vectors store.

Rows are held as in ``boosting``, so work, memory and disk follow the stored numbers, not rows times
features. Each node looks at its own draw of features: a task reads only the bins of these, counts them by
class and bin over its rows of the node, and sends the counts that are not zero; the best split of a node
goes to the driver. Gini impurity, thresholds from 10,000 rows, the number of features of a node, Poisson
weights of rows, merged leaves of one class and the vote by class shares are those of Spark's estimator.
Features are drawn by tree and node, weights by tree and place of a row, so a repeated task draws the
same; these draws are others than Spark's. Among equal gains the first feature and threshold win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from sevfold.operators import boosting as b
from sevfold.operators.boosting import Space, Tree
from sevfold.operators.lookup import small_batches

#: Nodes of one tree whose counts are brought together, and nodes that are split in one pass.
GROUP_NODES, MAX_NODES = 16, 1 << 14
#: Counts that a group of nodes has at most, about.
GROUP_COUNTS = 1 << 22
EPSILON = 2.0**-52

PARTIAL = "group int, keys binary, counts binary, totals binary"
BEST = "group int, place int, gain double, cell int, left_counts binary, totals binary"


@dataclass
class Draws:
    """What is drawn for a tree: features of a node, and how often a row counts."""

    seed: int
    n_features: int
    per_node: int
    n_classes: int
    bootstrap: bool = True

    def features(self, space: Space, k: int, node: int) -> np.ndarray:
        """Places in ``space`` of the features of a node; those without a threshold have none."""
        if self.per_node >= self.n_features:
            return np.arange(len(space.features))
        drawn = np.sort(np.random.default_rng([self.seed, k, node]).choice(self.n_features, self.per_node, replace=False, shuffle=False))
        at = np.searchsorted(space.features, drawn)
        at, drawn = at[at < len(space.features)], drawn[at < len(space.features)]
        return at[space.features[at] == drawn]

    def weights(self, k: int, part: int, block: int, n: int) -> np.ndarray:
        return np.random.default_rng([self.seed, k, part, block, 1]).poisson(1.0, n) if self.bootstrap else np.ones(n, np.int64)


@dataclass
class _Block:
    number: int
    labels: np.ndarray
    places: np.ndarray
    cells: np.ndarray
    first: np.ndarray  # first entry of each feature, and the end


def _widths(space: Space, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of each of some features, and the first of them when the bins of these alone are numbered."""
    sizes = space.end[features] - space.begin[features]
    return sizes, np.cumsum(sizes) - sizes


def _counts(space: Space, features: np.ndarray, place: int, blocks: list[tuple[_Block, np.ndarray, np.ndarray]], n_classes: int) -> np.ndarray:
    """Weights by bin and class of the rows of one node, over the bins of its features that rows stand in."""
    sizes, local = _widths(space, features)
    out = np.zeros(int(sizes.sum()) * n_classes)
    for block, at, weights in blocks:
        lo = block.first[features]
        n = block.first[features + 1] - lo
        entries = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows = block.places[entries]
        here = np.flatnonzero(at[rows] == place)
        if len(here):
            rows = rows[here]
            cell = block.cells[entries[here]] - np.repeat(space.begin[features] - local, n)[here]
            out += np.bincount(cell * n_classes + block.labels[rows], weights[rows], len(out))
    return out


def _histograms(shared, trees: list[Tree], groups: list[tuple[int, list[int]]], draws: Draws):
    """Kernel: weights of rows by bin and class, for each group of nodes."""
    by_tree: dict[int, list[int]] = {}
    for g, (k, _) in enumerate(groups):
        by_tree.setdefault(k, []).append(g)

    def counted(space: Space, blocks: list[_Block], part: int) -> Iterator[pa.RecordBatch]:
        c, out = draws.n_classes, []
        for k, mine in by_tree.items():
            places = np.full(len(trees[k].cell), -1)
            nodes = [node for g in mine for node in groups[g][1]]
            places[nodes] = np.arange(len(nodes))
            held, totals = [], np.zeros(len(nodes) * c)
            for block in blocks:
                n = len(block.labels)
                weights = draws.weights(k, part, block.number, n).astype(np.float64)
                at = np.where(weights > 0, places[trees[k].nodes(n, block.cells, block.places)], -1)
                here = np.flatnonzero(at >= 0)
                totals += np.bincount(at[here] * c + block.labels[here], weights[here], len(totals))
                if len(here):
                    held.append((block, at, weights))
            done = 0
            for g in mine:
                size, keys, counts, base = len(groups[g][1]), [], [], 0
                for place in range(done, done + size):
                    found = _counts(space, draws.features(space, k, nodes[place]), place, held, c) if totals[place * c : (place + 1) * c].any() else np.empty(0)
                    keys.append(np.flatnonzero(found) + base)
                    counts.append(found[keys[-1] - base])
                    base += int(_widths(space, draws.features(space, k, nodes[place]))[0].sum()) * c
                whole = totals[done * c : (done + size) * c]
                done += size
                if whole.any():
                    out.append((g, np.concatenate(keys).astype(np.int32), np.concatenate(counts).astype(np.int32), whole.astype(np.int64)))
                if len(out) >= 64:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[j].tobytes() for x in out], pa.binary()) for j in range(1, 4)]], names=[c.split()[0] for c in PARTIAL.split(", ")]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, part, number, blocks = shared.value, TaskContext.get().partitionId(), 0, []
        bounds = np.r_[space.begin, space.end[-1:]].astype(np.int32)
        for batch in batches:
            for i in range(batch.num_rows):
                labels, cells, places = b._arrays(batch, i, labels=np.int32, cells=np.int32, places=np.int32)
                blocks.append(_Block(number, labels, places, cells, np.searchsorted(cells, bounds)))
                number += 1
                if sum(len(x.cells) for x in blocks) >= b.PART_ENTRIES:
                    yield from counted(space, blocks, part)
                    blocks = []
        if blocks:
            yield from counted(space, blocks, part)

    return run


def _gini(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.ones(n.shape)
    for k in range(counts.shape[-1]):
        share = counts[..., k] / n
        out -= share * share
    return out


def _best(shared, groups: list[tuple[int, list[int]]], draws: Draws):
    """Kernel: the best split of each node of a group, from the counts of all tasks."""

    def split(space: Space, features: np.ndarray, table: np.ndarray, whole: np.ndarray) -> tuple[float, int, np.ndarray]:
        """Gain, bin and counts on the left; ``table`` has the counts by bin, without those of the value 0."""
        sizes, local = _widths(space, features)
        table[space.zero[features] - space.begin[features] + local] = whole - np.add.reduceat(table, local)
        left = np.cumsum(table, axis=0)
        left -= np.repeat(np.concatenate([np.zeros((1, left.shape[1]), np.int64), left[local[1:] - 1]]), sizes, axis=0)
        n, n_left = whole.sum(), left.sum(axis=1)
        ok = np.flatnonzero((n_left > 0) & (n_left < n))
        if not len(ok):
            return -1.0, -1, whole
        left, n_left = left[ok], n_left[ok]
        n_right = n - n_left
        gains = _gini(whole[None], np.array([n]))[0] - n_left / n * _gini(left, n_left) - n_right / n * _gini(whole - left, n_right)
        best = int(np.argmax(gains))
        at = int(np.searchsorted(local, ok[best], side="right")) - 1
        return float(gains[best]), int(space.begin[features[at]] + ok[best] - local[at]), left[best]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, group, c = shared.value, key[0].as_py(), draws.n_classes
        k, nodes = groups[group]
        features = [draws.features(space, k, node) for node in nodes]
        base = np.cumsum([0, *[int(_widths(space, f)[0].sum()) * c for f in features]])
        table, totals = np.zeros(base[-1], np.int64), np.zeros(len(nodes) * c, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts, added = b._arrays(batch, i, keys=np.int32, counts=np.int32, totals=np.int64)
                table[keys] += counts  # a key stands once in a row
                totals += added
        out = []
        for place, f in enumerate(features):
            whole = totals[place * c : (place + 1) * c]
            found = split(space, f, table[base[place] : base[place + 1]].reshape(-1, c), whole) if len(f) and whole.any() else (-1.0, -1, whole)
            out.append((group, place, *found[:2], found[2].astype(np.int64).tobytes(), whole.tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in BEST.split(", ")])

    return run


def _groups(level: list[tuple[int, int]], size: int) -> list[tuple[int, list[int]]]:
    out: list[tuple[int, list[int]]] = []
    for k, node in level:
        if out and out[-1][0] == k and len(out[-1][1]) < size:
            out[-1][1].append(node)
        else:
            out.append((k, [node]))
    return out


def _merged(tree: Tree) -> Tree:
    """The tree without splits whose sides both end in leaves of the same class."""
    for node in reversed(range(len(tree.cell))):  # children come after their parent
        sides = tree.children[node]
        if tree.cell[node] >= 0 and all(tree.cell[s] < 0 for s in sides) and len({int(np.argmax(tree.value[s])) for s in sides}) == 1:
            tree.cell[node] = -1
    return tree


def _grow(held: DataFrame, shared, draws: Draws, n_trees: int, max_depth: int) -> list[Tree]:
    """All trees, level by level."""
    space, trees, c = shared.value, [Tree() for _ in range(n_trees)], draws.n_classes
    counts = max(1.0, (len(space.bounds) + len(space.features)) / draws.n_features * draws.per_node * c)  # of a node, about
    size = int(min(GROUP_NODES, max(1, GROUP_COUNTS // counts)))
    level, following = [(k, t.add(np.zeros(c, np.int64), 0)) for k, t in enumerate(trees)], []
    while level:
        groups, level = _groups(level[:MAX_NODES], size), level[MAX_NODES:]
        tasks = min(len(groups), 4 * held.sparkSession.sparkContext.defaultParallelism)
        partial = held.mapInArrow(_histograms(shared, trees, groups, draws), PARTIAL).repartition(tasks, "group")
        found = partial.groupBy("group").applyInArrow(_best(shared, groups, draws), BEST).toArrow()  # a row for each node
        for row in found.sort_by([("group", "ascending"), ("place", "ascending")]).to_pylist():
            k, nodes = groups[row["group"]]
            tree, node = trees[k], nodes[row["place"]]
            left, whole = (np.frombuffer(row[x], np.int64) for x in ("left_counts", "totals"))
            tree.value[node] = whole
            if row["gain"] <= 0 or tree.depth[node] >= max_depth:
                continue
            at = int(np.searchsorted(space.begin, row["cell"], side="right")) - 1
            children = tuple(tree.add(side, tree.depth[node] + 1) for side in (left, whole - left))
            tree.cell[node], tree.children[node] = row["cell"], children
            tree.span[node] = (int(space.begin[at]), int(space.end[at]), bool(space.zero[at] <= row["cell"]))
            if tree.depth[node] + 1 < max_depth:
                following += [(k, child) for child in children if _gini(tree.value[child][None], tree.value[child].sum(keepdims=True))[0] >= EPSILON]
        if not level:
            level, following = following, []
    return [_merged(t) for t in trees]


def forest(rows: DataFrame, n_features: int, n_trees: int, max_depth: int, seed: int, bootstrap: bool = True) -> tuple[Space, list[Tree]]:
    """Thresholds and trees. ``rows``: ``label`` double from 0, and ``v``, a struct of indices and values of ``n_features`` features."""
    n_rows, top, entries = rows.agg(F.count("*"), F.max("label"), F.sum(F.size("v.values"))).first()
    if not n_rows:
        raise ValueError("no rows to learn from")
    spark, entries = rows.sparkSession, entries or 0
    small_batches(rows)
    draws = Draws(seed, n_features, n_features if n_trees == 1 else math.ceil(math.sqrt(n_features)), int(top) + 1, bootstrap)
    shared = spark.sparkContext.broadcast(b.space_of(rows, n_rows, seed))
    parts = max(min(spark.sparkContext.defaultParallelism, math.ceil(entries / b.TASK_ENTRIES)), math.ceil(entries / b.PART_ENTRIES), 1)
    taken = rows.select("label", "v")
    taken = taken.coalesce(parts) if rows.rdd.getNumPartitions() >= parts else taken.repartition(parts)
    blocks = taken.mapInArrow(b._packed(shared), b.BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return shared.value, _grow(blocks, shared, draws, n_trees, max_depth)
    finally:
        blocks.unpersist()


def voted(vector: Column, space: Space, trees: list[Tree]) -> Column:
    """Class with the largest sum of shares in the leaves of all trees, the first of equal ones, for a struct of indices and values."""
    shares = [np.array([x / max(x.sum(), 1) for x in t.value]) for t in trees]
    bare = [replace(t, value=[], depth=[]) for t in trees]

    @arrow_udf("double")
    def label(vectors: pa.Array) -> pa.Array:
        row, feature, value = b._stored(vectors)
        found, cell = space.cells(feature, value)
        order = np.argsort(cell, kind="stable")
        cells, places = cell[order], row[found][order]
        votes = sum(share[t.nodes(len(vectors), cells, places)] for share, t in zip(shares, bare, strict=True))
        return pa.array(np.argmax(votes, axis=1).astype(np.float64))

    return label(vector)
