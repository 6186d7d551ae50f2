"""Exact top-k search by inner product with KD-trees, one per shard of the vectors.

Vectors are dealt by a hash of their id to shards of about ``SHARD_ROWS`` rows. Each shard is a
KD-tree: median splits on the widest side down to leaves of ``LEAF_ROWS`` rows, each with the
tight bounding box of its vectors. No vector of a box can score more than the sum over all
dimensions of the larger of query times low and query times high side; a box inside another has
no larger bound, so going through leaves by falling bound is the order of a best-first traversal
of the tree. A query stops at the first leaf whose bound is below its k-th best score.

The queries come in blocks of about ``BLOCK_ROWS``. Every block first searches one shard; the
k-th scores found there go with the block to all other shards and cut their traversals from the
start. Each pair of block and shard sends at most k rows per query, which are ranked at the end.

Cases. Vectors that are null, have null or non-finite components, or another length than most
vectors take no part. Equal scores go to the smaller id. A query never meets rows of its own id.
Query rows that repeat in all columns are one query; candidate rows that repeat all count. Rows
with a null id take no part. Fewer than k candidates give all of them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sevfold.llm.tables import set_down

SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 4096, 64, 1024
#: Integer scores below this are exact in double precision.
EXACT = 1 << 53

PACKED = "shard int, ids binary, vectors binary, first binary"
FOUND = "query_id long, vec_id long, score long"


def build(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by leaf, and where each leaf starts in it."""
    order, first, todo = np.arange(len(vectors)), [], [(0, len(vectors))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf_rows:
            first.append(a)
            continue
        own = vectors[order[a:b]]
        side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, side], middle, kind="introselect")]
        todo += [(a, a + middle), (a + middle, b)]
    return order, np.array(sorted(first) + [len(vectors)], dtype=np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of ``a`` with rows of ``b``."""
    largest = lambda x: int(np.abs(x).max(initial=0))
    if a.shape[1] * largest(a) * largest(b) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


@dataclass
class Boxes:
    """Nodes of a tree as tight boxes; node 0 is the root, a leaf has no children (-1) and its range of rows."""

    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    rows: np.ndarray


def boxes(vectors: np.ndarray, first: np.ndarray) -> Boxes:
    """Boxes of all nodes over the leaves ``first``: two neighbours make a parent, level by level up to the root."""
    low = [vectors[a:b].min(axis=0) for a, b in zip(first[:-1], first[1:])]
    high = [vectors[a:b].max(axis=0) for a, b in zip(first[:-1], first[1:])]
    children = [(-1, -1)] * len(low)
    level = list(range(len(low)))
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 2):
            pair = level[i : i + 2]
            if len(pair) == 2:
                low.append(np.minimum(low[pair[0]], low[pair[1]]))
                high.append(np.maximum(high[pair[0]], high[pair[1]]))
                children.append((pair[0], pair[1]))
                pair = [len(low) - 1]
            above += pair
        level = above
    rows = np.full((len(low), 2), -1)
    rows[: len(first) - 1] = np.stack([first[:-1], first[1:]], axis=1)
    order = np.arange(len(low))[::-1]  # the root, made last, comes first
    down = np.array(children)[order]
    return Boxes(np.array(low)[order], np.array(high)[order], np.where(down < 0, -1, len(low) - 1 - down), rows[order])


def search(ids: np.ndarray, vectors: np.ndarray, first: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
    """Query positions, ids and scores of the best k per query at or above ``kth``; new k-th scores; bounds worked out.

    Every query goes down the tree best-first: it opens the node with the highest bound among those it has met,
    and stops when that is below its k-th score. Queries at the same node are worked through together.
    """
    tree = boxes(vectors, first)
    lowest = np.iinfo(np.int64).min
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = np.full((len(queries), len(tree.low)), lowest)  # of the nodes met and not yet opened
    bound[:, :1] = product(up, tree.high[:1]) + product(down, tree.low[:1])
    seen = len(queries)
    best = np.full((len(queries), k), lowest)
    kth = kth.copy()
    every = np.arange(len(queries))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        node = bound.argmax(axis=1)
        top = bound[every, node]
        open_ = every[(top >= kth) & (top > lowest)]
        if not len(open_):
            break
        bound[open_, node[open_]] = lowest
        order = open_[np.argsort(node[open_], kind="stable")]
        for at in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            j = node[at[0]]
            a, b = tree.rows[j]
            if a < 0:
                below = tree.children[j]
                bound[at[:, None], below] = product(up[at], tree.high[below]) + product(down[at], tree.low[below])
                seen += 2 * len(at)
                continue
            s = product(queries[at], vectors[a:b])
            other = ids[a:b][None, :] != query_ids[at][:, None]
            row, col = np.nonzero((s >= kth[at][:, None]) & other)
            found.append((at[row], ids[a:b][col], s[row, col]))
            merged = np.concatenate([best[at], np.where(other, s, lowest)], axis=1)
            best[at] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
            kth[at] = np.maximum(kth[at], best[at].min(axis=1))
    q, i, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 3
    keep = s >= kth[q]
    q, i, s = q[keep], i[keep], s[keep]
    sort = np.lexsort((i, -s, q))
    q, i, s = q[sort], i[sort], s[sort]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[rank < k], i[rank < k], s[rank < k], kth, seen


def _pack(tree: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["vec_id"].to_numpy(dtype=np.int64)
        vectors = np.stack([np.asarray(v, dtype=np.int64) for v in rows["v"]])
        if tree:
            order, first = build(vectors)
        else:
            order, first = np.lexsort((ids,)), np.zeros(1, dtype=np.int64)
        return pd.DataFrame({"shard": [key[0]], "ids": [ids[order].tobytes()], "vectors": [vectors[order].tobytes()], "first": [first.tobytes()]})

    return run


def _long(cell) -> np.ndarray:
    return np.frombuffer(cell.as_py(), dtype=np.int64)


def _searcher(k: int, thresholds: bool):
    """Search a tree for each row; give k-th scores per block and rows found, or rows found only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda c: _long(batch.column(c)[r])  # noqa: B023, E731
                ids, query_ids = cell("ids"), cell("query_ids")
                vectors, queries = cell("vectors").reshape(len(ids), -1), cell("queries").reshape(len(query_ids), -1)
                kth = cell("kth") if batch.column("kth")[r].is_valid else np.full(len(query_ids), np.iinfo(np.int64).min)
                q, i, s, kth, _ = search(ids, vectors, cell("first"), query_ids, queries, kth, k)
                if thresholds:
                    columns = [pa.array([batch.column("block")[r].as_py()], pa.int32()), pa.array([kth.tobytes()]), *[pa.array([x.tobytes()]) for x in (query_ids[q], i, s)]]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "kth", "q", "i", "s"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_ids[q], i, s)], names=["query_id", "vec_id", "score"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(_long(batch.column(c)[r])) for c in ("q", "i", "s")], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query.

    Components are ``floor(scale * x)``. Queries are the rows where ``is_query`` holds. Vectors whose scores may pass 64 bits are an error.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = vectors.withColumn("_query", is_query).filter("vec_id is not null and embedding is not null").filter(finite & (F.size("embedding") > 0))
    usable = usable.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"),
        F.coalesce("_query", F.lit(False)).alias("query"), F.array_max(F.transform("embedding", lambda x: F.abs(F.floor(scale * x.cast("double")).cast("double")))).alias("m"),
    )
    lengths = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("query").cast("int")).alias("n_query"), F.max("m").alias("m")).orderBy(F.desc("n"), "d").head()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if lengths["d"] * lengths["m"] ** 2 >= 2.0**63:
        raise OverflowError("scores of these vectors may pass 64 bits; choose a smaller scale")
    usable = usable.filter(F.size("v") == lengths["d"])
    n_shards, n_blocks = -(-lengths["n"] // SHARD_ROWS), max(1, -(-lengths["n_query"] // BLOCK_ROWS))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("shard")
    trees = set_down(usable.select(place(n_shards), "vec_id", "v").groupBy("shard").applyInPandas(_pack(True), PACKED), "trees")
    queries = usable.filter("query").select("vec_id", "v").dropDuplicates()
    blocks = set_down(
        queries.select(place(n_blocks), "vec_id", "v").groupBy("shard").applyInPandas(_pack(False), PACKED)
        .select(F.col("shard").alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")),
        "blocks",
    )
    home = F.pmod(F.col("block"), F.lit(n_shards))
    first = set_down(
        blocks.withColumn("shard", home).withColumn("kth", F.lit(None).cast("binary")).join(trees, "shard").mapInArrow(_searcher(k, True), "block int, kth binary, q binary, i binary, s binary"),
        "first",
    )
    rest = (
        blocks.join(first.select("block", "kth"), "block")
        .withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: s != home)))
        .join(trees, "shard").mapInArrow(_searcher(k, False), FOUND)
    )
    both = first.select("q", "i", "s").mapInArrow(_unpacked, FOUND).unionAll(rest)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
