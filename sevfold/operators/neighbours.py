"""Nearest neighbours under the L1 or L2 norm, exact or in a bounded number of cells.

Train rows are put in cells around pivots, whose number grows with the root of the rows. A query
is first compared with its own cell, which gives it a true k-th distance. By the triangle
inequality it then needs only the other cells that reach within that distance. Cells of any size
are cut in chunks; one task compares one chunk of train rows with one chunk of queries and keeps
the k nearest per query. Estimates, by a matrix product in the L2 norm, pick the pairs that are measured.
Where vectors do not cluster, every cell may be within reach; cells are then merged into blocks of a
bounded number of rows, so rows are copied once per chunk of queries and not once per cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from sevfold.sources.paths import ensure_checkpoint_dir

SLACK = 1e-9
BLOCK_CELLS = 4_000_000  # numbers in one block of estimates
CHUNK_ROWS, CHUNK_CELLS = 1 << 14, 1 << 20  # rows, and numbers, of a chunk
CACHED = 1 << 18  # numbers in one step of an L1 estimate
PAIRS = 1 << 16  # pairs measured at once
WIDE = 16  # pairs in a multiple of k from which the estimates cut on
MIN_PIVOTS, MAX_PIVOTS = 32, 4096


def _distances(rows: np.ndarray, point: np.ndarray, p: int) -> np.ndarray:
    gap = rows - point
    return np.abs(gap).sum(axis=-1) if p == 1 else np.sqrt((gap * gap).sum(axis=-1))


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64", copy=False) if len(vectors) else np.zeros((0, 0))


@dataclass(frozen=True)
class Cells:
    """Pivots, the radius and size of each cell, and the distances of its k innermost rows."""

    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    inner: list[np.ndarray]

    def candidates(self, points: np.ndarray, reach: np.ndarray, own: np.ndarray, k: int, p: int, most: int | None = None) -> list[list[int]]:
        """Cells besides ``own`` that may hold a row within ``reach`` of each point, or among its k nearest; the ``most`` nearest of them."""
        to_pivot = np.stack([_distances(points, pivot, p) for pivot in self.pivots], axis=1)
        inner = np.concatenate(self.inner) if self.inner else np.empty(0)
        at = np.repeat(np.arange(len(self.pivots)), [len(i) for i in self.inner])
        if len(inner) >= k:
            upper = np.partition(to_pivot[:, at] + inner, k - 1, axis=1)[:, k - 1]
            reach = np.fmin(reach, upper)
        near = (self.size > 0) & (to_pivot - self.radius <= reach[:, None] * (1 + SLACK) + SLACK)
        near[np.arange(len(points)), own] = False
        if most is not None:
            place = np.argsort(np.argsort(np.where(near, to_pivot, np.inf), axis=1, kind="stable"), axis=1)
            near &= place < most
        return [np.flatnonzero(row).tolist() for row in near]


    def blocks(self, rows: int, p: int) -> tuple[np.ndarray, int]:
        """Block of each cell, and how many there are: cells along a chain of near pivots, about ``rows`` rows in a block."""
        left = np.ones(len(self.pivots), dtype=bool)
        block, at, held, n = np.zeros(len(self.pivots), dtype="int64"), 0, 0, 0
        while left.any():
            if held and held + self.size[at] > rows:
                n, held = n + 1, 0
            block[at], left[at] = n, False
            held += self.size[at]
            at = int(np.where(left, np.nan_to_num(_distances(self.pivots, self.pivots[at], p)), np.inf).argmin())
        return block, n + 1


def _same_keys(asked: pa.ChunkedArray, held: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal keys, in the order of ``asked``; nulls are equal to nothing."""
    known = pc.unique(held)
    a, h = (pc.fill_null(pc.index_in(c, value_set=known, skip_nulls=True), none).to_numpy() for c, none in ((asked, -1), (held, -2)))
    order = np.argsort(h, kind="stable")
    lo, hi = np.searchsorted(h[order], a, side="left"), np.searchsorted(h[order], a, side="right")
    n = hi - lo
    return np.repeat(np.arange(len(a)), n), order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def pick_pivots(train: DataFrame, key: str, vec: str, n: int) -> np.ndarray:
    """``n`` train vectors, drawn by hash; the bound is small and fixed."""
    drawn = train.orderBy(F.md5(F.col(key).cast("string"))).limit(n).select(vec)
    return np.array([r[0] for r in drawn.collect()], dtype="float64")


def assign_cells(train: DataFrame, vec: str, pivots: np.ndarray, p: int) -> DataFrame:
    @pandas_udf("struct<cell int, to_pivot double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        gaps = np.stack([_distances(_stacked(vectors), pivot, p) for pivot in pivots])
        return pd.DataFrame({"cell": gaps.argmin(axis=0).astype("int32"), "to_pivot": gaps.min(axis=0)})

    return train.withColumn("_cell", nearest(F.col(vec))).select(*train.columns, "_cell.*")


def describe_cells(assigned: DataFrame, pivots: np.ndarray, k: int) -> Cells:
    """At most k + 1 numbers per pivot reach the driver."""
    stats = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("to_pivot").alias("r")).collect()
    inner_rank = Window.partitionBy("cell").orderBy("to_pivot")
    inner = (
        assigned.select("cell", "to_pivot").withColumn("_rn", F.row_number().over(inner_rank)).filter(F.col("_rn") <= k)
    ).collect()
    size, radius = np.zeros(len(pivots), dtype="int64"), np.zeros(len(pivots))
    for row in stats:
        size[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    per_cell: list[list[float]] = [[] for _ in pivots]
    for row in inner:
        per_cell[row["cell"]].append(row["to_pivot"])
    return Cells(pivots, radius, size, [np.array(d) for d in per_cell])


def _chunked(visits: DataFrame, assigned: DataFrame, sizes: np.ndarray, chunk_rows: int, compare, schema: str) -> DataFrame:
    """Compare visiting queries with the rows of their blocks, chunk by chunk."""
    load = {r["block"]: r["n"] for r in visits.groupBy("block").agg(F.count("*").alias("n")).collect()}

    def chunks(counts: dict[int, int]):
        needed = [F.lit(max(1, -(-int(counts.get(c, 0)) // chunk_rows))) for c in range(len(sizes))]
        return F.element_at(F.array(*needed), F.col("block") + 1)

    row_chunks, query_chunks = chunks(dict(enumerate(sizes))), chunks(load)
    left = visits.withColumn("qc", F.pmod(F.xxhash64("query"), query_chunks).cast("int")).withColumn(
        "rc", F.explode(F.sequence(F.lit(0), row_chunks - 1))
    )
    right = assigned.withColumn("rc", F.pmod(F.xxhash64("neighbour"), row_chunks).cast("int")).withColumn(
        "qc", F.explode(F.sequence(F.lit(0), query_chunks - 1))
    )
    by = ["block", "rc", "qc"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, schema)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as rows of doubles."""
    column = vectors.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(column), -1)


def _estimates(points: np.ndarray, rows: np.ndarray, p: int) -> tuple[Callable[[slice], np.ndarray], np.ndarray]:
    """A fast estimate of the distances of a slice of points to all rows (squares of them in the L2 norm), and what it may be off for each point."""
    dim = points.shape[1]
    most = max(np.abs(points).max(initial=0), np.abs(rows).max(initial=0))
    if p == 2 and most < 1e100:
        own, other = (points * points).sum(axis=1), (rows * rows).sum(axis=1)
        return lambda part: own[part, None] + other - 2 * (points[part] @ rows.T), (dim + 8) * 1e-15 * (own + other.max(initial=0))
    if p == 1 and most < 1e30:
        low, small, ones = points.astype("float32"), rows.astype("float32"), np.ones(dim, "float32")
        step = max(1, CACHED // dim)
        held = np.empty((min(step, len(rows)), dim), "float32")

        def sums(part: slice) -> np.ndarray:
            out = np.empty((len(low[part]), len(rows)), "float32")
            for at in range(0, len(rows), step):
                here = small[at : at + step]
                gap = held[: len(here)]
                for i, point in enumerate(low[part]):
                    np.abs(np.subtract(here, point, out=gap), out=gap)
                    np.matmul(gap, ones, out=out[i, at : at + step])
            return out

        return sums, (dim + 8) * 2e-7 * (np.abs(points).sum(axis=1) + np.abs(rows).sum(axis=1).max(initial=0))

    def plain(part: slice) -> np.ndarray:  # very large or non-finite numbers
        gaps = np.stack([_distances(rows, point, p) for point in points[part]])
        return gaps * gaps if p == 2 else gaps

    return plain, np.zeros(len(points))


def _nearest(points: np.ndarray, rows: np.ndarray, reach: np.ndarray, same: tuple[np.ndarray, np.ndarray], k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point, row and distance of the k nearest rows within ``reach`` of each point; the first row wins a tie.

    Estimates pick the pairs that may be among them, and only those are measured. ``same`` are pairs to skip, by point.
    """
    estimate, off = _estimates(points, rows, p)
    bound = np.where(np.isfinite(reach), (reach * reach if p == 2 else reach) * (1 + SLACK), np.inf) + off
    found = []
    for start in range(0, len(points), step := max(1, BLOCK_CELLS // max(len(rows), 1))):
        part = slice(start, start + step)
        gaps = estimate(part)
        a, b = np.searchsorted(same[0], [start, start + step])
        gaps[same[0][a:b] - start, same[1][a:b]] = np.inf
        limit = bound[part].copy()
        chosen = gaps <= limit[:, None]
        if len(rows) > k:
            wide = np.flatnonzero(np.count_nonzero(chosen, axis=1) > WIDE * k)
            if len(wide):
                kth = np.partition(gaps[wide], k - 1, axis=1)[:, k - 1]
                limit[wide] = np.fmin(limit[wide], kth * (1 + SLACK) + 2 * off[part][wide])
                chosen[wide] = gaps[wide] <= limit[wide, None]
        chosen[same[0][a:b] - start, same[1][a:b]] = False
        at, row = np.nonzero(chosen)
        apart = [_distances(rows[row[i : i + PAIRS]], points[at[i : i + PAIRS] + start], p) for i in range(0, len(at), PAIRS)]
        gap = np.concatenate(apart) if apart else np.empty(0)
        order = np.lexsort((row, gap, at))
        order = order[np.isfinite(gap[order])]
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order, at = order[place < k], at[place < k]
        found.append((at + start, row[order], gap[order]))
    return tuple(np.concatenate(f) for f in zip(*found))


def knn(
    test: DataFrame, train: DataFrame, key: str, vec: str, k: int, p: int = 2, carry: str | None = None,
    exclude_self: bool = False, pivots: int | None = None, chunk_rows: int | None = None, probes: int | None = None,
) -> DataFrame:
    """The k nearest train rows of each test row: ``key, neighbour, distance, rank`` and ``carry``.

    The smaller neighbour key wins a tie. ``exclude_self`` skips the row with the same key. With ``probes``
    the search is approximate: a query visits that many cells at most, those of the nearest pivots.
    """
    single = {dict(test.dtypes)[vec], dict(train.dtypes)[vec]} == {"array<float>"}
    as_double = F.col(vec).cast("array<float>" if single else "array<double>").alias("vec")  # measured as doubles
    label = (F.col(carry) if carry else F.lit(None).cast("int")).alias("carry")
    queries = test.select(F.col(key).alias("query"), as_double)
    rows = train.select(F.col(key).alias("neighbour"), as_double, label)
    wanted = k + 1 if exclude_self else k

    if pivots is None:
        pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(rows.count())))
    points = pick_pivots(rows, "neighbour", "vec", pivots)
    ensure_checkpoint_dir(train.sparkSession)
    assigned = assign_cells(rows, "vec", points, p).checkpoint()
    cells = describe_cells(assigned, points, wanted)

    types = dict(rows.dtypes)
    schema = f"query {types['neighbour']}, neighbour {types['neighbour']}, distance double, carry {types['carry']}"

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held["neighbour"]))
        at = row = np.empty(0, np.int64)
        gap = np.empty(0)
        if len(asked) and len(held):
            same = _same_keys(asked["query"], held["neighbour"]) if exclude_self else (at, row)
            reach = asked["reach"].to_numpy()
            at, row, gap = _nearest(_matrix(asked["vec"]), _matrix(held["vec"]), np.where(np.isnan(reach), np.inf, reach), same, k, p)
        columns = [asked["query"].take(pa.array(at)), held["neighbour"].take(pa.array(row)), pa.array(gap, pa.float64()), held["carry"].take(pa.array(row))]
        return pa.table(columns, names=["query", "neighbour", "distance", "carry"])

    chunk_rows = chunk_rows or max(1, min(CHUNK_ROWS, CHUNK_CELLS // max(points.shape[-1], 1)))
    at_home = assign_cells(queries, "vec", points, p).select("query", "vec", "cell").checkpoint()
    unknown = F.lit(None).cast("double").alias("reach")
    own = _chunked(at_home.select("query", "vec", F.col("cell").alias("block"), unknown), assigned.withColumnRenamed("cell", "block"), cells.size, chunk_rows, compare, schema).checkpoint()
    kth = own.groupBy("query").agg(F.sort_array(F.collect_list("distance")).alias("d")).select("query", F.get("d", F.lit(k - 1)).alias("reach"))
    asked = at_home.join(kth, "query", "left").checkpoint()
    block_of, n_blocks = cells.blocks(chunk_rows, p)

    def others(merged: bool):
        @pandas_udf("array<int>")
        def needed(vectors: pd.Series, reach: pd.Series, home: pd.Series) -> pd.Series:
            points, bound, own_cell = _stacked(vectors), reach.fillna(np.inf).to_numpy(dtype="float64"), home.to_numpy()
            out: list[list[int]] = []
            for i in range(0, len(points), step := max(1, BLOCK_CELLS // (len(block_of) * (wanted + 1)))):
                part = slice(i, i + step)
                out += cells.candidates(points[part], bound[part], own_cell[part], wanted, p, None if probes is None else probes - 1)
            return pd.Series([np.unique(block_of[[h, *c]]).tolist() for h, c in zip(own_cell, out)] if merged else out, dtype=object)

        return needed("vec", "reach", "cell")

    # One block for many cells is compared at once, where most cells are within reach of a query; with probes, cells are the limit.
    merged = False
    if probes is None and n_blocks < len(points):
        sizes = asked.select(F.size(others(False)).alias("n")).agg(F.sum("n")).first()[0] or 0
        merged = sizes > asked.count() * n_blocks
    visits = asked.withColumn("block", F.explode(others(merged))).select("query", "vec", "block", "reach").checkpoint()
    if merged:
        place = F.element_at(F.array(*[F.lit(int(b)) for b in block_of]), F.col("cell") + 1)
        blocks, sizes = assigned.withColumn("block", place).drop("cell"), np.bincount(block_of, cells.size, n_blocks).astype("int64")
    else:
        blocks, sizes = assigned.withColumnRenamed("cell", "block"), cells.size
    partial = _chunked(visits, blocks, sizes, chunk_rows, compare, schema)
    if not merged:  # a merged block holds the own cell too
        partial = own.unionByName(partial)
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    best = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = [F.col("query").alias(key), "neighbour", "distance", "rank"]
    return best.select(*out, F.col("carry").alias(carry)) if carry else best.select(*out)


def knn_vote(neighbours: DataFrame, key: str, label: str, weights: str = "uniform") -> DataFrame:
    """Label with most votes per query; ``distance`` weighs by 1/distance, and hits at distance 0
    outvote all others. The smallest label wins a tie."""
    if weights == "uniform":
        votes = neighbours.groupBy(key, label).agg(F.lit(0).alias("zeros"), F.count("*").cast("double").alias("votes"))
    else:
        inverse = F.when(F.col("distance") > 0, 1 / F.col("distance")).otherwise(0.0)
        sums = neighbours.groupBy(key, label).agg(
            F.count(F.when(F.col("distance") == 0, 1)).alias("zeros"), F.sum(inverse).alias("votes")
        )
        votes = sums.withColumn("votes", F.when(F.col("zeros") > 0, F.col("zeros").cast("double")).otherwise(F.col("votes")))
    ranked = F.struct(-F.col("zeros"), -F.col("votes"), F.col(label))
    return votes.groupBy(key).agg(F.min_by(F.col(label), ranked).alias("pred"))
