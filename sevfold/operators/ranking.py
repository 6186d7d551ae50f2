"""Positions, cuts and ranks that never sort one whole group in one task.

All orders here are split in buckets first. Counts per bucket are small, their running sums
give every bucket its offset, and only the rows inside a bucket are numbered by a window.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sevfold.functions.code import let
from sevfold.sources.paths import ensure_checkpoint_dir

HASH_DIGITS = 3  # leading hex digits of the hash: 4096 buckets


def hash_of(keys: list[str], seed: int) -> Column:
    """Order of a seeded permutation: the same for any partitioning of the rows. A null part has a mark of its own."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def _bucket(h: Column, digits: int) -> Column:
    return F.substring(h, 1, digits)


def _histogram(hashed: DataFrame, within: list[str], digits: int) -> DataFrame:
    """Rows per hash bucket with the rows before it (``lo``), up to it (``hi``) and in all (``n``)."""
    counts = hashed.groupBy(*within, _bucket(F.col("_h"), digits).alias("_b")).agg(F.count("*").alias("_cnt"))
    group = within or [F.lit(0)]
    ordered = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("hi", F.sum("_cnt").over(ordered))
        .withColumn("n", F.sum("_cnt").over(Window.partitionBy(*group)))
        .withColumn("lo", F.col("hi") - F.col("_cnt"))
    )


def with_index(
    df: DataFrame, key: list[str], seed: int = 42, within: list[str] | None = None,
    out: str = "row_index", digits: int = HASH_DIGITS,
) -> DataFrame:
    """Number the rows from 0 in the order of a seeded shuffle of their unique ``key``.

    With ``within`` each group is numbered on its own; a group of any size is spread over
    ``16 ** digits`` buckets.
    """
    within = within or []
    hashed = df.withColumn("_h", hash_of(key, seed)).withColumn("_b", _bucket(F.col("_h"), digits))
    offsets = _histogram(df.select(*within, hash_of(key, seed).alias("_h")), within, digits)
    offsets = offsets.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_b").alias("_ob"), "lo")
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in within],
        F.col("_b") == F.col("_ob"),
    )
    in_bucket = Window.partitionBy(*within, "_b").orderBy("_h", *key)
    numbered = hashed.withColumn("_rn", F.row_number().over(in_bucket))
    joined = numbered.join(offsets, same)
    return joined.withColumn(out, F.col("lo") + F.col("_rn") - 1).select(*df.columns, out)


def hash_cuts(
    df: DataFrame, key: list[str], cuts: dict[str, Column], seed: int = 42,
    within: list[str] | None = None, digits: int = HASH_DIGITS,
) -> DataFrame:
    """For each cut, the hash of the row that stands at that rank of the shuffled order.

    ``cuts`` maps a name to a rank from 1, written over ``n``, the size of the group. The
    result has one row per group and one column of hashes per cut; rank 0 gives null. Rows
    belong to a cut when their own hash is not above it, so a split needs no join with its
    rows. The buckets that hold a cut are few; they are found first, and only rows in them are
    shuffled and sorted.
    """
    within = within or []
    hashed = df.select(*within, hash_of(key, seed).alias("_h"))
    hist = _histogram(hashed, within, digits)
    ranks = F.explode(
        F.array(*[F.struct(F.lit(name).alias("cut"), rank.cast("long").alias("rank")) for name, rank in cuts.items()])
    )
    wanted = (
        hist.withColumn("_c", ranks)
        .select(*within, "_b", "lo", "hi", "_c.cut", "_c.rank")
        .filter((F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")))
        .select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_b").alias("_wb"), "cut", (F.col("rank") - F.col("lo")).alias("_pos"))
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in within],
        F.col("_b") == F.col("_wb"),
    )
    rows = hashed.withColumn("_b", _bucket(F.col("_h"), digits)).join(bounded(wanted), same)
    in_bucket = Window.partitionBy(*within, "_b", "cut").orderBy("_h")
    at_cut = rows.withColumn("_rn", F.row_number().over(in_bucket)).filter(F.col("_rn") == F.col("_pos"))
    return at_cut.groupBy(*within).agg(
        *[F.max(F.when(F.col("cut") == name, F.col("_h"))).alias(name) for name in cuts]
    )


def bounded(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Offer a side table for broadcast if its bytes, written out, fit; else leave the join to Spark."""
    kept, fits = measured(df, max_bytes)
    return F.broadcast(kept) if fits else kept


def measured(df: DataFrame, max_bytes: int = 64 << 20) -> tuple[DataFrame, bool]:
    """A table, computed once and checkpointed, and whether its bytes, written out, fit."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    return kept, (kept.agg(F.sum(F.octet_length(F.to_json(F.struct(*kept.columns))))).first()[0] or 0) <= max_bytes


def value_buckets(df: DataFrame, value: str, out: str, buckets: int) -> DataFrame:
    """Put numbers into ranges of about equal weight; equal numbers share a range.

    The bounds come from a mergeable sketch inside the same plan. They only balance the work:
    any bounds give the same ranks. A row looks at every ``step``-th bound, then at the
    ``step`` bounds that follow the last one it reaches.
    """
    step = max(1, math.isqrt(buckets))
    probabilities = [i / buckets for i in range(1, buckets)] or [0.5]
    v = F.col(value).cast("double")
    bounds = df.agg(F.percentile_approx(v, probabilities, 20 * buckets).alias("b")).scalar()

    def place(b: Column) -> Column:
        reached = F.size(F.filter(b, lambda x, i: (i % step == 0) & (x <= v)))
        first = F.greatest((reached - 1) * step, F.lit(0))
        return first + F.size(F.filter(F.slice(b, first + 1, F.lit(step)), lambda x: x <= v))

    bounded_rows = df.withColumn("_bounds", bounds)
    return bounded_rows.withColumn(out, F.coalesce(let(F.col("_bounds"), place), F.lit(0))).drop("_bounds")


def mid_rank(df: DataFrame, keys: list[str], value: str, weights: dict[str, Column] | None = None, buckets: int = 64) -> DataFrame:
    """Ranks with ties averaged, one row per distinct value of each group.

    Returns ``keys``, ``value``, ``n_ties``, the summed ``weights`` and ``mid_rank``. Equal
    values are merged before anything is ordered, so ties cost nothing.
    """
    weights = weights or {}
    counts = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n_ties"), *[F.sum(w).alias(name) for name, w in weights.items()])
    )
    ranged = value_buckets(counts, value, "_range", buckets)
    group = keys or [F.lit(0)]
    per_range = ranged.groupBy(*keys, "_range").agg(F.sum("n_ties").alias("_in"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_or"),
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col("_range") == F.col("_or"),
    )
    in_range = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("_upto", F.sum("n_ties").over(in_range)).join(offsets, same)
    rank = F.col("_before") + F.col("_upto") - (F.col("n_ties") - 1) / 2.0
    return ranked.select(*keys, value, "n_ties", *weights, rank.alias("mid_rank"))


def running(
    df: DataFrame, group: list[str], order: str, value: Column, how: str, out: str, span: int = 4096, exclusive: bool = False
) -> DataFrame:
    """Running ``sum`` or ``max`` of a group along a numeric order.

    The order is cut in spans; totals per span are carried over, so that a group of any
    length is spread over many tasks. ``order`` is unique inside a group.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    spans = df.withColumn("_span", F.floor(F.col(order) / span)).withColumn("_v", value)
    totals = spans.groupBy(*group, "_span").agg(agg("_v").alias("_t"))
    earlier = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in group], F.col("_span").alias("_cs"), agg("_t").over(earlier).alias("_carry")
    )
    inside = Window.partitionBy(*group, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    same = reduce(
        lambda a, b: a & b,
        [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group],
        F.col("_span") == F.col("_cs"),
    )
    rows = spans.withColumn("_in", agg("_v").over(inside)).join(carried, same)
    if how == "sum":
        merged = F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_in"), F.lit(0))
    else:
        merged = F.greatest("_carry", "_in")
    return rows.withColumn(out, merged).select(*df.columns, out)
