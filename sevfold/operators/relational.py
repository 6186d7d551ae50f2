"""Projections, filters, joins and unions of ordinary tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sevfold.operators.ranking import hash_of

#: Share of the rows from which on a join key is hot.
HOT_SHARE = 0.005


def project(df: DataFrame, keep: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    return df.select(*keep).withColumnsRenamed(rename or {})


def to_strings(df: DataFrame, null_text: str | None = None) -> DataFrame:
    """All columns as strings; ``null_text`` stands for null where a text is wanted."""

    def as_text(c: str) -> Column:
        text = F.col(c).cast("string")
        return (text if null_text is None else F.coalesce(text, F.lit(null_text))).alias(c)

    return df.select(*[as_text(c) for c in df.columns])


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def drop_null(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull())


def column_counts(df: DataFrame) -> DataFrame:
    """Number of non-null values per column, one row."""
    return df.agg(*[F.count(c).alias(c) for c in df.columns])


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct()


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def reorder(df: DataFrame, first: list[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def with_constants(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def shuffle(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Seeded random order of the rows; the hash spreads evenly over the sort's ranges."""
    return df.orderBy(hash_of(key, seed), *key)


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def first_by(df: DataFrame, key: str, cols: list[str], order: list[str]) -> DataFrame:
    """First row of each key; an aggregate, so a hot key is merged before the shuffle."""
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_first"))
        .select(key, *[F.col(f"_first.{c}").alias(c) for c in cols])
    )


def overwrite_from(df: DataFrame, lookup: DataFrame, key: str, cols: list[str], order: list[str]) -> DataFrame:
    """Replace ``cols`` by the values of the first lookup row; rows without one are dropped."""
    found = first_by(lookup, key, cols, order)
    return df.drop(*cols).join(found, key).select(*df.columns)


def unmatched(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Keys that the lookup table lacks, one row for each input row."""
    return df.join(lookup.select(key).distinct(), key, "left_anti").select(key)


def zip_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Put two tables side by side row by row, by key instead of by position."""
    return a.join(b, key)


def concat_columns(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), frames)


def param_grid(spark: SparkSession, sep: str = "-", **lists: list) -> DataFrame:
    """All combinations of a few short parameter lists, numbered in the order of nested loops."""
    grid = spark.range(1).select(F.lit(0).alias("grid_index"))
    for name, values in lists.items():
        options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(str(v)).alias("v")) for i, v in enumerate(values)])
        grid = grid.withColumn("_o", F.explode(options)).select(
            (F.col("grid_index") * len(values) + F.col("_o.i")).alias("grid_index"),
            *[c for c in grid.columns if c != "grid_index"],
            F.col("_o.v").alias(name),
        )
    return grid.withColumn("parameters", F.concat_ws(sep, *lists))


def rows_at_best(df: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(best.select(*keys), keys, "left_semi")


def join_vectors(tokens: DataFrame, vectors: DataFrame, word: str) -> DataFrame:
    """Vector of each token; tokens without one are skipped. A word has one vector."""
    return join_hot(tokens, vectors, word)


def join_hot(rows: DataFrame, side: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Inner join with a table of unique keys, where some keys may hold a large part of ``rows``.

    Keys with at least ``share`` of the rows are counted first; there are ``1 / share`` of them at
    most, so their part of ``side`` is broadcast and their rows stay where they are. All others are
    joined by their key.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(math.floor(1 / share))  # no other key can be hot
    held = [r[0] for r in top.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).filter(F.col("n") >= F.col("all") * share).select(key).collect()]
    if not held:
        return rows.join(side, key)
    hot = F.col(key).isin(held)
    near = rows.filter(hot).join(F.broadcast(side.filter(hot)), key)
    return near.unionByName(rows.filter(~hot).join(side.filter(~hot), key))


def with_quarantine(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Mark the rows that fail a check: ``_error`` names the first failed one, else null."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return df.withColumn("_error", error)


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = df.filter(F.col("_error").isNull()).drop("_error")
    return good, df.filter(F.col("_error").isNotNull())
