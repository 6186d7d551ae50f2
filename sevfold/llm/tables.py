"""Small helpers for jobs of several steps: tables set down between steps, checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sevfold.sources.paths import scratch

BROADCAST_BYTES = 32 << 20


#: Rows of an Arrow batch of whole texts: it bounds what a task holds on both sides of a Python worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have the session send at most ``BATCH_ROWS`` rows to Python at once; a lower setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def set_down(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast of a table that is set down already, if its counted rows fit in ``limit``."""
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``(a, b)`` long edges: ``(node, comp)`` with the smallest node as name.

    Alternates the large-star and the small-star step; each round is a table in the shared
    folder. A node of any degree is spread: minima are partial aggregates, and joins may split.
    """
    links = set_down(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = set_down(small.filter("a <> b").distinct(), "links")
        if new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty():
            break
        links = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
