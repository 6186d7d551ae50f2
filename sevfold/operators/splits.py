"""Train, validation and test splits, stratified samples and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sevfold.operators.ranking import bounded, hash_cuts, hash_of


def as_scalar(row: DataFrame) -> Column:
    """A one-row table as one struct. It is computed here, once for all its uses."""
    return bounded(row).select(F.struct(*row.columns).alias("row")).scalar()


def group_split(df: DataFrame, key: str, seed: int = 42, approx: bool = False) -> DataFrame:
    """80/10/10 split in which no ``key`` is in two parts.

    Exact form: of n distinct keys, ceil(0.2 n) are held out; the larger half is ``valid``,
    the rest ``test``. Two hash values, found on the distinct keys, decide for every row, so
    the rows are neither shuffled nor joined. Rows without key count as one more key. ``approx`` fixes the parts by hash range alone:
    no pass over the keys, and appended rows never move a key.
    """
    n = F.col("n")
    held = F.ceil(n * 0.2)
    if approx:
        position = F.conv(F.substring(hash_of([key], seed), 1, 8), 16, 10).cast("double") / float(16**8)
        return df.withColumn("split", F.when(position < 0.8, "train").when(position < 0.9, "valid").otherwise("test"))
    keys = df.select(key).distinct()
    cuts = hash_cuts(keys, [key], {"train": n - held, "valid": n - held + F.ceil(held / 2)}, seed)
    h = hash_of([key], seed)
    cut = as_scalar(cuts)
    in_train = h <= F.coalesce(cut["train"], F.lit(""))
    in_valid = h <= F.coalesce(cut["valid"], F.lit(""))
    return df.withColumn("split", F.when(in_train, "train").when(in_valid, "valid").otherwise("test"))


def split_by_column(df: DataFrame, c: str = "partition") -> dict[str, DataFrame]:
    return {part: df.filter(F.col(c) == part) for part in ("train", "valid", "test")}


def stratified_fractions(
    df: DataFrame, cls: str, key: str, ratios: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8), seed: int = 42
) -> DataFrame:
    """Samples with exactly floor(n * r) rows of each class; smaller samples lie in larger ones.

    One output row per sample and row, with the column ``ratio``. Rows without a class are
    dropped. ``key`` is unique.
    """
    labelled = df.filter(F.col(cls).isNotNull())
    cuts = hash_cuts(labelled, [key], {f"_r{i}": F.floor(F.col("n") * r) for i, r in enumerate(ratios)}, seed, [cls])
    cut_list = F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(f"_r{i}").alias("cut")) for i, r in enumerate(ratios)])
    joined = labelled.join(bounded(cuts), cls).select(*df.columns, F.inline(cut_list))
    return joined.filter(hash_of([key], seed) <= F.col("cut")).drop("cut")


def fold_ends(n: Column, folds: int | list[float]) -> list[Column]:
    """Last row index of each fold. The bounds are inclusive: the first fold has one row more."""
    if isinstance(folds, int):
        size = F.floor(n / folds)
        return [size * (i + 1) for i in range(folds - 1)]
    ends, total = [], F.lit(0)
    for share in folds[:-1]:
        total = total + F.floor(n * share)
        ends.append(total)
    return ends


def assign_folds(df: DataFrame, key: str, folds: int | list[float], seed: int = 42) -> DataFrame:
    """Contiguous folds over the shuffled rows: equal ones, or by a list of shares."""
    n = F.col("n")
    ends = fold_ends(n, folds)
    cuts = hash_cuts(df, [key], {f"_e{i}": F.least(end + 1, n) for i, end in enumerate(ends)}, seed)
    h = hash_of([key], seed)
    cut = as_scalar(cuts)
    above = [F.when(h > cut[f"_e{i}"], 1).otherwise(0) for i in range(len(ends))]
    fold = sum(above[1:], above[0]) if above else F.lit(0)
    return df.withColumn("fold", fold.cast("int"))


def rotate_folds(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Each row once per rotation: fold i+1 validates, fold i+2 tests, the others train."""
    step = F.pmod(F.col(fold) - F.col("rotation"), F.lit(k))
    rotated = df.withColumn("rotation", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    part = F.when(step == 1 % k, "valid").when(step == 2 % k, "test").otherwise("train")
    return rotated.withColumn("partition", part)
