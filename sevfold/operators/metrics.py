"""Classification metrics, all from one confusion matrix.

The labelled rows are read once, by ``confusion``; what follows works on at most one row per
pair of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NOISE = 10  # decimals beyond which sums differ by the order of adding; cut before rounding


def confusion(df: DataFrame, gold: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or []), F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_table(cm: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per class: hits, gold count, predicted count, precision, recall and F1.

    The classes are those of gold and prediction together; an empty denominator gives 0.
    """
    keys = keys or []
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.explode(
        F.array(
            F.struct(F.col("gold").alias("label"), hit.alias("tp"), F.col("n").alias("n_gold"), F.lit(0).cast("long").alias("n_pred")),
            F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("n_gold"), F.col("n").alias("n_pred")),
        )
    )
    sums = (
        cm.select(*keys, sides.alias("_s"))
        .select(*keys, "_s.*")
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "n_gold", "n_pred")])
    )
    return sums.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("n_pred")),
            "recall": ratio(F.col("tp"), F.col("n_gold")),
            "f1": ratio(2 * F.col("tp"), F.col("n_gold") + F.col("n_pred")),
        }
    )


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def accuracy(cm: DataFrame, keys: list[str] | None = None) -> DataFrame:
    hits = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    return cm.groupBy(*(keys or [])).agg((hits / F.sum("n")).alias("accuracy"))


def prf(cm: DataFrame, average: str, keys: list[str] | None = None, positive=1) -> DataFrame:
    """Precision, recall and F1 as ``macro``, ``weighted``, ``micro`` or ``binary`` average."""
    per_class = class_table(cm, keys)
    names = ("precision", "recall", "f1")
    if average == "macro":
        aggs = [F.avg(m).alias(m) for m in names]
    elif average == "weighted":
        aggs = [(F.sum(F.col(m) * F.col("n_gold")) / F.sum("n_gold")).alias(m) for m in names]
    elif average == "micro":
        tp, gold, pred = F.sum("tp"), F.sum("n_gold"), F.sum("n_pred")
        aggs = [ratio(tp, pred).alias("precision"), ratio(tp, gold).alias("recall"), ratio(2 * tp, gold + pred).alias("f1")]
    elif average == "binary":
        is_positive = F.col("label") == F.lit(positive)
        aggs = [F.coalesce(F.max(F.when(is_positive, F.col(m))), F.lit(0.0)).alias(m) for m in names]
    else:
        raise ValueError(f"unknown average {average!r}")
    return per_class.groupBy(*(keys or [])).agg(*aggs)


def gmean(precision: Column, recall: Column) -> Column:
    return F.sqrt(precision * recall)


def mcc_of_classes() -> Column:
    """Matthews correlation as an aggregate over the rows of ``class_table``."""
    tp, gold, pred = (F.col(c).cast("double") for c in ("tp", "n_gold", "n_pred"))
    total = F.sum(gold)
    covariance = F.sum(tp) * total - F.sum(gold * pred)
    spread = (total * total - F.sum(pred * pred)) * (total * total - F.sum(gold * gold))
    return F.when(spread <= 0, 0.0).otherwise(covariance / F.sqrt(spread))


def mcc(cm: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return class_table(cm, keys).groupBy(*(keys or [])).agg(mcc_of_classes().alias("mcc"))


def metrics_row(cm: DataFrame, keys: list[str] | None = None, digits: int | None = 3) -> DataFrame:
    """One row of metrics per key: acc, prec, rec, gmean, f1 (macro) and mcc.

    Where gold has one class only, precision, recall and F1 equal the accuracy.
    """
    keys = keys or []
    classes = class_table(cm, keys)
    acc = F.sum("tp") / F.sum("n_gold")
    raw = classes.groupBy(*keys).agg(
        acc.alias("acc"),
        *[
            F.when(F.sum(F.when(F.col("n_gold") > 0, 1).otherwise(0)) == 1, acc).otherwise(F.avg(m)).alias(short)
            for m, short in (("precision", "prec"), ("recall", "rec"), ("f1", "f1"))
        ],
        mcc_of_classes().alias("mcc"),
    )
    full = raw.withColumn("gmean", gmean(F.col("prec"), F.col("rec")))
    names = ("acc", "prec", "rec", "gmean", "f1", "mcc")
    shown = [F.col(m) if digits is None else F.round(F.round(m, NOISE), digits).alias(m) for m in names]
    return full.select(*keys, *shown)


def average_row(cm: DataFrame, average: str, keys: list[str] | None = None, positive=1, digits: int | None = None) -> DataFrame:
    """acc, prec, rec, f1 and mcc per key with a ``macro``, ``weighted``, ``micro`` or ``binary`` average."""
    keys = keys or []
    parts = [accuracy(cm, keys), prf(cm, average, keys, positive), mcc(cm, keys)]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, keys) if keys else joined.crossJoin(part)  # one row each
    names = {"acc": "accuracy", "prec": "precision", "rec": "recall", "f1": "f1", "mcc": "mcc"}
    return joined.select(*keys, *[(F.col(c) if digits is None else F.round(F.round(c, NOISE), digits)).alias(n) for n, c in names.items()])


def format_metrics(df: DataFrame, keys: list[str], names: list[str], digits: int = 5, sep: str = "\t") -> DataFrame:
    """Each row as one text line with a fixed number of decimals."""
    cells = [F.col(k).cast("string") for k in keys] + [F.format_string(f"%.{digits}f", F.col(n)) for n in names]
    return df.select(F.concat_ws(sep, *cells).alias("line"))
