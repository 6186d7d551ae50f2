"""Queries on classification metrics, from a rule's predictions on the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sevfold.operators import metrics as m
from sevfold.queries import derived as d
from sevfold.queries.registry import Tables, query

CM = f"{d.PREDS4}, cm AS (SELECT source, gold, pred, count(*) AS n FROM preds4 GROUP BY 1, 2, 3)"
CM_BINARY = f"{d.PREDS}, cm AS (SELECT lang AS source, gold, pred, count(*) AS n FROM preds GROUP BY 1, 2, 3)"
CLASSES = """labels0 AS (SELECT source, gold AS label FROM cm UNION SELECT source, pred FROM cm),
tp AS (SELECT source, gold AS label, n FROM cm WHERE gold = pred),
g AS (SELECT source, gold AS label, sum(n) AS n FROM cm GROUP BY 1, 2),
p AS (SELECT source, pred AS label, sum(n) AS n FROM cm GROUP BY 1, 2),
per_class AS (
  SELECT source, label, coalesce(tp.n, 0) AS tp, coalesce(g.n, 0) AS n_gold, coalesce(p.n, 0) AS n_pred,
         CASE WHEN coalesce(p.n, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(tp.n, 0)::DOUBLE / p.n END AS prec,
         CASE WHEN coalesce(g.n, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(tp.n, 0)::DOUBLE / g.n END AS rec
  FROM labels0 LEFT JOIN tp USING (source, label) LEFT JOIN g USING (source, label) LEFT JOIN p USING (source, label)),
scored AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0::DOUBLE ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM per_class)"""
MCC = """CASE WHEN (power(sum(n_gold), 2) - sum(power(n_pred, 2))) * (power(sum(n_gold), 2) - sum(power(n_gold, 2))) <= 0 THEN 0.0::DOUBLE
  ELSE (sum(tp)::DOUBLE * sum(n_gold) - sum(n_gold::DOUBLE * n_pred))
       / sqrt((power(sum(n_gold), 2) - sum(power(n_pred, 2))) * (power(sum(n_gold), 2) - sum(power(n_gold, 2)))) END"""
NAMES = ("precision", "recall", "f1")


def matrix(t: Tables) -> DataFrame:
    return m.confusion(d.preds4(t), "gold", "pred", ["source"])


def binary_matrix(t: Tables) -> DataFrame:
    return m.confusion(d.preds(t), "gold", "pred", ["lang"])


def rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("a6_confusion", f"WITH {CM} SELECT source, gold, pred, n FROM cm")
def a6(t: Tables) -> DataFrame:
    return matrix(t)


@query(
    "a7_accuracy",
    f"WITH {CM} SELECT source, round(sum(CASE WHEN gold = pred THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS accuracy FROM cm GROUP BY 1",
)
def a7(t: Tables) -> DataFrame:
    return rounded(m.accuracy(matrix(t), ["source"]), ["accuracy"])


@query(
    "a8_macro_prf",
    f"""WITH {CM}, {CLASSES} SELECT source, round(avg(prec), 6) AS precision, round(avg(rec), 6) AS recall, round(avg(f1), 6) AS f1
        FROM scored GROUP BY 1""",
)
def a8(t: Tables) -> DataFrame:
    return rounded(m.prf(matrix(t), "macro", ["source"]), NAMES)


@query(
    "a9_weighted_prf",
    f"""WITH {CM}, {CLASSES}
        SELECT source, round(sum(prec * n_gold) / sum(n_gold), 6) AS precision, round(sum(rec * n_gold) / sum(n_gold), 6) AS recall,
               round(sum(f1 * n_gold) / sum(n_gold), 6) AS f1
        FROM scored GROUP BY 1""",
)
def a9(t: Tables) -> DataFrame:
    return rounded(m.prf(matrix(t), "weighted", ["source"]), NAMES)


@query(
    "a10_binary_prf",
    f"""WITH {CM_BINARY}, {CLASSES}
        SELECT source AS lang, round(coalesce(max(CASE WHEN label = 1 THEN prec END), 0), 6) AS precision,
               round(coalesce(max(CASE WHEN label = 1 THEN rec END), 0), 6) AS recall,
               round(coalesce(max(CASE WHEN label = 1 THEN f1 END), 0), 6) AS f1
        FROM scored GROUP BY 1""",
)
def a10(t: Tables) -> DataFrame:
    return rounded(m.prf(binary_matrix(t), "binary", ["lang"]), NAMES)


@query(
    "a10_micro_prf",
    f"""WITH {CM}, {CLASSES}
        SELECT source, round(sum(tp)::DOUBLE / sum(n_pred), 6) AS precision, round(sum(tp)::DOUBLE / sum(n_gold), 6) AS recall,
               round(sum(tp)::DOUBLE / sum(n_gold), 6) AS f1
        FROM scored GROUP BY 1""",
)
def a10b(t: Tables) -> DataFrame:
    return rounded(m.prf(matrix(t), "micro", ["source"]), NAMES)


@query(
    "a11_gmean",
    f"WITH {CM}, {CLASSES} SELECT source, round(sqrt(avg(prec) * avg(rec)), 6) AS gmean FROM scored GROUP BY 1",
)
def a11(t: Tables) -> DataFrame:
    macro = m.prf(matrix(t), "macro", ["source"])
    return macro.select("source", F.round(m.gmean(F.col("precision"), F.col("recall")), 6).alias("gmean"))


@query("a12_mcc", f"WITH {CM}, {CLASSES} SELECT source, round({MCC}, 6) AS mcc FROM scored GROUP BY 1")
def a12(t: Tables) -> DataFrame:
    return rounded(m.mcc(matrix(t), ["source"]), ["mcc"])


@query(
    "a13_one_gold_class",
    """WITH cm AS (
         SELECT lang AS source, lang AS gold, CASE WHEN n_chars % 5 = 0 THEN 'en' ELSE lang END AS pred, count(*) AS n
         FROM documents GROUP BY 1, 2, 3),
       acc AS (SELECT source, round(sum(CASE WHEN gold = pred THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS a FROM cm GROUP BY 1)
       SELECT source AS lang, a AS acc, a AS prec, a AS rec, a AS gmean, a AS f1, 0.0::DOUBLE AS mcc FROM acc""",
)
def a13(t: Tables) -> DataFrame:
    pred = F.when(F.col("n_chars") % 5 == 0, "en").otherwise(F.col("lang"))
    rows = t.documents.select("lang", F.col("lang").alias("gold"), pred.alias("pred"))
    return m.metrics_row(m.confusion(rows, "gold", "pred", ["lang"]), ["lang"], digits=6)


METRICS_ROW = f"""WITH {CM}, {CLASSES},
raw AS (
  SELECT source, sum(tp)::DOUBLE / sum(n_gold) AS acc, avg(prec) AS mp, avg(rec) AS mr, avg(f1) AS mf, {MCC} AS mcc,
         count(CASE WHEN n_gold > 0 THEN 1 END) AS n_classes
  FROM scored GROUP BY 1),
rule AS (
  SELECT source, acc, CASE WHEN n_classes = 1 THEN acc ELSE mp END AS prec, CASE WHEN n_classes = 1 THEN acc ELSE mr END AS rec,
         CASE WHEN n_classes = 1 THEN acc ELSE mf END AS f1, mcc FROM raw)"""


@query(
    "a14_metrics_row",
    f"""{METRICS_ROW} SELECT source, round(round(acc, 10), 3) AS acc, round(round(prec, 10), 3) AS prec, round(round(rec, 10), 3) AS rec,
        round(round(sqrt(prec * rec), 10), 3) AS gmean, round(round(f1, 10), 3) AS f1, round(round(mcc, 10), 3) AS mcc FROM rule""",
)
def a14(t: Tables) -> DataFrame:
    return m.metrics_row(matrix(t), ["source"])


@query(
    "f36_format_metrics",
    f"""{METRICS_ROW} SELECT concat_ws(chr(9), source, printf('%.5f', acc), printf('%.5f', prec), printf('%.5f', rec),
        printf('%.5f', f1), printf('%.5f', mcc)) AS line FROM rule""",
)
def f36(t: Tables) -> DataFrame:
    return m.format_metrics(m.metrics_row(matrix(t), ["source"], digits=None), ["source"], ["acc", "prec", "rec", "f1", "mcc"])


@query(
    "u5_label_universe",
    f"WITH {CM} SELECT source, gold AS label FROM cm UNION SELECT source, pred FROM cm",
)
def u5(t: Tables) -> DataFrame:
    return m.class_table(matrix(t), ["source"]).select("source", "label")


@query(
    "flagship_metrics_by_lang",
    f"""WITH {CM_BINARY}, {CLASSES}
        SELECT source AS lang, round(sum(tp)::DOUBLE / sum(n_gold), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round({MCC}, 6) AS mcc
        FROM scored GROUP BY 1""",
)
def flagship(t: Tables) -> DataFrame:
    """Labelled documents against a rule: accuracy, macro F1 and MCC per language."""
    classes = m.class_table(binary_matrix(t), ["lang"])
    row = classes.groupBy("lang").agg(
        (F.sum("tp") / F.sum("n_gold")).alias("accuracy"), F.avg("f1").alias("macro_f1"), m.mcc_of_classes().alias("mcc")
    )
    return rounded(row, ["accuracy", "macro_f1", "mcc"])
