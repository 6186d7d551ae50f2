"""Queries that train feature models and classifiers; checked by rows, not by SQL."""

from __future__ import annotations

from itertools import product

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from sevfold.functions.text import code_tokens
from sevfold.operators.metrics import confusion, metrics_row
from sevfold.plans import features as ft, models as md
from sevfold.plans.results import GRIDS, average_results, best_per_group
from sevfold.queries import derived as d
from sevfold.queries.registry import Tables, query
from sevfold.queries.text import CODE_TOKEN_SQL
from sevfold.queries.vectors import desc_sql
from sevfold.sources import readers
from sevfold.sources.paths import scratch
from sevfold.sources.schemas import JOBS


def vectors(t: Tables) -> DataFrame:
    """Documents as token counts, labelled with their language."""
    f = d.funcs(t)
    train = f.filter("partition = 'train'")
    model = ft.bow_model(train, "func_before", out="features")
    indexer = ft.indexed_label("lang").fit(train)
    return indexer.transform(ft.bow_vectors(f, model, "func_before")).select("id", "partition", "label", "features")


def counts_sql(table: str, key: str, text: str, fit: str = "TRUE") -> str:
    """Token counts over the 10,000 most frequent tokens of the rows in ``fit``, tokens as alphabetical numbers."""
    return f"""tokens AS (SELECT {key} AS doc_key, {fit} AS fitted, unnest(regexp_extract_all({text}, {CODE_TOKEN_SQL})) AS term FROM {table}),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place FROM (SELECT term FROM tokens WHERE fitted GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 10000)),
counted AS (SELECT doc_key, CAST(place AS INT) AS place, count(*)::DOUBLE AS n FROM tokens JOIN vocab USING (term) GROUP BY 1, 2)"""


@query(
    "m1_bow_vectors",
    f"""WITH {d.FUNCS}, {counts_sql('funcs', 'id', 'func_before', "partition = 'train'")},
        labels AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label FROM (SELECT DISTINCT lang FROM funcs WHERE partition = 'train'))
        SELECT id, any_value(label)::DOUBLE AS label, coalesce(sum(n), 0)::DOUBLE AS n_tokens FROM funcs JOIN labels USING (lang) LEFT JOIN counted ON doc_key = id GROUP BY 1""",
)
def m1(t: Tables) -> DataFrame:
    counted = vectors(t).select("id", "label", ft.stored_values("features").alias("v"))
    return counted.select("id", "label", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("n_tokens"))


@query(
    "m2_desc_vectors",
    f"""WITH {desc_sql(2)}, places AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS place FROM vocab),
        weighed AS (SELECT doc_id, place, tf * (ln((1 + (SELECT n FROM train))::DOUBLE / (1 + df)) + 1) AS w FROM terms JOIN places USING (term))
        SELECT doc_id, CAST(place AS INT) AS place, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighed""",
)
def m2(t: Tables) -> DataFrame:
    docs = d.documents(t).select("doc_id", "text", "partition")
    out = ft.desc_vectors(docs, docs.filter("partition = 'train'"), "text", 6)
    kept = ft.drop_empty_vectors(out, "features").select("doc_id", ft.stored("features").alias("v"))
    cells = kept.select("doc_id", F.inline(F.arrays_zip(F.col("v.indices").alias("place"), F.col("v.values").alias("weight"))))
    return cells.withColumn("weight", F.round("weight", 6))


@query(
    "m4_assemble",
    """SELECT vec_id, CAST(unnest(range(len(embedding) + 1)) AS INT) AS at,
              round(unnest(list_append(embedding::DOUBLE[], label::DOUBLE)), 9) AS value FROM embeddings""",
)
def m4(t: Tables) -> DataFrame:
    blocks = ft.embedding_features(t.embeddings, "embedding", "a").withColumn("b", F.col("label").cast("double"))
    both = ft.assemble(blocks, ["a", "b"])
    return both.select("vec_id", F.posexplode(vector_to_array("features")).alias("at", "value")).withColumn("value", F.round("value", 9))


@query("m5_word_vectors")
def m5(t: Tables) -> DataFrame:
    return ft.train_word_vectors(t.documents, "text", min_count=2).select("word", F.size(vector_to_array("vector")).alias("size"))


@query("m7_pair_features")
def m7(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", F.col("text").alias("prev"), F.replace(F.col("text"), F.lit(". "), F.lit(" ##<END>##\n")).alias("cur"))
    words = ft.train_word_vectors(texts, "prev", min_count=1)
    bow = ft.bow_model(texts, "prev")
    pairs = ft.pair_features(texts, "doc_id", "prev", "cur", words.withColumn("vector", vector_to_array("vector")), bow)
    return pairs.select("doc_id", F.size(vector_to_array("features")).alias("size"))


SIDE_SQL = f"WITH {counts_sql('documents', 'doc_id', 'text')} SELECT doc_key AS doc_id, place, n FROM counted"


@query("m7_side_features", SIDE_SQL)
def m7b(t: Tables) -> DataFrame:
    bow = ft.bow_model(t.documents, "text")
    side = ft.side_features(t.documents, "doc_id", "text", bow)
    return side.select("doc_id", F.inline(F.arrays_zip(ft.stored("features")["indices"].alias("place"), ft.stored("features")["values"].alias("n"))))


def register_classifier(name: str, classifier: str, *params) -> None:
    @query(name)
    def classified(t: Tables) -> DataFrame:
        held, parts = md.held_parts(vectors(t))
        try:
            n_rows = parts["train"].count() if classifier in ("svm", "lr") else 1
            rows = md.scored(md.classifier(classifier, *params, n_rows=n_rows), parts)
        finally:
            held.unpersist()
        pairs = t.spark.createDataFrame([r[:4] for r in rows], "part string, gold int, pred int, n long")
        return metrics_row(pairs.groupBy("gold", "pred").agg(F.sum("n").alias("n")))


register_classifier("m8_naive_bayes", "nb")
register_classifier("m9_linear_svm", "svm", 0.1)
register_classifier("m10_logistic_regression", "lr", 0.1)
register_classifier("m11_random_forest", "rf", 100, 100)
register_classifier("m12_boosted_trees", "gbt", 10, 32)


@query("m13_knn_classifier")
def m13(t: Tables) -> DataFrame:
    rows = ft.embedding_features(t.embeddings, "embedding").select("vec_id", F.col("label").cast("double").alias("label"), "features")
    train, rest = rows.filter("vec_id % 10 < 8"), rows.filter("vec_id % 10 >= 8")
    pred = md.predictions(md.classifier("knn", 5, "distance", 2), train, rest, "vec_id")
    return metrics_row(confusion(pred, "gold", "pred"))


#: The first number of trees of the search, with every number of leaves.
FOREST = [p for p in product(*GRIDS["rf"].values()) if p[0] == GRIDS["rf"]["estimators"][0]]
JOB = {"problem": "lang", "granularity": "method", "scope": "whole", "feature": "bow"}


@query("m14_run_grid")
def m14(t: Tables) -> DataFrame:
    return md.run_grid(vectors(t), JOB, {"nb": [()], "rf": FOREST})


@query("m14_best_of_grid")
def m14b(t: Tables) -> DataFrame:
    return md.best_of_grid(md.run_grid(vectors(t), JOB, {"nb": [()], "rf": FOREST[:1]}))


@query("m14_run_jobs")
def m14c(t: Tables) -> DataFrame:
    """A job list read from a file, over code and over stored vectors; the best row of each job."""
    jobs, path = scratch(t.spark, "jobs"), scratch(t.spark, "cells")
    listed = t.spark.createDataFrame([("method", "whole", "severity", f) for f in ("bow", "subwords", "codebert")], JOBS)
    listed.write.csv(jobs)
    code = d.funcs(t).select(F.col("func_before").alias("code"), "severity", "partition")
    stored = t.embeddings.select(F.to_json(F.col("embedding").cast("array<double>")).alias("codebert"), F.col("label").cast("string").alias("severity"), F.expr(d.PARTITION_SQL.replace("doc_id", "vec_id")).alias("partition"))

    def features_of(job: dict[str, str]) -> DataFrame:
        return md.job_features(stored if job["feature"] == "codebert" else code, job["feature"], job["cvss_col"])

    results = md.run_jobs(readers.read_jobs(t.spark, jobs), features_of, path, {"rf": FOREST[:1]})
    return best_per_group(average_results(results), ["problem", "granularity", "scope", "feature"])


@query("m14_description_grid")
def m14d(t: Tables) -> DataFrame:
    """All eight configurations by naive Bayes; the README says what the other classifiers take."""
    return md.description_grid(d.documents(t).select("text", "lang", "partition"), "text", "lang", models=("nb",))


@query("m17_save_load_model", SIDE_SQL)
def m17(t: Tables) -> DataFrame:
    path = scratch(t.spark, "bow-model")
    ft.save_model(ft.bow_model(t.documents, "text"), path)
    loaded = ft.load_model(CountVectorizerModel, path)
    counted = loaded.transform(t.documents.withColumn("tokens", code_tokens(F.col("text"))))
    kept = ft.stored(loaded.getOutputCol())
    return counted.select("doc_id", F.inline(F.arrays_zip(kept["indices"].alias("place"), kept["values"].alias("n"))))
