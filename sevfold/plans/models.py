"""Classical classifiers and their search on a fixed train, validation and test split."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.sql import DataFrame, functions as F

from sevfold.functions.text import code_tokens
from sevfold.operators.boosting import boosted, predicted
from sevfold.operators.forest import forest, voted
from sevfold.operators.metrics import confusion, metrics_row
from sevfold.operators.neighbours import knn, knn_vote
from sevfold.plans.features import (
    DESC_CONFIGS, bow_model, bow_vectors, config_vectors, desc_counts, drop_empty_vectors, embedding_features, indexed_label, stored, subword_model, subword_vectors, word2vec,
)
from sevfold.plans.results import average_results, best_per_group
from sevfold.sources.readers import committed_keys, read_appended
from sevfold.sources.schemas import RESULT_KEYS, RESULT_METRICS
from sevfold.sources.writers import append_once

SEED = 42
MAX_DEPTH = 30
SCORED = ("valid", "test")
#: Bytes of the numbers that trees hold of a partition.
TREE_BYTES = 64 << 20
#: Confusion rows of one setting.
CELLS = ", ".join(f"{k} string" for k in RESULT_KEYS) + ", part string, gold int, pred int, n long, train_time double, time double"


def depth_of(leaves: int | None) -> int:
    """Tree depth that leaves room for a number of leaves; Spark has no cap on leaves. None is the deepest tree."""
    depth = MAX_DEPTH if leaves is None else math.ceil(math.log2(leaves)) + 2
    if depth > MAX_DEPTH:
        raise ValueError(f"{leaves} leaves need a depth of {depth}; Spark's trees end at {MAX_DEPTH}")
    return depth


def _leaves(given) -> int | None:
    return None if given is None else int(given)


def classifier(name: str, *params, n_rows: int = 1, multinomial: bool = True, max_iter: int = 100) -> Estimator:
    """Untrained classifier. ``params`` is C for ``svm`` and ``lr``; trees and leaves for ``rf``
    and ``gbt``, where no leaves mean no cap; neighbours, weights and norm for ``knn``. The penalty
    weight is 1 / (C * n_rows)."""
    if name == "nb":
        return NaiveBayes(modelType="multinomial", smoothing=1.0)
    if name == "svm":
        reg = 1.0 / (float(params[0]) * n_rows)
        return OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=max_iter, tol=1e-3, standardization=False), parallelism=4)
    if name == "lr":
        reg = 1.0 / (float(params[0]) * n_rows)
        lr = LogisticRegression(regParam=reg, elasticNetParam=0.0, maxIter=max_iter, tol=1e-3, standardization=False, family="multinomial" if multinomial else "auto")
        return lr if multinomial else OneVsRest(classifier=lr, parallelism=4)
    if name == "rf":
        return RandomForest(int(params[0]), depth_of(_leaves(params[1])))
    if name == "knn":
        return KNNEstimator(int(params[0]), str(params[1]), int(params[2]))
    if name == "gbt":
        return BoostedTrees(int(params[0]), depth_of(_leaves(params[1])))
    raise ValueError(f"unknown classifier {name!r}")


class KNNEstimator:
    """Nearest neighbours in the place of an estimator: fitting keeps the rows, predicting searches them."""

    def __init__(self, neighbours: int, weights: str, norm: int):
        self.neighbours, self.weights, self.norm = neighbours, weights, norm
        self.train: DataFrame | None = None

    def fit(self, train: DataFrame) -> KNNEstimator:
        fitted = KNNEstimator(self.neighbours, self.weights, self.norm)
        rows = train.select("label", vector_to_array("features").alias("v"))
        fitted.train = rows.withColumn("row", F.xxhash64("v", "label", F.monotonically_increasing_id()))
        return fitted

    def transform(self, rows: DataFrame) -> DataFrame:
        asked = rows.withColumn("v", vector_to_array("features")).withColumn("row", F.xxhash64("v", F.monotonically_increasing_id()))
        asked = asked.persist(StorageLevel.MEMORY_AND_DISK)  # both uses must see the same row numbers
        near = knn(asked.select("row", "v"), self.train, "row", "v", self.neighbours, self.norm, carry="label")
        votes = knn_vote(near, "row", "label", self.weights).withColumnRenamed("pred", "prediction")
        return asked.join(votes, "row").drop("row", "v")


class BoostedTrees:
    """Boosted trees of each class against the rest in the place of an estimator: the trees of Spark's
    ``GBTClassifier``, grown for all classes in the same passes over what the vectors store."""

    def __init__(self, rounds: int, depth: int):
        self.rounds, self.depth = rounds, depth
        self.space, self.series = None, None

    def fit(self, train: DataFrame) -> BoostedTrees:
        fitted = BoostedTrees(self.rounds, self.depth)
        fitted.space, fitted.series = boosted(train.select("label", stored("features").alias("v")), self.rounds, self.depth, SEED)
        return fitted

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", predicted(stored("features"), self.space, self.series))


class RandomForest:
    """A random forest in the place of an estimator: the trees of Spark's ``RandomForestClassifier`` by other draws,
    grown over what the vectors store."""

    def __init__(self, trees: int, depth: int, bootstrap: bool = True):
        self.trees, self.depth, self.bootstrap = trees, depth, bootstrap
        self.space, self.grown = None, None

    def fit(self, train: DataFrame) -> RandomForest:
        fitted = RandomForest(self.trees, self.depth, self.bootstrap)
        first = train.first()
        size = first["features"].size if first else 0
        fitted.space, fitted.grown = forest(train.select("label", stored("features").alias("v")), size, self.trees, self.depth, SEED, self.bootstrap)
        return fitted

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", voted(stored("features"), self.space, self.grown))


def spread(estimator: Estimator, train: DataFrame) -> DataFrame:
    """Rows for trees in partitions of bounded size, by the bytes that all features of a row would take as numbers of 4 bytes."""
    first = train.first() if isinstance(estimator, (RandomForest, BoostedTrees)) else None
    if first is None:
        return train
    needed = math.ceil(train.count() * first["features"].size * 4 / TREE_BYTES)
    return train.repartition(needed) if needed > train.rdd.getNumPartitions() else train


def scored(estimator: Estimator, parts: dict[str, DataFrame]) -> list[tuple]:
    """Fit on ``train`` and predict the other parts: ``part, gold, pred, n, train_time, time`` per pair of classes."""
    start = time.perf_counter()
    model = estimator.fit(parts["train"] if isinstance(estimator, RandomForest) else spread(estimator, parts["train"]))  # a forest divides rows by what they store
    train_time = round(time.perf_counter() - start, 3)
    out = []
    for part in SCORED:
        start = time.perf_counter()
        pairs = confusion(model.transform(parts[part]), "label", "prediction").collect()  # one row per pair of classes
        seconds = round(time.perf_counter() - start, 3)
        out += [(part, int(r["gold"]), int(r["pred"]), r["n"], train_time, seconds) for r in pairs]
    return out


def held_parts(features: DataFrame, partition: str = "partition") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Labelled vectors, held until ``unpersist``, and their parts."""
    held = features.select("label", "features", partition).persist(StorageLevel.MEMORY_AND_DISK)
    return held, {p: held.filter(F.col(partition) == p).select("label", "features") for p in ("train", *SCORED)}


def result_rows(cells: DataFrame) -> DataFrame:
    """One result row per setting from the confusion rows of ``CELLS``; a part without rows has null metrics."""
    keys = list(RESULT_KEYS)
    times = cells.groupBy(*keys, "part").agg(F.max("train_time").alias("train_time"), F.max("time").alias("time"))
    rows = metrics_row(cells.select(*keys, "part", "gold", "pred", "n"), [*keys, "part"]).join(times, [*keys, "part"])
    names = {"valid": "val", "test": "test"}
    wide = rows.groupBy(*keys).agg(
        F.max("train_time").alias("train_time"),
        *[F.max(F.when(F.col("part") == part, F.col(m))).alias(f"{short}_{m}") for part, short in names.items() for m in ("acc", "prec", "rec", "gmean", "f1", "mcc", "time")],
    )
    return wide.select(*keys, *RESULT_METRICS)


def _settings(models: dict[str, list[tuple]]) -> list[tuple[str, tuple, str]]:
    return [(name, params, "-".join(map(str, params))) for name, grid in models.items() for params in grid]


def run_grid(
    features: DataFrame, job: dict[str, str], models: dict[str, list[tuple]], partition: str = "partition"
) -> DataFrame:
    """Result rows of every classifier and parameter on one feature table.

    The features are held for the whole search. The driver loops over a short list of settings;
    each fit and each prediction is a Spark job, and gathers confusion rows.
    """
    held, parts = held_parts(features, partition)
    try:
        n_rows = parts["train"].count()
        base = tuple(job[k] for k in RESULT_KEYS[:4])
        cells = [(*base, name, text, *row) for name, params, text in _settings(models) for row in scored(classifier(name, *params, n_rows=n_rows), parts)]
    finally:
        held.unpersist()
    order = F.array(*[F.lit(f"{name}|{text}") for name, _, text in _settings(models)])
    return result_rows(features.sparkSession.createDataFrame(cells, CELLS)).orderBy(F.array_position(order, F.concat_ws("|", "classifier", "parameters")))


def run_jobs(
    jobs: DataFrame, features_of: Callable[[dict[str, str]], DataFrame], path: str, models: dict[str, list[tuple]],
    stop_after: int | None = None,
) -> DataFrame:
    """Result rows of a job list (``sources.schemas.JOBS``) that goes on where an earlier run stopped.

    ``features_of`` gives the labelled vectors of a job with their ``partition``; they are made only
    for jobs with settings left. Each setting is appended to the table at ``path`` under a key of its
    own, and finished keys are skipped, so a lost driver costs one fit. ``stop_after`` ends the run
    after so many fits.
    """
    spark = jobs.sparkSession
    done = {r["key"] for r in committed_keys(spark, path).collect()}  # as many as there are settings
    left = math.inf if stop_after is None else stop_after
    for row in jobs.collect():
        job = row.asDict()
        base = (job["cvss_col"], job["granularity"], job["scope"], job["feature"])
        todo = [(s, key) for s in _settings(models) if (key := "|".join([*base, s[0], s[2]])) not in done]
        if not todo or left <= 0:
            continue
        held, parts = held_parts(features_of(job))
        try:
            n_rows = parts["train"].count()
            for (name, params, text), key in todo:
                if left <= 0:
                    break
                cells = [(*base, name, text, *r) for r in scored(classifier(name, *params, n_rows=n_rows), parts)]
                append_once(spark.createDataFrame(cells, CELLS).coalesce(1), path, key)
                done.add(key)
                left -= 1
        finally:
            held.unpersist()
    return result_rows(read_appended(spark, path, CELLS))


def job_features(df: DataFrame, feature: str, label: str, code: str = "code", embedding: str = "codebert") -> DataFrame:
    """``label, features, partition`` of one kind of features, fitted on the train part.

    ``bow`` counts tokens, ``subwords`` tokens and character grams, ``word2vec`` is the mean of trained
    word vectors; ``codebert`` reads the stored vector in column ``embedding``.
    """
    train = df.filter("partition = 'train'")
    coded = indexed_label(label, "label").fit(train).transform(df)
    if feature == "bow":
        return bow_vectors(coded, bow_model(train, code, out="features"), code).select("label", "features", "partition")
    if feature == "subwords":
        return subword_vectors(coded, subword_model(train, code), ["label", "partition"], code)
    if feature == "codebert":
        return embedding_features(coded, embedding).select("label", "features", "partition")
    if feature == "word2vec":
        words = word2vec().fit(train.select(code_tokens(F.col(code)).alias("tokens")))
        return words.setOutputCol("features").transform(coded.withColumn("tokens", code_tokens(F.col(code)))).select("label", "features", "partition")
    raise ValueError(f"unknown feature {feature!r}")


def description_models(config: int, boosted: bool = False) -> dict[str, tuple]:
    """Classifiers of the description baseline; the regression's penalty follows the weights."""
    models = {"nb": (), "svm": (0.1,), "lr": (10 if DESC_CONFIGS[config].tfidf else 0.1,), "rf": (100, None)}
    return models | ({"gbt": (100, 100)} if boosted else {})


def description_grid(
    df: DataFrame, text: str, label: str, models: tuple[str, ...] = ("nb", "svm", "lr", "rf"), configs: tuple[int, ...] = tuple(DESC_CONFIGS),
    score_on: str = "valid", digits: int | None = 5,
) -> DataFrame:
    """``config, classifier, acc, prec, rec, f1, mcc, seconds`` of the description baseline.

    Grams of up to four words are counted once. The vocabulary is ordered by the length of its grams, so
    each configuration is a front part of the same counts. Scored rows without a known gram are dropped.
    """
    train = df.filter("partition = 'train'")
    counts = desc_counts(df.filter(F.col("partition").isin("train", score_on)), train, text, max(DESC_CONFIGS[c].hi for c in configs))
    held = indexed_label(label).fit(train).transform(counts.rows).select("label", "partition", "place", "tf").persist(StorageLevel.MEMORY_AND_DISK)
    cells = []
    try:
        n_rows = held.filter("partition = 'train'").count()
        for config in configs:
            vectors = config_vectors(held, counts, config).select("label", "partition", "features").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                for name, params in description_models(config, "gbt" in models).items():
                    if name not in models:
                        continue
                    start = time.perf_counter()
                    model = classifier(name, *params, n_rows=n_rows, multinomial=False).fit(vectors.filter("partition = 'train'"))
                    scored_rows = drop_empty_vectors(vectors.filter(F.col("partition") == score_on), "features")
                    pairs = confusion(model.transform(scored_rows), "label", "prediction").collect()
                    seconds = round(time.perf_counter() - start, 3)
                    cells += [(config, name, int(r["gold"]), int(r["pred"]), r["n"], seconds) for r in pairs]
            finally:
                vectors.unpersist()
    finally:
        held.unpersist()
    rows = df.sparkSession.createDataFrame(cells, "config int, classifier string, gold int, pred int, n long, seconds double")
    times = rows.groupBy("config", "classifier").agg(F.max("seconds").alias("seconds"))
    return metrics_row(rows, ["config", "classifier"], digits).drop("gmean").join(times, ["config", "classifier"])


def best_of_grid(results: DataFrame) -> DataFrame:
    """Averages per setting, then the best row per problem, granularity and scope."""
    return best_per_group(average_results(results), ["problem", "granularity", "scope"])


def predictions(estimator: Estimator, train: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``key, gold, pred`` of one classifier."""
    return estimator.fit(train).transform(rows).select(key, F.col("label").cast("int").alias("gold"), F.col("prediction").cast("int").alias("pred"))
