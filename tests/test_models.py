"""Job lists that go on, appends that may be repeated, the description grid."""

import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sevfold.plans import features as ft, models as md
from sevfold.sources import readers, writers
from sevfold.sources.schemas import JOBS


def test_append_once_counts_a_key_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "key string, part int"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    assert readers.read_appended(spark, path, schema).count() == 0
    assert writers.append_once(rows, path, "k1") and not writers.append_once(rows, path, "k1")
    assert writers.append_once(rows.limit(1), path, "k|2")
    rows.write.parquet(f"{path}/rows/__part=lost")  # an append that ended before its line
    second = spark.createDataFrame([("k1", "lost")], "key string, part string").withColumn("at", F.current_timestamp())
    second.write.mode("append").parquet(f"{path}/manifest")  # a second line of the same key
    assert sorted(tuple(r) for r in readers.read_appended(spark, path, schema).collect()) == [("a", 1), ("a", 1), ("b", 2)]
    assert {r["key"] for r in readers.committed_keys(spark, path).collect()} == {"k1", "k|2"}


def coded(spark):
    rnd = random.Random(1)
    words = {"HIGH": ["buffer", "overflow", "free"], "LOW": ["log", "doc", "typo"]}
    rows = [(" ".join(rnd.choice(words[c] + ["int", "x1"]) for _ in range(12)), c, p) for i in range(60) for c in words for p in [("train", "train", "valid", "test")[i % 4]]]
    return spark.createDataFrame(rows, "code string, severity string, partition string")


def test_jobs_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    df, path, asked = coded(spark), str(tmp_path / "cells"), []
    jobs = spark.createDataFrame([("method", "whole", "severity", f) for f in ("bow", "subwords")], JOBS)
    models = {"nb": [()], "rf": [(3, 4), (4, 4)]}

    def features_of(job):
        asked.append(job["feature"])
        return md.job_features(df, job["feature"], job["cvss_col"])

    half = md.run_jobs(jobs, features_of, path, models, stop_after=4).collect()
    assert len(half) == 4 and asked == ["bow", "subwords"]
    fits = []
    monkeypatch.setattr(md, "scored", lambda *a, real=md.scored: fits.append(1) or real(*a))
    full = md.run_jobs(jobs, features_of, path, models).collect()
    assert len(full) == 6 and len(fits) == 2 and asked == ["bow", "subwords", "subwords"]
    assert all(r["test_acc"] > 0.9 for r in full if r["classifier"] == "nb")
    again = md.run_jobs(jobs, features_of, path, models).collect()
    assert sorted(again) == sorted(full) and asked == ["bow", "subwords", "subwords"]
    best = md.best_of_grid(md.run_jobs(jobs, features_of, path, models)).collect()
    assert len(best) == 1


def test_features_of_other_kinds(spark):
    df = coded(spark).withColumn("codebert", F.when(F.col("severity") == "LOW", "[0.5, 1]").otherwise("[1.5, -1]"))
    assert md.job_features(df, "codebert", "severity").select("label").distinct().count() == 2
    assert md.job_features(df, "word2vec", "severity").count() == df.count()
    with pytest.raises(ValueError):
        md.job_features(df, "other", "severity")


def test_description_grid_is_made_of_one_table(spark):
    df = coded(spark).unionByName(spark.createDataFrame([("none known", "LOW", "valid")], "code string, severity string, partition string"))
    train = df.filter("partition = 'train'")
    counts = ft.desc_counts(df, train, "code", 4)
    for config in (1, 3, 7, 8):
        mine = ft.config_vectors(counts.rows, counts, config).select("code", ft.stored_values("features").alias("v"))
        theirs = ft.desc_vectors(df, train, "code", config).select("code", ft.stored_values("features").alias("v"))
        key = lambda rows: sorted((r["code"], sorted(round(x, 9) for x in r["v"])) for r in rows.collect())
        assert key(mine) == key(theirs)
    out = md.description_grid(df, "code", "severity", models=("nb", "svm", "lr", "rf"), configs=(1, 2)).collect()
    assert len(out) == 8 and all(r["acc"] == 1.0 for r in out if r["classifier"] == "nb")
    assert md.description_models(7)["lr"] == (10,) and md.description_models(5)["lr"] == (0.1,)
    assert md.description_grid(df.limit(40), "code", "severity", models=(), configs=(1,)).count() == 0


def test_trees_get_partitions_of_bounded_size(spark):
    rows = [(float(i % 2), Vectors.sparse(10_000_000, [i], [1.0])) for i in range(12)]
    train = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    needed = -(-12 * 10_000_000 * 4 // md.TREE_BYTES)
    assert needed > 1
    for name, params in (("rf", (2, 4)), ("gbt", (2, 4))):
        out = md.spread(md.classifier(name, *params), train)
        assert out.rdd.getNumPartitions() == needed and out.count() == 12
    assert md.spread(md.classifier("nb"), train).rdd.getNumPartitions() == 1
    assert md.spread(md.classifier("rf", 2, 4), train.filter("label > 5")).count() == 0
