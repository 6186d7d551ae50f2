"""Boosted trees over sparse rows: the trees of Spark, however rows are divided, and no more work than numbers stored."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sevfold.operators import boosting
from sevfold.plans import models as md


def rows_of(spark, n=300, n_classes=3):
    rnd, out = random.Random(5), []
    for i in range(n):
        values = [0.0] * 12
        for f in range(9):
            values[f] = float(rnd.choice([0, 0, 0, 1, 2, 5]))
        values[9], values[10] = round(rnd.uniform(-3, 3), 3), rnd.gauss(0, 1)
        label = min(n_classes - 1, int(values[0] + values[3] > 2) + int(values[9] > 0.3 + 0.2 * values[1] + rnd.gauss(0, 0.4)))
        out.append((i, float(label), Vectors.dense(values) if i % 3 else Vectors.sparse(12, [(f, x) for f, x in enumerate(values) if x])))
    return spark.createDataFrame(out, ["id", "label", "features"])


def test_classes_are_those_of_sparks_boosting(spark):
    rows = rows_of(spark)
    train, rest = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    theirs = OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=md.SEED)).fit(train)
    mine = md.BoostedTrees(5, 3).fit(train)
    for part in (train, rest):
        said = lambda model: {r["id"]: r["prediction"] for r in model.transform(part).select("id", "prediction").collect()}  # noqa: E731, B023
        assert said(mine) == said(theirs)
    assert md.confusion(mine.transform(rest), "label", "prediction").agg(F.sum("n")).first()[0] == rest.count()


def test_trees_do_not_depend_on_how_rows_are_divided(spark, monkeypatch):
    rows = rows_of(spark).repartition(5)
    one = md.BoostedTrees(3, 4).fit(rows.coalesce(1))
    monkeypatch.setattr(boosting, "SHARD_CELLS", 40)  # several shards of bins
    monkeypatch.setattr(boosting, "BLOCK_ENTRIES", 30)
    monkeypatch.setattr(boosting, "MAX_SLOTS", 3)  # several passes a level
    other = md.BoostedTrees(3, 4).fit(rows)
    assert len(other.space.shards) > 2
    leaves = lambda series: [[sorted(zip(t.value, t.depth, strict=True)) for t in trees] for trees in series]
    assert leaves(one.series) == leaves(other.series)


def test_work_follows_stored_numbers(spark):
    """Sixty rows of ten million features would be 2.4 GB as numbers of 4 bytes."""
    rows = [(float(i % 2), Vectors.sparse(10_000_000, [i % 2, 9_999_000 + i], [1.0, 2.0])) for i in range(60)]
    train = spark.createDataFrame(rows, ["label", "features"])
    model = md.classifier("gbt", 3, 4).fit(train)
    assert model.transform(train).filter("label <> prediction").count() == 0


def test_rows_without_a_threshold_get_the_larger_class(spark):
    train = spark.createDataFrame([(float(i > 2), Vectors.sparse(4, [1], [3.0])) for i in range(10)], ["label", "features"])
    assert {r["prediction"] for r in md.BoostedTrees(2, 3).fit(train).transform(train).collect()} == {1.0}
    with pytest.raises(ValueError):
        md.BoostedTrees(2, 3).fit(train.filter("label > 5"))


def test_thresholds_of_many_values_are_near_quantiles():
    assert boosting.thresholds(np.array([1.0, 2.0]), np.array([3, 4]), 10, 31).tolist() == [0.5, 1.5]
    assert boosting.thresholds(np.array([-1.0, 2.0]), np.array([3, 7]), 10, 31).tolist() == [0.5]
    many = boosting.thresholds(np.arange(1.0, 1001.0), np.ones(1000, int), 1000, 31)
    assert len(many) == 31 and abs(many[15] - 500) < 2
