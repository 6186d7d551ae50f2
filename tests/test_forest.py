"""Random forests over sparse rows: the trees of Spark where nothing is drawn, and no more work than numbers stored."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sevfold.operators import boosting, forest
from sevfold.plans import models as md
from tests.test_boosting import rows_of


def predicted(model, rows):
    return {r["id"]: r["prediction"] for r in model.transform(rows).select("id", "prediction").collect()}


def leaves(trees):
    return [sorted((tuple(v), d) for v, d, c in zip(t.value, t.depth, t.cell, strict=True) if c < 0) for t in trees]


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_one_tree_is_that_of_spark(spark, depth):
    rows = rows_of(spark)
    train, rest = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    theirs = RandomForestClassifier(numTrees=1, maxDepth=depth, bootstrap=False, seed=md.SEED).fit(train)
    mine = md.RandomForest(1, depth, bootstrap=False).fit(train)
    for part in (train, rest):
        assert predicted(mine, part) == predicted(theirs, part)


def test_a_forest_is_as_good_as_that_of_spark(spark):
    rows = rows_of(spark, 900)
    train, rest = rows.filter("id % 3 > 0").cache(), rows.filter("id % 3 = 0").cache()
    right = lambda model: model.transform(rest).filter("label = prediction").count() / rest.count()
    theirs = RandomForestClassifier(numTrees=60, maxDepth=6, seed=md.SEED).fit(train)
    mine = md.classifier("rf", 60, 16).fit(train)
    assert right(mine) > 0.8 and right(mine) > right(theirs) - 0.05
    assert len({str(x) for x in leaves(mine.grown)}) == 60  # no two trees are drawn alike


def test_trees_do_not_depend_on_groups_and_blocks(spark, monkeypatch):
    rows = rows_of(spark).repartition(5)
    one = md.RandomForest(4, 5, bootstrap=False).fit(rows.coalesce(1))
    again = md.RandomForest(4, 5).fit(rows)
    assert leaves(md.RandomForest(4, 5).fit(rows).grown) == leaves(again.grown)
    monkeypatch.setattr(boosting, "BLOCK_ENTRIES", 30)
    monkeypatch.setattr(boosting, "PART_ENTRIES", 100)  # several turns of blocks in a task
    monkeypatch.setattr(forest, "GROUP_NODES", 2)
    monkeypatch.setattr(forest, "MAX_NODES", 3)  # several passes a level
    other = md.RandomForest(4, 5, bootstrap=False).fit(rows)
    assert leaves(one.grown) == leaves(other.grown)


def test_work_follows_stored_numbers(spark):
    """Sixty rows of ten million features would be 2.4 GB as numbers of 4 bytes."""
    rows = [(float(i % 2), Vectors.sparse(10_000_000, [i % 2, 9_999_000 + i], [1.0, 2.0])) for i in range(60)]
    train = spark.createDataFrame(rows, ["label", "features"])
    assert md.RandomForest(1, 3, bootstrap=False).fit(train).transform(train).filter("label <> prediction").count() == 0
    drawn = md.classifier("rf", 20, 4).fit(train)
    assert len(drawn.grown) == 20 and drawn.transform(train).count() == 60


def test_rows_without_a_threshold_get_the_larger_class(spark):
    train = spark.createDataFrame([(float(i > 2), Vectors.sparse(4, [1], [3.0])) for i in range(10)], ["label", "features"])
    model = md.RandomForest(3, 3, bootstrap=False).fit(train)
    assert {r["prediction"] for r in model.transform(train).collect()} == {1.0}
    assert all(list(t.value[0]) == [3, 7] and t.cell == [-1] for t in model.grown)
    with pytest.raises(ValueError):
        md.RandomForest(2, 3).fit(train.filter("label > 5"))


def test_draws_are_of_the_wanted_size(spark):
    space = boosting.Space(np.arange(0, 1000, 2), np.ones(500), np.ones(500, np.int64))
    draws = forest.Draws(42, 1000, 32, 2)
    sets = [draws.features(space, k, node) for k in range(5) for node in range(40)]
    assert all(len(set(s)) == len(s) and (np.diff(s) > 0).all() for s in sets) and 12 < np.mean([len(s) for s in sets]) < 20
    assert len({tuple(s) for s in sets}) == 200
    weights = draws.weights(1, 0, 0, 20_000)
    assert abs(weights.mean() - 1) < 0.05 and abs((weights == 0).mean() - np.exp(-1)) < 0.02
