"""Vocabularies looked up inside the row, against terms counted and joined by their text."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sevfold.operators import lookup
from sevfold.plans import features as ft


def texts(n, seed):
    rnd = random.Random(seed)
    parts = ["ab", "cab", "Ünï", "x", " ", "  ", "\n", "\t ", "日本", "𝔘𝔫", "a b", "q1", ".", " ", "ab c"]
    return [None, "", " ", "a", "ab"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "train" if i % 4 else "test") for i, t in enumerate(texts(120, 1))]
    return spark.createDataFrame(rows, "id long, text string, partition string").repartition(3)


def test_gram_vocabulary_and_counts_equal_those_by_text(spark, docs, monkeypatch):
    train = docs.filter("partition = 'train'")
    fast = {r["term"] for r in ft.gram_vocabulary(train, "text", 5).collect()}
    assert fast == {r["term"] for r in ft.spelt_gram_vocabulary(train, "text", 5).collect()} and len(fast) > 20
    rows = lambda: sorted(tuple(r) for r in ft.subword_features(docs, train, "id", "text", min_df=5).collect())
    held = rows()
    monkeypatch.setattr(ft, "spelt_grams", lambda *args: None)
    assert held == rows() and {r[1] for r in held} == {"word", "char"}


def test_vectors_hold_the_same_counts(spark, docs):
    train = docs.filter("partition = 'train'")
    model = ft.subword_model(train, "text", min_df=5)
    names = model.words.terms.to_pylist() + model.grams.terms.to_pylist()
    assert names[: len(model.words)] == sorted(names[: len(model.words)]) and names[len(model.words) :] == sorted(names[len(model.words) :])
    want = Counter()
    for r in ft.subword_features(docs, train, "id", "text", min_df=5).collect():
        place = names.index(r["term"], 0 if r["block"] == "word" else len(model.words))
        want[r["id"], place] += r["tf"]
    got = ft.subword_vectors(docs, model, ["id", "partition"], "text")
    assert got.count() == docs.count()
    cells = got.select("id", F.posexplode(vector_to_array("features")).alias("place", "n")).filter("n > 0").collect()
    assert {(r["id"], r["place"]): r["n"] for r in cells} == dict(want)


@pytest.mark.parametrize("config", [3, 7])
def test_description_weights_inside_the_row(spark, config, monkeypatch):
    rnd = random.Random(2)
    words = ["buffer", "overflow", "in", "the", "kernel", "aka", "x", "1a2", "Heap"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(80)] + [(90, None), (91, "unknown only")]
    docs = spark.createDataFrame(rows, "id long, text string")
    train = docs.filter("id < 60")
    weigh = lambda: {(r["id"], r["term"]): (r["tf"], round(r["weight"], 9)) for r in ft.desc_features(docs, train, "id", "text", config).collect()}
    held = weigh()
    plan = ft.desc_features(docs, train, "id", "text", config)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    vectors = ft.desc_vectors(docs, train, "text", config).select("id", F.posexplode(vector_to_array("features")).alias("at", "w")).filter("w > 0").collect()
    assert sorted((r["id"], round(r["w"], 9)) for r in vectors) == sorted((i, w) for (i, _), (_, w) in held.items())
    monkeypatch.setattr(ft, "fits", lambda vocab: (vocab, False))
    assert weigh() == held
    if config == 7:
        lengths = Counter()
        for (i, _), (_, w) in held.items():
            lengths[i] += w * w
        assert all(math.isclose(x, 1, abs_tol=1e-6) for x in lengths.values())
    with pytest.raises(ValueError):
        ft.desc_vectors(docs, train, "text", config)


def test_empty_tables_and_vocabularies(spark, docs):
    none = docs.limit(0)
    assert ft.subword_features(docs, none, "id", "text").count() == 0
    assert ft.subword_features(none, docs, "id", "text", min_df=2).count() == 0
    assert ft.desc_features(docs, none, "id", "text", 2).count() == 0
    vocab = lookup.gathered(ft.desc_vocabulary(none, F.col("text"), 1))
    assert len(vocab) == 0
    vectors = ft.subword_vectors(docs, ft.subword_model(none, "text"), ["id"], "text")
    assert vectors.select(F.size(vector_to_array("features")).alias("n")).agg(F.max("n")).first()[0] == 0


def test_batches_of_terms_are_bounded(spark, docs):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for build in (
            lambda: lookup.known_terms(docs, docs.columns[0], F.array(F.lit("a")), lookup.Vocabulary(pa.array(["a"]))),
            lambda: lookup.term_vectors(docs, docs.columns[:1], [(F.array(F.lit("a")), lookup.Vocabulary(pa.array(["a"])))]),
            lambda: lookup.frequent_grams(docs.select(F.lit("abc")), 1, 3, 6),
        ):
            spark.conf.set(setting, "10000")
            build()
            assert int(spark.conf.get(setting)) == lookup.BATCH_ROWS
            spark.conf.set(setting, "10")
            build()
            assert spark.conf.get(setting) == "10"
    finally:
        spark.conf.set(setting, before)


def test_stored_parts_of_a_vector_are_read_as_they_are(spark):
    rows = [(1, Vectors.sparse(5, [1, 4], [2.0, 0.1])), (2, Vectors.dense([0.0, 1.5])), (3, None), (4, Vectors.sparse(5, [], []))]
    df = spark.createDataFrame(rows, StructType([StructField("i", IntegerType()), StructField("v", VectorUDT())]))
    got = {r["i"]: r["s"] for r in df.select("i", ft.stored("v").alias("s")).collect()}
    assert (got[1]["indices"], got[1]["values"]) == ([1, 4], [2.0, 0.1]) and (got[2]["indices"], got[2]["values"]) == (None, [0.0, 1.5])
    assert got[3] is None and got[4]["indices"] == []
    assert "to_json" not in df.select(ft.stored("v"))._jdf.queryExecution().toString()
