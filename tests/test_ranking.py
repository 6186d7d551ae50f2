"""Positions, cuts, running values and ranks against brute force, also with a hot group."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sevfold.operators import ranking as rk, relational as rl, splits as sp


def permuted(keys, seed=42):
    return sorted(keys, key=lambda k: hashlib.md5(f"{k}|{seed}".encode()).hexdigest())


@pytest.mark.parametrize("digits, parts", [(1, 1), (3, 8)])
def test_with_index(spark, digits, parts):
    df = spark.range(500).repartition(parts)
    found = {r["id"]: r["row_index"] for r in rk.with_index(df, ["id"], digits=digits).collect()}
    assert found == {k: i for i, k in enumerate(permuted(range(500)))}


def test_with_index_within_hot_and_null_groups(spark):
    rows = [(i, None if i % 50 == 0 else ("hot" if i % 3 else f"g{i % 7}")) for i in range(600)]
    found = rk.with_index(spark.createDataFrame(rows, "id int, g string"), ["id"], within=["g"]).collect()
    assert len(found) == 600
    for g in {r[1] for r in rows}:
        expected = {k: i for i, k in enumerate(permuted([i for i, x in rows if x == g]))}
        assert {r["id"]: r["row_index"] for r in found if r["g"] == g} == expected


@pytest.mark.parametrize("n_keys", [1, 2, 7, 35, 100])
def test_group_split(spark, n_keys):
    rows = [(i, f"CVE-{i % n_keys}" if i % 3 else "CVE-0") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, cve_id string")
    out = sp.group_split(df, "cve_id").collect()
    keys = permuted({k for _, k in rows})
    held = -(-len(keys) // 5)
    train, valid = len(keys) - held, len(keys) - held + -(-held // 2)
    part = {k: "train" if i < train else "valid" if i < valid else "test" for i, k in enumerate(keys)}
    assert len(out) == 400 and all(r["split"] == part[r["cve_id"]] for r in out)


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(300).select("id", (F.col("id") % 40).cast("string").alias("k"))
    one, many = (sorted(map(tuple, sp.group_split(df.repartition(n), "k").collect())) for n in (1, 8))
    assert one == many


def test_stratified_fractions(spark):
    rows = [(i, None if i % 31 == 0 else "hot" if i < 200 else f"c{i % 3}" if i < 280 else "tiny") for i in range(284)]
    out = sp.stratified_fractions(spark.createDataFrame(rows, "id int, cls string"), "cls", "id").collect()
    by_class = {}
    for i, c in rows:
        if c is not None:
            by_class.setdefault(c, []).append(i)
    for c, ids in by_class.items():
        order = permuted(ids)
        for r in (0.2, 0.4, 0.6, 0.8):
            assert {x["id"] for x in out if x["cls"] == c and x["ratio"] == r} == set(order[: int(len(ids) * r)])
    assert not [x for x in out if x["cls"] is None]


@pytest.mark.parametrize("n, folds", [(103, 10), (5, 10), (50, [0.8, 0.1, 0.1])])
def test_assign_folds(spark, n, folds):
    found = {r["id"]: r["fold"] for r in sp.assign_folds(spark.range(n), "id", folds).collect()}
    k = folds if isinstance(folds, int) else len(folds)
    sizes = [n // folds] * k if isinstance(folds, int) else [int(n * f) for f in folds]
    ends = [sum(sizes[: i + 1]) for i in range(k - 1)]
    for i, key in enumerate(permuted(range(n))):
        assert found[key] == sum(i > e for e in ends)


@pytest.mark.parametrize("span", [1, 4, 4096])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(spark, span, exclusive):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"r{i % 5}", i, rng.random() if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, v double")
    top = {r["o"]: r["x"] for r in rk.running(df, ["g"], "o", F.col("v"), "max", "x", span, exclusive).collect()}
    total = {r["o"]: r["x"] for r in rk.running(df, ["g"], "o", F.lit(1), "sum", "x", span, exclusive).collect()}
    for g, o, _ in rows:
        before = [(p, v) for h, p, v in rows if h == g and (p < o or (p == o and not exclusive))]
        assert top[o] == max((v for _, v in before if v is not None), default=None)
        assert total[o] == len(before)


@pytest.mark.parametrize("buckets", [1, 5, 64, 300])
def test_mid_rank(spark, buckets):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else "b", float(rng.choice([1, 1, 1, 2, 3, rng.randint(0, 90), rng.random()]))) for i in range(400)]
    df = spark.createDataFrame([*rows, ("b", float("nan")), ("b", None)], "g string, v double")
    out = {(r["g"], r["v"]): r for r in rk.mid_rank(df, ["g"], "v", {"w": F.lit(2)}, buckets).collect()}
    assert len(out) == len(set(rows))
    for (g, v), r in out.items():
        mine = [x for h, x in rows if h == g]
        assert r["mid_rank"] == sum(x < v for x in mine) + (mine.count(v) + 1) / 2
        assert (r["n_ties"], r["w"]) == (mine.count(v), 2 * mine.count(v))


def test_rotate_folds(spark):
    rows = sp.rotate_folds(spark.createDataFrame([(i, i % 5) for i in range(10)], "id int, fold int"), 5).collect()
    assert len(rows) == 50
    for r in rows:
        expected = {(r["rotation"] + 1) % 5: "valid", (r["rotation"] + 2) % 5: "test"}.get(r["fold"], "train")
        assert r["partition"] == expected


def test_join_with_a_hot_key_is_spread(spark):
    rows = spark.range(24_000, numPartitions=12).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("long").alias("word"))
    side = spark.range(4000).select(F.col("id").alias("word"), (F.col("id") * 2).alias("v"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = rl.join_vectors(rows, side, "word")
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        plain = sorted(r["count"] for r in rows.join(side, "word").groupBy(F.spark_partition_id()).count().collect())
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(side, "word").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and plain[-1] > 5 * plain[len(plain) // 2]
    assert rl.join_vectors(rows.limit(0), side, "word").count() == 0
