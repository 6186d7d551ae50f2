"""Metrics, statistics and neighbours against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sevfold.operators import metrics as m, neighbours as nb, stats as st


def row(spark, pairs, **kw):
    cm = m.confusion(spark.createDataFrame(pairs, "gold string, pred string"), "gold", "pred")
    return m.metrics_row(cm, digits=6, **kw).first()


def test_one_gold_class(spark):
    r = row(spark, [("a", "a"), ("a", "b"), ("a", "a"), ("a", "a")])
    assert (r["acc"], r["prec"], r["rec"], r["f1"], r["gmean"], r["mcc"]) == (0.75, 0.75, 0.75, 0.75, 0.75, 0.0)


def test_all_correct_and_constant(spark):
    assert row(spark, [("a", "a"), ("b", "b"), ("c", "c")])["mcc"] == 1.0
    constant = row(spark, [("a", "a"), ("b", "a"), ("c", "a")])
    assert (constant["mcc"], constant["rec"]) == (0.0, round(1 / 3, 6))


def test_class_only_predicted_counts_in_macro(spark):
    r = row(spark, [("a", "a"), ("b", "c"), ("b", "b")])
    assert (r["prec"], r["rec"]) == (round(2 / 3, 6), 0.5)


def test_mcc_against_covariance_form(spark):
    rng = random.Random(3)
    pairs = [(rng.choice("abcd"), rng.choice("abcd")) for _ in range(300)]
    one_hot = lambda xs: np.array([[x == c for c in "abcd"] for x in xs], dtype=float)
    g, p = one_hot([a for a, _ in pairs]), one_hot([b for _, b in pairs])
    cov = lambda x, y: ((x - x.mean(0)) * (y - y.mean(0))).sum()
    expected = cov(g, p) / math.sqrt(cov(g, g) * cov(p, p))
    assert row(spark, pairs)["mcc"] == pytest.approx(expected, abs=1e-6)


def test_averages(spark):
    cm = m.confusion(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "gold int, pred int"), "gold", "pred")
    assert tuple(m.prf(cm, "binary").first()) == pytest.approx((1.0, 0.5, 2 / 3))
    assert tuple(m.prf(cm, "micro").first()) == pytest.approx((0.75, 0.75, 0.75))
    assert tuple(m.prf(cm, "weighted").first()) == pytest.approx(((1 + 2 / 3) / 2, 0.75, (2 / 3 + 0.8) / 2))
    with pytest.raises(ValueError):
        m.prf(cm, "median")


def groups(spark, a, b):
    rows = [(i, "A", float(x)) for i, x in enumerate(a)] + [(1000 + i, "B", float(x)) for i, x in enumerate(b)]
    return spark.createDataFrame(rows, "id int, g string, v double").withColumn("k", F.lit("all"))


def test_exact_u(spark):
    a, b = [1.0, 4.0, 6.0, 9.0], [2.0, 3.0, 5.0, 7.0, 8.0]
    u = sum(x > y for x in a for y in b)
    tails = [sum(x > y for x in c for y in set(a + b) - set(c)) >= u for c in itertools.combinations(a + b, len(a))]
    r = st.mann_whitney(groups(spark, a, b), "g", "v", ["k"], alternative="greater").first()
    assert r["U"] == u and r["p_value"] == pytest.approx(sum(tails) / len(tails))


def test_u_with_ties_and_default_side(spark):
    a, b = [1, 1, 2, 2, 3, 3, 4, 4, 5, 5], [2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 6]
    r = st.mann_whitney(groups(spark, a, b), "g", "v", ["k"]).first()
    assert r["side"] == "greater"
    assert r["U"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert 0.9 < r["p_value"] < 1.0
    two = st.mann_whitney(groups(spark, a, b), "g", "v", ["k"], alternative="two-sided").first()
    assert 0.05 < two["p_value"] < 0.3


def test_exact_wilcoxon(spark):
    rng = random.Random(5)
    a = rng.sample(range(1000), 9)
    b = [x - d for x, d in zip(a, [5, -3, 11, 2, -7, 13, 17, 19, -1])]
    df = groups(spark, a, b)
    pairs = st.pair_up(df, "g", "v", ["k"], ["id"]).collect()
    diffs = [p["A"] - p["B"] for p in pairs]
    r = st.wilcoxon(df, "g", "v", ["k"], ["id"]).first()
    ranks = {d: sorted(map(abs, diffs)).index(abs(d)) + 1 for d in diffs}
    plus = sum(ranks[d] for d in diffs if d > 0)
    assert r["w_plus"] == plus and r["W"] == min(plus, 45 - plus)
    sums = [sum(k for k, s in zip(range(1, 10), signs) if s) for signs in itertools.product([0, 1], repeat=9)]
    assert r["p_value"] == pytest.approx(min(1.0, 2 * sum(x <= r["W"] for x in sums) / 512))


def test_wilcoxon_cuts_longer_group_and_drops_equal_pairs(spark):
    r = st.wilcoxon(groups(spark, [1] * 5, [1] * 3 + [2] * 9), "g", "v", ["k"], ["id"]).first()
    assert (r is None) or r["n_pairs"] + r["n_equal"] == 5


def test_one_sided_and_one_row_scenarios_give_nulls(spark):
    rows = [(1, "A", 1.0, "one"), (2, "A", 2.0, "one"), (3, "B", 1.0, "row"), (4, "A", 1.0, "both"), (5, "B", 2.0, "both")]
    df = spark.createDataFrame(rows, "id int, g string, v double, k string")
    u = {r["k"]: (r["U"], r["z"], r["p_value"]) for r in st.mann_whitney(df, "g", "v", ["k"]).collect()}
    assert u["one"] == u["row"] == (None, None, None) and u["both"][0] == 0.0 and u["both"][2] is not None
    assert {r["k"] for r in st.wilcoxon(df, "g", "v", ["k"], ["id"]).collect()} == {"both"}
    frame = df.select("id", F.lit("cvss2_auth").alias("scenario"), F.col("v").alias("mcc"), F.col("v").alias("f1"))
    report = st.compare(frame, frame.limit(0), ["id"]).collect()
    assert len(report) == 2 and all(r["mwyu_mcc"] is None and r["n_B_mcc"] == 0 for r in report)


@pytest.mark.parametrize("n_a,n_b", [(3, 5), (8, 40), (40, 8), (1, 9)])
def test_exact_u_tail_counts(n_a, n_b):
    ways = {(0, 0): {0: 1}}
    for i in range(n_a + 1):
        for j in range(n_b + 1):
            if i + j:
                here = {}
                for u, c in ways.get((i - 1, j), {}).items():
                    here[u + j] = here.get(u + j, 0) + c
                for u, c in ways.get((i, j - 1), {}).items():
                    here[u] = here.get(u, 0) + c
                ways[i, j] = here
    counts = ways[n_a, n_b]
    total = sum(counts.values())
    for u in range(0, n_a * n_b + 1, max(1, n_a * n_b // 9)):
        assert st._exact_u_tail(u, n_a, n_b) == pytest.approx(sum(c for x, c in counts.items() if x >= u) / total, rel=1e-12)


def test_cohen_d_without_spread(spark):
    assert st.cohen_d(groups(spark, [1, 1], [2, 2]), "g", "v", ["k"]).first()["cohen_d"] is None


def brute(points, k, p):
    out = {}
    for i, x in points:
        gaps = sorted(((np.abs(x - y).sum() if p == 1 else math.sqrt(((x - y) ** 2).sum())), j) for j, y in points if j != i)
        out[i] = [j for _, j in gaps[:k]]
    return out


@pytest.mark.parametrize("p", [1, 2])
def test_knn_with_hot_cell_and_small_chunks(spark, p):
    rng = np.random.default_rng(7)
    spots = np.vstack([rng.normal(0, 0.05, (70, 4)), rng.normal(5, 1, (60, 4)), np.repeat(rng.normal(9, 1, (2, 4)), 5, axis=0)])
    points = list(enumerate(spots))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in points], "id int, v array<double>, label int")
    found = {}
    for r in nb.knn(df, df, "id", "v", 4, p, "label", exclude_self=True, pivots=6, chunk_rows=16).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append(r["neighbour"])
        assert r["label"] == r["neighbour"] % 3
    assert found == brute(points, 4, p)


@pytest.mark.parametrize("p", [1, 2])
def test_estimates_lose_no_neighbour(p):
    """Ties, copies, skipped pairs, bounds from nothing to all, numbers of any size: as all pairs measured."""
    rng = np.random.default_rng(p)
    for scale, offset in ((1, 0), (1e-6, 100), (1e6, 0), (1e200, 0)):
        rows = rng.integers(-3, 4, (300, 5)) * float(scale) + offset
        points = np.concatenate([rows[:40], rng.normal(size=(20, 5)) * scale + offset])
        skip = (np.arange(40), np.arange(40))
        gaps = np.stack([nb._distances(rows, q, p) for q in points])
        gaps[skip] = np.inf
        for reach in (np.full(60, np.inf), np.sort(gaps, axis=1)[:, 6], np.zeros(60)):
            for k in (4, 400):
                at, row, gap = nb._nearest(points, rows, reach, skip, k, p)
                got = {i: [(g, r) for a, r, g in zip(at, row, gap) if a == i and g <= reach[i]] for i in range(60)}
                want = {i: sorted((g, r) for r, g in enumerate(gaps[i]) if np.isfinite(g) and g <= reach[i])[:k] for i in range(60)}
                assert got == want


def test_merged_cells_copy_rows_once_per_chunk(spark):
    """Vectors that do not cluster: blocks of bounded size in the place of cells, the same neighbours, repeated and null keys too."""
    rng = np.random.default_rng(9)
    rows = [(None if i % 97 == 0 else i - i % 50 if i % 3 == 0 else i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    cells = nb.Cells(rng.normal(size=(40, 16)), np.ones(40), np.full(40, 10), [])
    block, n = cells.blocks(64, 2)
    assert n == 7 and np.bincount(block).max() == 6
    for p in (1, 2):
        few = nb.knn(df, df, "id", "v", 4, p, exclude_self=True, pivots=20, chunk_rows=64).select("id", "neighbour", F.round("distance", 6), "rank").collect()
        one = nb.knn(df, df, "id", "v", 4, p, exclude_self=True, pivots=1).select("id", "neighbour", F.round("distance", 6), "rank").collect()
        key = lambda r: str(tuple(r))
        assert sorted(few, key=key) == sorted(one, key=key)


def test_knn_vote_zero_distance_wins(spark):
    near = spark.createDataFrame([(1, 0.0, "b"), (1, 0.1, "a"), (1, 0.1, "a"), (2, 1.0, "z"), (2, 1.0, "y")], "id int, distance double, label string")
    assert {r["id"]: r["pred"] for r in nb.knn_vote(near, "id", "label", "distance").collect()} == {1: "b", 2: "y"}
    assert {r["id"]: r["pred"] for r in nb.knn_vote(near, "id", "label").collect()} == {1: "a", 2: "y"}


def test_knn_in_a_bounded_number_of_cells(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (30, 8))
    packed = [(int(i), (centres[i % 30] + rng.normal(0, 0.5, 8)).tolist()) for i in range(600)]
    clustered = spark.createDataFrame(packed, "vec_id long, embedding array<double>")
    for df, probes, least, share in ((rows, 26, 0.9, 0.85), (clustered, 8, 0.95, 0.35)):
        true = {(r[0], r[1]) for r in nb.knn(df, df, "vec_id", "embedding", 5, exclude_self=True).select("vec_id", "neighbour").collect()}
        near = {(r[0], r[1]) for r in nb.knn(df, df, "vec_id", "embedding", 5, exclude_self=True, probes=probes).select("vec_id", "neighbour").collect()}
        assert len(near & true) >= least * len(true)
        points = nb.pick_pivots(df, "vec_id", "embedding", 32)
        x = np.array([r[0] for r in df.orderBy("vec_id").select("embedding").collect()], dtype=float)
        gaps = ((x[:, None] - points[None]) ** 2).sum(axis=-1)
        sizes = np.bincount(gaps.argmin(axis=1), minlength=32)
        visited = sizes[np.argsort(gaps, axis=1)[:, :probes]].sum(axis=1).mean() / len(x)
        assert visited <= share
