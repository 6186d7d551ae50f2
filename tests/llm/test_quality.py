"""Quality by weak supervision: counts by hand, estimation on planted votes, labels it never read, edges."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sevfold.llm import quality, queries
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    times = Counter(windows)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    mark = r"[!-/:-@\[-`{-~]"
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len({k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}),
        len(lines), sum(x.rstrip(SPACE)[-1] in ".!?:;\"')" for x in lines), len(set(ws)),
        sum(not re.search(r"[A-Za-z\x80-\U0010ffff]", w) for w in ws), len(re.findall(mark, text)),
        len(re.findall(rf"({mark})(?=\1)", text)), len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text)),
    )


def texts():
    rnd = random.Random(5)
    parts = ["é", "Ab.", "x", "##", "$$$", "\n", "\n\n", " ", "\t", "\r\n", "12", "²½", "end.", "?!", "日本語", "a b c d e", "a b c d e", "same line\n", "same line\n", "same line \n"]
    return [None, "", " \n ", "\n", "x", "ab" * 700_000, "w " * 300_000] + ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 120))) for _ in range(300)]


def test_signals_equal_counts_by_hand(spark):
    rows = [(i, t, "x", 3) for i, t in enumerate(texts())] + [(None, "no id here.", "x", 3), (4, "x", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = quality.signals(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, *_ in rows), key=key)


def test_estimation_finds_planted_accuracies():
    rnd = np.random.default_rng(1)
    good = rnd.random(40_000) < 0.7
    right = np.array([[0.9, 0.8, 0.95, 0.7, 0.85], [0.6, 0.9, 0.7, 0.8, 0.5]])
    says = np.where(rnd.random((40_000, 5)) < right[np.where(good, 0, 1)], 1, -1) * np.where(good, 1, -1)[:, None]
    cast = np.where(rnd.random((40_000, 5)) < 0.2, 0, says)
    rows, times = np.unique(cast, axis=0, return_counts=True)
    found = quality.estimate(rows.astype(float), times.astype(float), rounds=400)
    assert abs(found.share - 0.7) < 0.03
    assert np.abs(found.good - right[0]).max() < 0.05 and np.abs(found.bad - right[1]).max() < 0.05


def test_posterior_by_brute_force_and_rules(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows, found = quality.judged(docs)
    base, plus, minus = found.log_odds()
    for r in rows.collect():
        cast = [r[f"vote_{name}"] for name, *_ in quality.RULES]
        odds = base + sum(plus[j] if c == 1 else minus[j] if c == -1 else 0.0 for j, c in enumerate(cast))
        assert r["posterior"] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-12)


def test_empty_tables_nulls_repeated_rows(spark):
    schema = "doc_id long, text string, posterior double"
    assert quality.assess(spark.createDataFrame([], schema)).count() == 0
    fine = "The quick brown fox walks over there, and nobody minds it at all today. So it goes on."
    rows = [(1, None, 0.0), (2, "", 0.0), (3, fine, 0.0), (3, fine, 0.0), (None, "$$$ ### " * 40, 0.0)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in quality.assess(spark.createDataFrame(rows, schema)).collect())
    assert got[0] == ("1", 0, True, False) and got[1] == ("2", 0, True, False) and len(got) == 5
    assert [g[:3] for g in got[2:]] == [("3", 18, False), ("3", 18, False), ("None", 80, True)]


def test_verdict_agrees_with_labels_it_never_reads(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = queries.QUERIES["op11_quality_rules"](spark, sf_dir).join(labels, "doc_id").toPandas()
    usable = both[~both["base_failed"]]
    assert usable["kept"][usable["quality"] == 1].mean() > 0.98
    assert both["kept"][both["quality"] == 0].mean() < 0.05


def test_query_against_sql(spark):
    name = "op11_quality_rules"
    assert compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) is None
