"""Periodic runs: brute force over all periods, edges, and the query on small tables."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from sevfold.llm import periods, queries, textkernel as K
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def brute(words, least=24, power=3):
    """Runs by comparing the text with itself at every distance."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def caught(words, chunk, least=24, power=3):
    hashes = K.mix(np.array(words, dtype=np.uint64) + np.uint64(7))
    catchers = periods.SquareCatchers(least, power)
    for i in range(0, len(words), chunk):
        catchers.append(hashes[i : i + chunk])
    return [tuple(r) for r in catchers.finish().tolist()]


repeats = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 9), st.integers(0, 3))


@settings(max_examples=150, deadline=None)
@given(st.lists(repeats, max_size=6), st.sampled_from([1, 5, 64, 10_000]), st.sampled_from([1, 6, 24, 30]), st.sampled_from([3, 4]))
def test_same_runs_as_brute_force_however_words_are_appended(parts, chunk, least, power):
    words = [w for unit, times, rest in parts for w in (unit * times + unit[:rest])]
    assert caught(words, chunk, least, power) == brute(words, least, power)


def test_runs_within_runs_and_equal_words():
    inner = [0] * 30 + [1]
    assert caught(inner * 4, 10_000) == brute(inner * 4) and len(brute(inner * 4)) == 5
    assert caught([5] * 5000, 10_000) == [(0, 5000, 1)] == caught([5] * 5000, 700)
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert caught(b, 10_000) == brute(b) != []


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_operator_with_nulls_empty_and_long_texts_and_clashing_columns(spark):
    rnd = random.Random(3)
    long = " ".join(rnd.choice("abcdefghij") for _ in range(30_000)) + " one Two\tthree" * 20_000 + "\n"
    texts = [None, "", " \n\t ", "é  é\x0bé " * 12, "x " * 23, "x " * 24, long, "a b " * 12 + "c " + "a b " * 12, "X x " * 12]
    rows = [(i, t, 1, 2, "s") for i, t in enumerate(texts)] + [(None, "q w e r " * 6, 1, 2, "s"), (5, "x " * 24, 1, 2, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, period int, runs string")
    got = {r["doc_id"]: r for r in periods.periodic_runs(docs).collect()}
    for i, text in [(i, t) for i, t, *_ in rows if i != 6]:
        words = (text or "").split()
        want = brute(words)
        assert ([tuple(r) for r in got[i]["runs"]], got[i]["collapsed"], got[i]["n_words"]) == (want, collapse(words, want), len(words))
    assert [tuple(r) for r in got[6]["runs"]] == [(30_000, 60_000, 3)] and len(got[6]["collapsed"].split()) == 30_003
    assert periods.periodic_runs(docs).count() == len(rows)
    assert periods.digests(periods.periodic_runs(docs.limit(0))).count() == 0


def plant(doc_id, text):
    words = (text or "").split()
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_digests_by_hand(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 300)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "a b c " * 30), (1002, "a b " * 20 + "x " + "a b " * 20)]
    got = periods.digests(periods.periodic_runs(periods.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and sum(r["n_runs"] for r in got) > 20
    for doc_id, text in rows:
        words, r = plant(doc_id, text), by_id[doc_id]
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()


def test_query_against_sql(spark):
    name = "op13_periodic_runs"
    assert compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) is None
