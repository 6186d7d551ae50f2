"""N-gram join, decontamination, suffix array and top-k search against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sevfold.llm import decontaminate, kdtree, ngram_join, suffixes, textkernel as K
from sevfold.llm.tables import components

EXTRA = {"id": 1, "n": "x", "s": 2, "pos": 3, "comp": 4, "h": 5, "rank": 6, "words": "w"}
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def docs_of(spark, texts: dict):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, *EXTRA.values()) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} {'string' if isinstance(v, str) else 'int'}" for c, v in EXTRA.items()))


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not ws:
        return set()
    return {tuple(ws)} if len(ws) < size else {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}


def brute_components(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    name = {i: i for i in texts}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            name[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def family(rng, n, words, edits):
    """Near copies of one text with up to ``edits`` replaced, dropped or added words."""
    base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], ["new" + str(rng.randint(0, 9))], [w[i], "x" + str(rng.randint(0, 99))]])
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,percent,rare", [(3, 90, 2), (3, 90, 8), (5, 80, 3)])
def test_components_same_as_brute_force(spark, monkeypatch, size, percent, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rng = random.Random(size * rare)
    texts = [*family(rng, 40, 60, 4), *family(rng, 25, 120, 8), *family(rng, 20, 9, 2), "", "  \n ", None, "one", "One", "one two", "ONE  two", "É ü", "é ü"]
    texts += ["common line of ten words that many texts do share here " + t for t in family(rng, 30, 25, 6)]
    texts += texts[:10]
    docs = dict(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs_of(spark, docs), size, percent).collect()}
    assert got == brute_components(docs, size, percent)


def test_components_of_odd_tables(spark):
    assert ngram_join.ngram_components(docs_of(spark, {}), 3, 90).collect() == []
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, long), (2, long + " tail"), (None, "a b c"), (None, None), (3, "a b c"), (3, "a b c")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs_of(spark, rows), 3, 90).collect()), key=str)
    assert got == sorted([(1, 5000, 1), (2, 5001, 1), (None, 1, None), (None, 0, None), (3, 1, 3), (3, 1, 3)], key=str)


def test_one_of_each_group_stays(spark):
    a, b = "a b c d e f g h i j k l", "completely other words stand in this text here"
    rows = [(5, a), (2, a), (9, a + " m"), (7, b), (7, b), (None, a), (None, "")]
    kept = ngram_join.keep_one(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 7, None, None], key=str)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 900), (900, 950)]
    random.Random(3).shuffle(edges)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(401), 0), **dict.fromkeys((900, 950, 1000), 900)}


def test_windows_and_words_of_pieces():
    import pyarrow as pa

    texts = ["", None, "Ab cd", "x", "é É", "one two three " * 50]
    for limit in (1, 20, 10_000):
        for piece in K.pieces(pa.array(texts), limit):
            w = K.words(piece, K.NOT_SPACE)
            for i in range(piece.hi - piece.lo):
                got = [bytes(piece.data[a:b]).decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
                assert got == (texts[piece.lo + i] or "").split()
    assert K.window_hashes(np.arange(3, dtype=np.uint64), 4).size == 0


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id long, text string, doc_id int")


def test_overlaps_survive_replaced_words(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([13, 20, 40, 60, 12, 200])}
    noise = lambda n: [word() for _ in range(n)]
    replaced = list(items[3])
    for i in range(5, 60, 9):
        replaced[i] = "other"
    texts = {
        1: noise(30) + items[0] + noise(9), 2: [w.upper() + "," for w in items[1]], 3: noise(3) + items[2] + items[3], 4: noise(50) + replaced,
        5: noise(500), 6: items[4], 7: items[3][:12] + noise(4), 8: noise(2000) + items[5] + noise(2000), 9: items[5][40:100],
    }
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(10, None), (11, ""), (None, " ".join(items[0])), (1, " ".join(texts[1]))]
    bench = items_of(spark, [(i, " ".join(t)) for i, t in items.items()] + [(90, None), (91, " ".join(items[0]))])
    got = sorted({(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs_of(spark, rows), bench).collect()}, key=str)
    assert got == sorted([(1, 0), (1, 91), (2, 1), (3, 2), (3, 3), (4, 3), (8, 5), (9, 5), (None, 0), (None, 91)], key=str)
    spans = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["item_start"], r["n_words"], r["n_equal"]) for r in decontaminate.overlaps(docs_of(spark, rows), bench).collect()}
    assert spans[(1, 0)] == (30, 0, 13, 13) and spans[(9, 5)] == (0, 40, 60, 60) and spans[(4, 3)][3] == 60 - 7
    kept = decontaminate.keep_clean(docs_of(spark, rows), bench)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([5, 6, 7, 10, 11, None], key=str)


def brute_runs(equal, min_words, percent):
    """Runs of enough equal words that begin and end with equal words and lie in no other such run."""
    upto = [0, *itertools.accumulate(equal)]
    at = [i for i, e in enumerate(equal) if e]
    good = [(a, b + 1, upto[b + 1] - upto[a]) for a in at for b in at if b >= a]
    good = [(a, b, k) for a, b, k in good if k >= min_words and 100 * k >= percent * (b - a)]
    ends = {}
    for a, b, _ in good:
        ends[a] = max(b, ends.get(a, 0))
    return [(a, b, k) for a, b, k in good if b == ends[a] and not any(d >= b for c, d in ends.items() if c < a)]


def test_runs_same_as_brute_force():
    rng = random.Random(11)
    for i in range(400):
        share = rng.choice([0.6, 0.75, 0.8, 0.9, 1.0])
        equal = [rng.random() < share for _ in range(rng.randint(0, 45))]
        min_words, percent = rng.choice([1, 3, 7]), rng.choice([50, 80, 100])
        got = [tuple(r) for r in decontaminate.runs(np.array(equal, dtype=bool), min_words, percent).tolist()]
        assert got == brute_runs(equal, min_words, percent), i


def test_verbatim_words_beside_edited_ones_are_found(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items, texts, want = {}, {}, []
    for i, (same, tail, left) in enumerate([(30, 100, False), (30, 100, True), (25, 200, False), (20, 39, False)] * 10):
        items[i] = [word() for _ in range(same + tail)]
        changed = list(items[i])
        for j in range(tail) if left else range(same, same + tail):
            if rng.random() < 0.3:
                changed[j] = "other"
        noise = [word() for _ in range(7)]
        texts[i] = noise + changed
        equal = [a == b for a, b in zip(items[i], changed)]
        want += [(i, i, 7 + a, a, b - a, k) for a, b, k in brute_runs(equal, 13, 80)]
    docs = docs_of(spark, {i: " ".join(t) for i, t in texts.items()})
    bench = items_of(spark, [(i, " ".join(t)) for i, t in items.items()])
    got = sorted(tuple(r) for r in decontaminate.overlaps(docs, bench).collect())
    assert got == sorted(want) and {r[0] for r in got} == set(items)
    assert decontaminate.keep_clean(docs, bench).count() == 0


def test_benchmark_in_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    rng = random.Random(2)
    items = {i: " ".join(str(rng.randint(0, 10**6)) for _ in range(15)) for i in range(12)}
    docs = docs_of(spark, {i: f"x y {t} z" for i, t in items.items()})
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items_of(spark, items.items())).collect()}
    assert got == {(i, i) for i in items}
    assert decontaminate.overlaps(docs, items_of(spark, [])).count() == 0
    assert decontaminate.overlaps(docs_of(spark, {}), items_of(spark, items.items())).count() == 0


def brute_coverage(texts, n):
    words = {i: WORD.findall(lower(t)) for i, t in texts.items()}
    owners = {}
    for i, w in words.items():
        for a in range(len(w) - n + 1):
            owners.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = {}
    for i, w in words.items():
        covered = {p for a in range(len(w) - n + 1) if len(owners[tuple(w[a : a + n])]) > 1 for p in range(a, a + n)}
        if covered:
            out[i] = covered
    return out


def test_repeated_passages_same_as_brute_force(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    hot, pair, short = words(60), words(51), words(49)
    texts = {i: words(rng.randint(0, 80)) + hot + words(rng.randint(0, 80)) for i in range(40)}
    texts |= {100: words(20) + pair, 101: pair + words(30), 102: words(9) + short, 103: short + words(9), 104: words(300), 105: pair[:25] + words(1) + pair[25:]}
    texts |= {106: words(200)}
    texts[107] = texts[106][:]
    repeated = words(10) * 20
    texts |= {108: repeated, 109: words(5) + repeated + words(5)}
    texts = {i: " ".join(t) for i, t in texts.items()} | {110: None, 111: "", 112: "the " * 500}
    got = {r["doc_id"]: {p for s in r["spans"] for p in range(s["start"], s["end"])} for r in suffixes.repeated_passages(docs_of(spark, texts)).collect()}
    assert got == brute_coverage(texts, 50)
    first = {r["doc_id"]: (r["first_other"], r["is_first"]) for r in suffixes.repeated_passages(docs_of(spark, texts)).collect()}
    assert first[100] == (101, True) and first[107] == (106, False)


def test_first_documents_of_a_large_group(spark):
    rng = random.Random(13)
    words = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    hot, other = words(60), words(55)
    texts = {i: words(rng.randint(5, 60)) + hot + words(rng.randint(5, 60)) for i in rng.sample(range(10_000), 600)}
    for i in rng.sample(sorted(texts), 200):
        texts[i] += other
    texts |= {20_000 + i: words(rng.randint(5, 60)) + other + words(20) for i in range(100)}
    owners = {}
    for i, w in texts.items():
        for a in range(len(w) - 49):
            owners.setdefault(tuple(w[a : a + 50]), set()).add(i)
    want = {}
    for held in owners.values():
        low = sorted(held)[:2]
        for i in held if len(held) > 1 else ():
            want[i] = min(want.get(i, 10**9), low[1] if i == low[0] else low[0])
    got = suffixes.repeated_passages(docs_of(spark, {i: " ".join(w) for i, w in texts.items()})).collect()
    assert {r["doc_id"]: r["first_other"] for r in got} == want and len(want) == 700
    assert all(r["is_first"] == (r["doc_id"] < want[r["doc_id"]]) for r in got) and sum(r["is_first"] for r in got) == 1


def test_passages_of_odd_tables(spark):
    assert suffixes.repeated_passages(docs_of(spark, {})).count() == 0
    text = " ".join(f"v{i}" for i in range(80))
    rows = [(1, text), (1, text), (None, text), (2, None)]
    assert suffixes.repeated_passages(docs_of(spark, rows)).count() == 0


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, v int")


def brute_top_k(rows, k):
    ints = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows]
    out = []
    for q, x in {(i, tuple(v)): (i, v) for i, v in ints if i % 20 == 0}.values():
        best = sorted((-int(x @ y), j) for j, y in ints if j != q)[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 150)
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 16)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(90)] + [(3, rows[3][1])]
    odd = [(2000, None), (2001, [None] * 8), (2020, [float("nan")] * 8), (2040, [float("inf")] * 8), (2060, [1.0]), (2080, []), (None, rows[0][1])]
    got = kdtree.top_k(vectors_of(spark, rows + odd), F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_top_k(rows, 20)


def test_top_k_of_few_and_of_none(spark):
    assert kdtree.top_k(vectors_of(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert kdtree.top_k(vectors_of(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert kdtree.top_k(vectors_of(spark, [(1, [1.0]), (3, [2.0])]), F.col("vec_id") % 20 == 0).count() == 0
    big = [(0, [3e5, -3e5]), (1, [3e5, 1.0]), (20, [-3e5, 2.0])]
    got = sorted(tuple(r) for r in kdtree.top_k(vectors_of(spark, big), F.col("vec_id") % 20 == 0).collect())
    assert got == brute_top_k(big, 20)


def test_tree_leaves_cover_all_rows():
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 3, (1000, 4))
    order, first = kdtree.build(x, 10)
    assert sorted(order.tolist()) == list(range(1000)) and first[0] == 0 and first[-1] == 1000 and np.diff(first).max() <= 10


def test_best_first_search_opens_few_nodes_of_clustered_vectors():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (40, 12))
    vectors = centres[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 12))
    order, first = kdtree.build(vectors)
    ids, vectors = order.astype(np.int64), vectors[order]
    queries, k = vectors[:200], 5
    none = np.full(len(queries), np.iinfo(np.int64).min)
    q, i, s, kth, seen = kdtree.search(ids, vectors, first, ids[:200], queries, none, k)
    scores = queries @ vectors.T
    for n in range(len(queries)):
        want = sorted((-scores[n, m], ids[m]) for m in range(len(ids)) if ids[m] != ids[n])[:k]
        assert [(-a, b) for a, b in zip(s[q == n], i[q == n])] == want and kth[n] == -want[-1][0]
    nodes = kdtree.boxes(vectors, first)
    assert seen < 0.5 * len(queries) * len(nodes.low)
    for n, (a, b) in enumerate(nodes.children):
        if a >= 0:
            assert (nodes.low[n] == np.minimum(nodes.low[a], nodes.low[b])).all() and (nodes.high[n] == np.maximum(nodes.high[a], nodes.high[b])).all()
    assert (nodes.low[0] == vectors.min(axis=0)).all() and sorted(r for r in nodes.rows[:, 0] if r >= 0) == first[:-1].tolist()
    again = kdtree.search(ids, vectors, first, ids[:200], queries, kth, k)
    assert again[4] <= seen and (again[2] == s).all()  # with k-th scores handed on from elsewhere


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        kdtree.top_k(rows, F.col("vec_id") % 20 == 0)


def test_rows_without_id_are_judged_by_their_text(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    rows = [(None, f"x {passage} y"), (None, "clean text"), (7, passage), (7, "clean too"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.keep_clean(docs, items_of(spark, [(1, passage)]))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("7", "clean too"), ("8", "None"), ("None", "clean text")]


def test_passages_whose_partners_match_longer_elsewhere_are_found(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    texts, n = {}, 0
    for _ in range(4):
        middle, left, right = [word() for _ in range(50)], [word() for _ in range(40)], [word() for _ in range(40)]
        noise = lambda k: [word() for _ in range(k)]
        texts[n] = noise(5) + left + middle + right + noise(5)
        texts[n + 1] = noise(9) + middle + noise(9)
        for i in range(12):  # longer matches to the left or the right of the passage, of less than 50 words
            texts[n + 2 + i] = noise(4) + (left[-20:] + middle[:29] if i % 2 else middle[-29:] + right[:20]) + noise(4)
            texts[n + 20 + i] = noise(3) + (texts[n + 1][-29 - 9 :][:38] if i % 2 else texts[n + 1][:38]) + noise(3)
        n += 40
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffixes.repeated_passages(docs).collect()}
    assert got == {k: v for i in range(0, n, 40) for k, v in ((i, [(45, 95)]), (i + 1, [(9, 59)]))}
