"""Source divergence: brute force in exact whole numbers, split digests, blocks of sources, edges."""

import random
import re
from collections import Counter, defaultdict

import pytest

from sevfold.llm import divergence, queries
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, digest long, value int, term string, count long"


def brute(rows, min_docs=10, top=10):
    docs = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for _, _, ws in mine for t in set(ws)).items() if n >= min_docs}
        counts = defaultdict(Counter)
        for _, source, ws in mine:
            counts[source].update(w for w in ws if w in kept)
        whole = sum(counts.values(), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] > 0 and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def rows_of(n, seed, sources=7):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "gamma's", "délta", "ÉTÉ", "été", "日本", "x1y", "z-z", "the", "THE", "Zz", "rare"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    out = []
    for _ in range(n):
        source = rnd.choice([None, ""] + ["hot"] * 6 + [f"s{i}" for i in range(sources)])
        pool = words[: rnd.randint(3, len(words))]
        out.append((" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))), rnd.choice([None, "", "en", "en", "en", "fr"]), source))
    return out + [(None, "en", "only null"), ("", "xx", "a"), (None, "xx", "b"), ("12 34", "xx", None), ("lone", "yy", "one")]


def frame(spark, rows):
    return spark.createDataFrame([(i % 50 or None, *r, 1, 2, "t", 3) for i, r in enumerate(rows)], SCHEMA)


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("bits", [64, 4, 7])
def test_equals_brute_force_also_where_digests_collide(spark, bits):
    rows = rows_of(300, bits)
    assert result(divergence.divergence(frame(spark, rows), bits=bits)) == brute(rows)


def test_many_sources_in_small_blocks_and_other_bounds(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 5)
    rows = rows_of(150, 3, sources=20)
    assert result(divergence.divergence(frame(spark, rows), min_docs=3, top=2)) == brute(rows, 3, 2)


def test_ties_go_to_the_first_term_and_counts_may_be_huge(spark):
    rows = [(" ".join(f"t{chr(97 + i)}" for i in range(26)), "en", "a")] * 12 + [("z", "en", "b")] * 12
    got = result(divergence.divergence(frame(spark, rows)))
    assert got == brute(rows) and [g[3] for g in got if g[1:3] == ("a", "term")] == [f"t{c}" for c in "abcdefghij"]
    big = spark.createDataFrame([(9 * 10**17, 9 * 10**18, 10**6)], "c long, n long, v long")
    assert big.select(divergence.share("c", "n", "v")).first()[0] == 1 + 10**9 * (9 * 10**17 + 2) // (9 * 10**18 + 2 * 10**6)


def test_empty_table_and_long_text(spark):
    assert divergence.divergence(frame(spark, [])).count() == 0
    rows = [("Big " * 400_000 + "end", "en", "a")] + [("big end", "en", "b")] * 10
    assert result(divergence.divergence(frame(spark, rows))) == brute(rows)


def test_query_against_sql(spark):
    name = "op12_source_divergence"
    assert compare(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) is None
