"""Tokens, grams, stems, labels and page fields on hand-made cases."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sevfold.functions import cvss, text as tx
from sevfold.functions.stem import porter, stem_tokens
from sevfold.operators.vocabulary import apply_label_index, char_gram_counts, label_index, term_table, vocabulary
from sevfold.plans import pages as pg, prompts as pr


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a-=b--c", ["a", "-=", "b", "--", "c"]),
        ("x/=2", ["x", "/=", "2"]),
        ("a||b|=c|d", ["a", "||", "b", "|=", "c", "|", "d"]),
        ("p->q[i]<=3?x:y_z", ["p", "-", ">", "q", "i", "<=", "3", "?", "x", ":", "y", "z"]),
        ("", []),
    ],
)
def test_code_tokens(spark, text, expected):
    assert one(spark, text, tx.code_tokens) == expected


def test_desc_tokens(spark):
    assert one(spark, "A Buffer aka over-flow in v1.2 x", tx.desc_tokens) == ["buffer", "over-flow", "in", "v1.2"]


def test_description_words(spark):
    words = one(spark, "The parser doesn't check (size) -- it's aka Buffer-Overflow, v1.2.", tx.description_words)
    assert words == ["parser", "n't", "check", "size", "--", "'s", "buffer-overflow", "v1.2"]


def test_description_words_of_long_junk(spark):
    assert one(spark, "a-" * 50_000 + "b c", lambda c: F.size(tx.description_words(c))) == 2


def test_grams(spark):
    assert one(spark, "a b c", lambda c: tx.ngrams(F.split(c, " "), 1, 4)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, "", lambda c: tx.ngrams(F.array(), 1, 2)) == []
    assert one(spark, "ab", lambda c: tx.char_ngrams(c, 3, 6)) == []
    assert one(spark, "AbÉ  d\n", lambda c: tx.char_ngrams(c, 3, 4)) == ["abé", "bé ", "é d", " d\n", "abé ", "bé d", "é d\n"]
    grams = F.array(*[F.lit(g) for g in (" ab", "ab ", "a b", " a ", "abc", "\nab")])
    assert one(spark, "", lambda c: tx.usable_grams(grams)) == ["ab", "abc"]


def test_char_ngrams_of_long_text(spark):
    text = "xyz" * 40_000
    assert one(spark, text, lambda c: F.size(tx.char_ngrams(c, 3, 6))) == sum(len(text) - n + 1 for n in range(3, 7))


def test_char_gram_counts(spark, monkeypatch):
    """Places make one gram each, of the longest size, and the counts are those of all grams cut one by one."""
    texts = ["AbÉ  d\n", "ab", "abc", "", None, "x" * 30, "a\U0001f600b\U0001f600c\U0001f600d", "İstanbul ΑΣ ΑΣ", "ab \t\n cd \t", "one two one two one", "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for lo, hi in ((3, 6), (1, 3), (2, 2), (1, 8)):
        cut = Counter(r["g"] for r in df.select(F.explode(tx.char_ngrams(F.col("t"), lo, hi)).alias("g")).collect())
        counts = char_gram_counts(df, F.col("t"), lo, hi)
        assert {r["gram"]: r["n"] for r in counts.collect()} == cut and counts.schema.simpleString() == "struct<gram:string,n:bigint>"
    made = []
    monkeypatch.setattr("sevfold.operators.vocabulary.char_ngrams", lambda c, *sizes: made.append(sizes) or tx.char_ngrams(c, *sizes))
    char_gram_counts(df, F.col("t"), 3, 6)
    assert made == [(6, 6), (3, 5)]


def test_ngrams_of_long_text_are_linear(spark):
    """A copy of the list of words for each gram would move 5 * 10^10 words."""
    start = time.perf_counter()
    words = F.split(F.repeat(F.lit("ab "), 120_000), " ")
    assert one(spark, "", lambda c: F.size(tx.ngrams(words, 1, 4))) == 4 * 120_001 - 6
    assert time.perf_counter() - start < 20
    assert one(spark, "", lambda c: tx.ngrams(F.array(F.lit("a"), F.lit(None), F.lit("c")), 2, 3)) == ["a", "c", "a c"]


def test_usable_grams_are_judged_once(spark):
    grams = F.split(F.lit(",".join([" ab", "ab ", "a b", " ab", "b", "\nabc", "ab ", "ab"] * 40)), ",")
    assert one(spark, "", lambda c: tx.usable_grams(grams)) == ["ab", "abc"]
    assert str(tx.usable_grams(F.col("g"))).count("array_distinct") == 2


def test_term_counts(spark):
    rows = one(spark, "b a b c b", lambda c: tx.term_counts(F.split(c, " ")))
    assert [tuple(r) for r in rows] == [("a", 1), ("b", 3), ("c", 1)]
    assert one(spark, "", lambda c: tx.term_counts(F.expr("cast(array() as array<string>)"))) == []


def test_vocabulary_bounds_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "a d"), (4, "")], "doc int, text string")
    terms = term_table(docs, ["doc"], tx.code_tokens(F.col("text")))
    top = vocabulary(terms, max_features=3).collect()
    assert [(r["term"], r["df"], r["cf"]) for r in top] == [("a", 3, 3), ("b", 1, 2), ("c", 1, 1)]
    assert {r["term"] for r in vocabulary(terms, F.lit(4), min_df=2).collect()} == {"a"}
    assert {r["term"] for r in vocabulary(terms, F.lit(4), min_df=0.25, max_df=0.5).collect()} == {"b", "c", "d"}
    assert {r["term"] for r in vocabulary(terms, F.lit(4), min_df=0.26).collect()} == {"a"}


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"),
        ("operator", "oper"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"),
        ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
    ],
)
def test_porter(word, stem):
    assert porter(word) == stem


def test_stem_arrays(spark):
    assert one(spark, "buffers overflowed", lambda c: stem_tokens(F.split(c, " "))) == ["buffer", "overflow"]


def test_labels(spark):
    df = spark.createDataFrame([("HIGH",), ("LOW",), (None,)], "s string")
    assert [r[0] for r in df.select(cvss.severity_code(F.col("s"))).collect()] == [2, 0, None]
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("WORST",)], "s string").select(cvss.severity_code(F.col("s"))).collect()
    index = label_index(df, "s")
    assert [(r["s"], r["code"]) for r in index.orderBy("code").collect()] == [("HIGH", 0), ("LOW", 1)]
    with pytest.raises(Exception, match="unseen label"):
        apply_label_index(spark.createDataFrame([("NEW",)], "s string"), index, "s").collect()


def test_cvss(spark):
    links = F.array(F.lit("page"), F.lit("CVSS:3.1/AV:N/AC:H/PR:L/UI:R/S:C/C:H/I:L/A:N"), F.lit("CVSS:3.0/AV:L"))
    metrics = one(spark, "", lambda c: cvss.parse_cvss(cvss.pick_cvss(links)))
    assert metrics == {"AV": "N", "AC": "H", "PR": "L", "UI": "R", "S": "C", "C": "H", "I": "L", "A": "N"}
    assert one(spark, "CVE-2021-44228", cvss.cve_year) == 2021
    assert one(spark, "GHSA-1", cvss.cve_year) is None


@pytest.mark.parametrize(
    "a, b, score", [("LOW", "LOW", 0), ("LOW", "MEDIUM", 0.5), ("HIGH", "LOW", 1), ("-", "HIGH", 0), ("HIGH", "-", 0), ("LOW", "ODD", None)]
)
def test_partial_score(spark, a, b, score):
    assert one(spark, "", lambda c: cvss.partial_score(F.lit(a), F.lit(b), cvss.LEVELS)) == score


def test_pages(spark):
    links = '<a class="x" href="https://github.com/a/commit/1">1</a><a href="https://github.com/a/issues">2</a>'
    html = f'<a href="https://github.com/b/commit/2">x</a><div style="overflow-x: scroll"><ul class="list-group rounded-0"><li>{links}</li></ul></div>'
    assert one(spark, html, pg.code_links) == ["https://github.com/a/commit/1"]
    links = spark.createDataFrame([("2023", "/y/2023"), (" 2023 ", "/b"), ("2022", "/c"), ("x", "/d"), ("99999999999", "/e")], "text string, href string")
    assert sorted(r["url"] for r in pg.year_links(links, "text", "href").collect()) == [pg.SITE + "/b", pg.SITE + "/y/2023"]


def test_fields_come_from_the_score_table_only(spark):
    cell = lambda s: f'<td class="ps-2"><div>{s}</div></td>'
    vector = '<td class="ps-2"><a href="#"> CVSS:3.1/AV:N </a></td>'
    table = f"<table class='table table-borderless'><tr>{cell('1.0')}{cell('LOW')}</tr><tr>{cell('9.8')}{cell('CRITICAL')}{vector}</tr></table>"
    page = f"<a>CVSS:3.0/DECOY</a><div id='contentdiv'><h1><a>CVE-1</a></h1>{table}</div><table><tr>{cell('7')}</tr></table><a>CVSS:3.1/LATE</a>"
    df = spark.createDataFrame([(1, page), (2, page.replace("table table-borderless", "other"))], "id int, html string")
    got = {r["id"]: (r["cve_id"], r["cvss_vector"], r["base_score"], r["base_severity"]) for r in pg.cve_records(df).collect()}
    assert got == {1: ("CVE-1", "CVSS:3.1/AV:N", "9.8", "CRITICAL"), 2: ("CVE-1", None, None, None)}


def test_tokens_of_long_junk_are_linear(spark):
    start = time.perf_counter()
    assert one(spark, "1" * 100_000 + " ab", tx.desc_tokens) == ["ab"]
    assert time.perf_counter() - start < 5


def test_prompt_parts_differ_by_variant(spark):
    df = spark.createDataFrame([(1, "a", "b", "0")], "id int, code string, description string, severity string")
    examples = pr.prompt_examples(df, "id", "code", "description", "severity")
    parts = {v: [(p["text"], p["soft"]) for p in pr.render_parts(examples, v).first()["parts"]] for v in pr.TEMPLATES}
    assert all("".join(t for t, _ in parts[v]) == pr.render_prompt(examples, v).first()["prompt"] for v in parts)
    assert parts["mixed"] != parts["hard"] and parts["soft"] != parts["other_model"]
    assert [t for t, soft in parts["soft"] if soft] == pr.SOFT_PARTS["soft"]


def test_prompts(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(7, text, text, "3")], "id int, code string, description string, severity string")
    examples = pr.prompt_examples(df, "id", "code", "description", "severity")
    row = pr.render_prompt(examples, "soft").first()
    assert row["text_a"].count(" ") == 383 and row["text_b"].count(" ") == 63 and row["tgt_text"] == 3
    assert row["prompt"].startswith("The code snippet: w0 ") and row["prompt"].endswith(" w63 Classify the severity: <mask>")
    assert pr.render_prompt(examples, "concat").first()["prompt"] == row["text_a"] + "<desc>" + row["text_b"]
    assert "w383" not in pr.render_prompt(examples, "description_only").first()["prompt"]


def test_verbalize_tie_takes_first_class(spark):
    scores = spark.createDataFrame([(1, "low", 0.2), (1, "slight", 0.4), (1, "high", 0.3), (1, "severe", 0.3), (1, "other", 9.0)], "id int, word string, score double")
    assert pr.verbalize(scores, "id", pr.LABEL_WORDS[2]).first()["pred_class"] == "LOW"
