"""Code cleaning and line scopes on hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from sevfold.functions import code as fc
from sevfold.queries import QUERIES


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("int a; // no newline at the end", "int a; // no newline at the end"),
        ("int a; // note\nint b;", "int a; int b;"),
        ('x = "http://x";\ny;', 'x = "http:y;'),
        ("a /* one\n two */ b", "a  b"),
        ("a /* x */ b /* y */ c", "a  b  c"),
        ("*/ a /*", "*/ a /*"),
        ("a;\n \nb;", "a;\nb;"),
        ("\ta;\n\t\tb;\tc;", "a;\nb;c;"),
        ("", ""),
    ],
)
def test_clean_code(spark, text, expected):
    assert one(spark, text, fc.clean_code) == expected


@pytest.mark.parametrize(
    "text", ["", "a", "a\n", "\n", "a\n\nb\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "a\r\n\r\n", "a\tb"]
)
def test_split_lines(spark, text):
    assert one(spark, text, fc.split_lines) == text.splitlines()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a // b /* c */", "a "),
        ("a /* b */ c /* d */", "a  c /* d */"),
        ("a /* b\nc */ d", "a /* b\nc */ d"),
        ("a /* // */ b", "a /* "),
        ("x */ y /* z", "x */ y  y /* z"),
    ],
)
def test_filter_lines(spark, text, expected):
    assert one(spark, text, lambda c: fc.filter_lines(fc.split_lines(c))) == expected


def scopes(spark, code, vul, k=6):
    df = spark.createDataFrame([(1, code, vul)], "key bigint, code string, vul string")
    lines, v = fc.split_lines(F.col("code")), fc.parse_lines(F.col("vul"))
    return df.select(
        fc.slice_vuln(lines, v).alias("vuln"),
        fc.slice_context(lines, v).alias("context"),
        fc.scope_lines(lines, v, k).alias("scope"),
        fc.slice_surrounding(lines, v, k).alias("surrounding"),
        fc.slice_surrounding_only(lines, v, k).alias("surrounding_only"),
        fc.random_lines(lines, v, F.col("key")).alias("random"),
        fc.slice_all(lines).alias("all"),
    ).first()


def test_scopes_of_long_function(spark):
    code = "\n".join(f"l{i}" for i in range(1, 31))
    row = scopes(spark, code, " 30 1  30 ")
    assert row["vuln"] == "l30\nl1\nl30"
    assert row["scope"] == [1, 2, 3, 4, 5, 6, 7, 24, 25, 26, 27, 28, 29, 30]
    assert row["surrounding_only"].split("\n")[0] == "l2" and "l30" not in row["surrounding_only"]
    assert row["context"].count("\n") == 27
    assert len(row["random"]) == 3 and not set(row["random"]) & {1, 30}
    assert set(row["surrounding"].split("\n")) == set(row["vuln"].split("\n")) | set(row["surrounding_only"].split("\n"))


def test_scopes_at_the_edges(spark):
    empty = scopes(spark, "", "1")
    assert (empty["vuln"], empty["context"], empty["scope"], empty["random"], empty["all"]) == ("", "", [], [], "")
    none = scopes(spark, "a\nb", None)
    assert (none["vuln"], none["context"], none["surrounding"]) == ("", "a\nb", "")
    all_lines = scopes(spark, "a\nb", "1 2")
    assert (all_lines["context"], all_lines["surrounding_only"], all_lines["random"]) == ("", "", [])
    outside = scopes(spark, "a\nb", "2 9")
    assert (outside["vuln"], outside["scope"]) == ("b", [1, 2])


def test_functions_without_lines_list_none(spark, tmp_path):
    big = 3 * 10**18 + 1  # seven times it is no long
    rows = [(0, "", "a"), (1, None, "a"), (2, "one, two. three", "b"), (big, "x. y. z. w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "length(text) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ask = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    listed = sorted((r["id"], r["line"]) for r in ask("f4_parse_lines"))
    assert listed == [(2, 1), (big, 2), (big, 4)]
    for name in ("f5_slice_vuln", "f6_slice_context", "f8_slice_surrounding", "f9_slice_surrounding_only", "f10_slice_random", "f11_slice_all"):
        code = {r["key"]: r["code"] for r in ask(name)}
        assert len(code) == 4 and code[0] == "" and code[2] is not None
    empty_md5 = "d41d8cd98f00b204e9800998ecf8427e"
    assert {v for r in ask("f5_f11_all_scopes") if r["key"] == 0 for k, v in r.asDict().items() if k not in ("key", "severity")} == {empty_md5}
    assert {r["id"]: r["scope"] for r in ask("f7_scope_lines")}[0] == ""
    assert {r["id"]: r["numbers"] for r in ask("o2_sorted_distinct_lines")}[0] == "0 1"
