"""Fields and links of stored vulnerability pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sevfold.functions.text import strip

# Where a vulnerability page holds its fields.
CVE_RULES = {
    "cve_id": r"""(?s)id=["']contentdiv["'].*?<h1[^>]*>.*?<a[^>]*>\s*(.*?)\s*</a>""",
}
SCORE_TABLE = r"""(?s)id=["']contentdiv["'].*?<table\b[^>]*\bclass=["']table table-borderless["'][^>]*>(.*?)</table>"""
VECTOR = r">\s*(CVSS:3[^<]*?)\s*<"
REFERENCE_LIST = r"""(?s)<div\b[^>]*\bstyle=["']overflow-x: scroll["'][^>]*>.*?<ul\b[^>]*\bclass=["']list-group rounded-0["'][^>]*>(.*?)</ul>"""
SCORE_ROW = r"<td[^>]*\bps-2\b"
SCORE_CELL = r'(?s)<td[^>]*\bps-2\b[^>]*>(.*?)</td>'
HREF = r"""<a\b[^>]*?\bhref=["']([^"']*)["']"""
SITE = "https://www.cvedetails.com"


def extract_fields(pages: DataFrame, html: str, rules: dict[str, str]) -> DataFrame:
    """First match of each rule's group as a column; an absent field is null."""
    return pages.withColumns({name: field(F.col(html), rule) for name, rule in rules.items()})


def field(html: Column, rule: str) -> Column:
    return F.nullif(F.regexp_extract(html, rule, 1), F.lit(""))


def plain_text(html: Column) -> Column:
    return F.nullif(strip(F.regexp_replace(html, "<[^>]*>", "")), F.lit(""))


def cve_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """Id, vector, score and severity of vulnerability pages.

    Vector and scores are looked for in the score table only; its last score row counts, and
    the last vector in the score cells of any row.
    """
    with_rules = extract_fields(pages, html, CVE_RULES)
    table_rows = F.transform(F.split(F.col("_table"), r"<tr\b"), lambda r: F.substring_index(r, "</tr>", 1))
    score_rows = F.filter(table_rows, lambda r: r.rlike(SCORE_ROW))
    cells = F.regexp_extract_all(F.try_element_at("_rows", F.lit(-1)), F.lit(SCORE_CELL), F.lit(1))
    every_cell = F.flatten(F.transform("_rows", lambda r: F.regexp_extract_all(r, F.lit(SCORE_CELL), F.lit(1))))
    vectors = F.flatten(F.transform(every_cell, lambda c: F.regexp_extract_all(c, F.lit(VECTOR), F.lit(1))))
    return (
        with_rules.withColumn("_table", F.regexp_extract(html, SCORE_TABLE, 1))
        .withColumn("_rows", score_rows).withColumn("_cells", cells)
        .withColumns({
            "cvss_vector": F.try_element_at(vectors, F.lit(-1)),
            "base_score": plain_text(F.get("_cells", F.lit(0))), "base_severity": plain_text(F.get("_cells", F.lit(1))),
        })
        .drop("_table", "_rows", "_cells")
    )


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def extract_links(html: Column, must: list[str]) -> Column:
    """Links of a page that contain all given words, as an array."""

    def has_all(link: Column) -> Column:
        found = F.lit(True)
        for word in must:
            found = found & link.contains(word)
        return found

    return F.filter(hrefs(html), has_all)


def code_links(html: Column) -> Column:
    """Links to commits in the page's list of references; links elsewhere do not count."""
    return extract_links(F.regexp_extract(html, REFERENCE_LIST, 1), ["github.com", "commit"])


def year_links(links: DataFrame, text: str, href: str, lo: int = 2023, hi: int = 2023, site: str = SITE) -> DataFrame:
    """Links whose text is a year within the bounds, with their absolute URL."""
    is_year = F.trim(text).rlike(r"^\d+$")
    year = F.trim(text).try_cast("int")
    return (
        links.filter(is_year & year.between(lo, hi))
        .withColumn("year", year)
        .withColumn("url", F.concat(F.lit(site), F.col(href)))
    )
