"""Queries on code cleaning, line scopes, tokens, grams, prompts and page fields."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, functions as F

from sevfold.functions import code as fc, cvss, text as tx
from sevfold.functions.stem import stem_tokens
from sevfold.operators.vocabulary import char_gram_counts
from sevfold.plans import pages as pg, prompts as pr
from sevfold.plans.slices import SCOPES, slice_all_scopes, slice_table, with_lines
from sevfold.queries import derived as d
from sevfold.queries.registry import Tables, query


@query(
    "f1_clean_code",
    f"""WITH {d.FUNCS},
        s1 AS (SELECT id, regexp_replace(func_before, '//[^\\n]*\\n', '', 'g') AS c FROM funcs),
        s2 AS (SELECT id, regexp_replace(c, '/\\*.*?\\*/', '', 'gs') AS c FROM s1),
        s3 AS (SELECT id, regexp_replace(c, '(?m)^\\s*$', '', 'g') AS c FROM s2),
        s4 AS (SELECT id, replace(c, chr(9), '') AS c FROM s3)
        SELECT id, regexp_replace(c, '(?m)^\\s+', '', 'g') AS code FROM s4""",
)
def f1(t: Tables) -> DataFrame:
    return d.funcs(t).select("id", fc.clean_code(F.col("func_before")).alias("code"))


FILTERED = """CASE WHEN contains(l, '//') THEN left(l, instr(l, '//') - 1)
  WHEN contains(l, '/*') AND contains(l, '*/') THEN left(l, instr(l, '/*') - 1) || substr(l, instr(l, '*/') + 2) ELSE l END"""


def sliced(lines: str) -> str:
    return f"array_to_string(list_transform({lines}, lambda l: {FILTERED}), chr(10))"


@query("f2_filter_lines", f"WITH {d.FUNCS} SELECT id, {sliced('lines')} AS code FROM funcs")
def f2(t: Tables) -> DataFrame:
    return with_lines(d.funcs(t)).select("id", fc.filter_lines(F.col("lines")).alias("code"))


@query("f3_split_lines", f"WITH {d.FUNCS} SELECT id, CAST(unnest(range(len(lines))) AS INT) AS pos, unnest(lines) AS line FROM funcs")
def f3(t: Tables) -> DataFrame:
    return d.funcs(t).select("id", F.posexplode(fc.split_lines(F.col("func_before"))).alias("pos", "line"))


@query("f4_parse_lines", f"WITH {d.FUNCS} SELECT id, CAST(unnest(vul) AS INT) AS line FROM funcs")
def f4(t: Tables) -> DataFrame:
    return d.funcs(t).select("id", F.explode(fc.parse_lines(F.col("vul_line"))).alias("line"))


def picked(numbers: str) -> str:
    return sliced(f"list_transform({numbers}, lambda i: lines[i])")


OTHERS = "list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(vul, i))"
AROUND = "list_sort(list_distinct(flatten(list_transform(vul, lambda v: range(greatest(v - 6, 1), least(v + 6, len(lines)) + 1)))))"
RANDOM = f"""list_transform(list_slice(list_sort(list_transform({OTHERS},
  lambda i: {{'h': md5(concat_ws('|', id, i, '42')), 'line': i}})), 1, len(vul)), lambda s: s.line)"""
SCOPE_SQL = {
    "whole": sliced("lines"),
    "lines_without_context": picked("vul"),
    "lines_with_surrounding_context": picked(AROUND),
    "context_only": sliced("list_filter(lines, lambda x, i: NOT list_contains(vul, i))"),
    "surrounding_only": picked(f"list_filter({AROUND}, lambda i: NOT list_contains(vul, i))"),
    "random_context": picked(RANDOM),
}
QUERY_OF_SCOPE = {
    "whole": "f11_slice_all", "lines_without_context": "f5_slice_vuln", "lines_with_surrounding_context": "f8_slice_surrounding",
    "context_only": "f6_slice_context", "surrounding_only": "f9_slice_surrounding_only", "random_context": "f10_slice_random",
}


def register_scope(scope: str) -> None:
    @query(QUERY_OF_SCOPE[scope], f"WITH {d.FUNCS} SELECT id AS key, severity, partition, {SCOPE_SQL[scope]} AS code FROM funcs")
    def sliced_table(t: Tables) -> DataFrame:
        return slice_table(d.funcs(t), scope, ["severity", "partition"])


for _scope in SCOPES:
    register_scope(_scope)


@query(
    "f5_f11_all_scopes",
    f"WITH {d.FUNCS} SELECT id AS key, severity, {', '.join(f'md5({sql}) AS {s}' for s, sql in SCOPE_SQL.items())} FROM funcs",
)
def all_scopes(t: Tables) -> DataFrame:
    wide = slice_all_scopes(d.funcs(t), ["severity"])
    return wide.select("key", "severity", *[F.md5(s).alias(s) for s in SCOPES])


@query("f7_scope_lines", f"WITH {d.FUNCS} SELECT id, array_to_string({AROUND}, ' ') AS scope FROM funcs")
def f7(t: Tables) -> DataFrame:
    scope = fc.scope_lines(F.col("lines"), F.col("vul"), 6)
    return with_lines(d.funcs(t)).select("id", F.array_join(scope.cast("array<string>"), " ").alias("scope"))


@query(
    "o2_sorted_distinct_lines",
    f"WITH {d.FUNCS} SELECT id, array_to_string(list_sort(list_distinct(list_concat(vul, [1, len(lines)]))), ' ') AS numbers FROM funcs",
)
def o2(t: Tables) -> DataFrame:
    both = F.concat(F.col("vul"), F.array(F.lit(1), F.size("lines")))
    return with_lines(d.funcs(t)).select("id", F.array_join(F.sort_array(F.array_distinct(both)).cast("array<string>"), " ").alias("numbers"))


HEAD = "array_to_string(list_slice(string_split(text, ' '), 1, {n}), ' ')"


@query("f12_head_words", f"SELECT doc_id, {HEAD.format(n=384)} AS text_a, {HEAD.format(n=64)} AS text_b FROM documents")
def f12(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", tx.head_words(text, 384).alias("text_a"), tx.head_words(text, 64).alias("text_b"))


PROMPT_SQL = {
    "mixed": """'The code snippet: ' || a || ' The vulnerability description:" ' || b || ' Classify the severity: <mask>'""",
    "hard": """'The code snippet: ' || a || ' The vulnerability description:" ' || b || ' Classify the severity: <mask>'""",
    "soft": "'The code snippet: ' || a || ' The vulnerability description: ' || b || ' Classify the severity: <mask>'",
    "code_only": "'The code snippet: ' || a || ' Classify the severity: <mask>'",
    "description_only": "'The vulnerability description: ' || b || ' Classify the severity: <mask>'",
    "other_model": "'The code snippet: ' || a || ' The vulnerability description: ' || b || ' Classify the severity: <mask>'",
    "concat": "a || '<desc>' || b",
}
EXAMPLES = f"""{d.FUNCS}, cut AS (
  SELECT id, {HEAD.format(n=384).replace('text', 'func_before')} AS a, {HEAD.format(n=64).replace('text', 'f.text')} AS b, f.severity
  FROM funcs JOIN docs f ON f.doc_id = id)"""


def examples(t: Tables) -> DataFrame:
    described = d.funcs(t, "text").withColumn("description", F.col("text"))
    return pr.prompt_examples(described.withColumn("label", cvss.severity_code(F.col("severity"))), "id", "func_before", "description", "label")


@query(
    "f13_render_prompt",
    f"WITH {EXAMPLES} " + " UNION ALL ".join(f"SELECT id AS guid, '{v}' AS variant, md5({sql}) AS prompt FROM cut" for v, sql in PROMPT_SQL.items() if v != "concat"),
)
def f13(t: Tables) -> DataFrame:
    base = examples(t)
    variants = [v for v in pr.TEMPLATES if v != "concat"]
    rendered = F.inline(
        F.array(*[
            F.struct(F.lit(v).alias("variant"), F.md5(pr.prompt_text(pr.TEMPLATES[v], F.col("text_a"), F.col("text_b"), "<mask>")).alias("prompt"))
            for v in variants
        ])
    )
    return base.select("guid", rendered)


def _parts_sql() -> str:
    """Texts and softness of the parts of each variant, written out from the tables of templates."""
    rows = []
    for variant in pr.TEMPLATES:
        values = {"{a}": "a", "{b}": "b"}
        for i, (text, soft) in enumerate(pr.prompt_pieces(variant)):
            text = text.replace("{mask}", "<mask>")
            sql = sql_text(text)
            for mark, column in values.items():
                sql = sql.replace(mark, f"' || {column} || '")
            rows.append(f"SELECT id AS guid, '{variant}' AS variant, {i}::INT AS place, md5({sql}) AS text, {str(soft).upper()} AS soft FROM cut")
    return " UNION ALL ".join(rows)


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("f13_prompt_parts", f"WITH {EXAMPLES} {_parts_sql()}")
def f13b(t: Tables) -> DataFrame:
    base = examples(t)
    variants = [F.struct(F.lit(v).alias("variant"), pr.parts_of(v, F.col("text_a"), F.col("text_b"), "<mask>").alias("parts")) for v in pr.TEMPLATES]
    flat = base.select("guid", F.inline(F.array(*variants))).select("guid", "variant", F.posexplode("parts").alias("place", "p"))
    return flat.select("guid", "variant", "place", F.md5("p.text").alias("text"), "p.soft")


@query("f14_concat_prompt", f"WITH {EXAMPLES} SELECT id AS guid, {PROMPT_SQL['concat']} AS prompt FROM cut")
def f14(t: Tables) -> DataFrame:
    return pr.render_prompt(examples(t), "concat").select("guid", "prompt")


@query("f15_word_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INT) AS words FROM documents")
def f15(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.word_count(F.col("text")).alias("words"))


STOP_SQL = "[" + ", ".join(sql_text(w) for w in [*tx.STOP_WORDS, tx.EXTRA_STOP_WORD]) + "]"


@query(
    "f16_normalize_text",
    f"""WITH spaced AS (SELECT conv_id, turn, regexp_replace(lower(text), {sql_text(tx.CLITIC)}, ' \\1', 'g') AS c FROM conversations),
        words AS (SELECT conv_id, turn, regexp_extract_all(c, {sql_text(tx.WORD_TOKEN.replace(')*+', ')*'))}) AS w FROM spaced)
        SELECT conv_id, turn, array_to_string(list_filter(w, lambda x: NOT contains({sql_text(string.punctuation)}, x)
               AND NOT list_contains({STOP_SQL}, x)), ' ') AS words FROM words""",
)
def f16(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(tx.description_words(F.col("text")), " ").alias("words"))


@query("f17_stem_tokens")
def f17(t: Tables) -> DataFrame:
    stems = stem_tokens(tx.description_words(F.col("text")))
    return t.conversations.select("conv_id", "turn", F.array_join(stems, " ").alias("processed_description"))


CODE_TOKEN_SQL = sql_text(tx.CODE_TOKEN)


@query("f18_code_tokens", f"WITH {d.FUNCS} SELECT id, array_to_string(regexp_extract_all(func_before, {CODE_TOKEN_SQL}), ' ') AS tokens FROM funcs")
def f18(t: Tables) -> DataFrame:
    return d.funcs(t).select("id", F.array_join(tx.code_tokens(F.col("func_before")), " ").alias("tokens"))


DESC_SQL = "list_filter(regexp_extract_all(lower(text), '\\S*[A-Za-z]\\S+'), lambda w: w <> 'aka')"


@query("f19_desc_tokens", f"SELECT doc_id, array_to_string({DESC_SQL}, ' ') AS tokens FROM documents")
def f19(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(tx.desc_tokens(F.col("text")), " ").alias("tokens"))


@query(
    "f20_ngrams",
    f"""WITH words AS (SELECT doc_id, {DESC_SQL} AS w FROM documents), sizes AS (SELECT unnest([1, 2, 3, 4]) AS n),
        flat AS (SELECT doc_id, unnest(w) AS t1, unnest(range(len(w))) AS i FROM words),
        led AS (SELECT t1, lead(t1) OVER o AS t2, lead(t1, 2) OVER o AS t3, lead(t1, 3) OVER o AS t4 FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        grams AS (SELECT CASE n WHEN 1 THEN t1 WHEN 2 THEN t1 || ' ' || t2 WHEN 3 THEN t1 || ' ' || t2 || ' ' || t3
                         ELSE t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 END AS gram FROM led, sizes)
        SELECT gram, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY 1""",
)
def f20(t: Tables) -> DataFrame:
    words = t.documents.select(tx.desc_tokens(F.col("text")).alias("w"))
    return words.select(F.explode(tx.ngrams(F.col("w"), 1, 4)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


GRAMS_SQL = """plain AS (SELECT doc_id, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS c FROM documents),
chars AS (SELECT doc_id, unnest(ch) AS c1, unnest(range(len(ch))) AS i FROM (SELECT doc_id, regexp_extract_all(c, '(?s).') AS ch FROM plain)),
led AS (SELECT doc_id, c1, lead(c1) OVER o AS c2, lead(c1, 2) OVER o AS c3, lead(c1, 3) OVER o AS c4, lead(c1, 4) OVER o AS c5, lead(c1, 5) OVER o AS c6
        FROM chars WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sizes AS (SELECT unnest(range(3, 7)) AS n),
grams AS (SELECT doc_id, n, CASE n WHEN 2 THEN c1 || c2 WHEN 3 THEN c1 || c2 || c3 WHEN 4 THEN c1 || c2 || c3 || c4
            WHEN 5 THEN c1 || c2 || c3 || c4 || c5 ELSE c1 || c2 || c3 || c4 || c5 || c6 END AS gram FROM led, sizes)"""


@query("f21_char_ngrams", f"WITH {GRAMS_SQL} SELECT gram, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY 1")
def f21(t: Tables) -> DataFrame:
    return char_gram_counts(t.documents, F.col("text"), 3, 6)


@query(
    "f22_usable_grams",
    f"""WITH {GRAMS_SQL} SELECT doc_id, count(DISTINCT trim(gram, ' ' || chr(10))) AS n FROM grams
        WHERE regexp_matches(gram, '^\\s*\\S\\S+\\s*$') GROUP BY 1""",
)
def f22(t: Tables) -> DataFrame:
    counts = t.documents.select("doc_id", F.size(tx.usable_grams(tx.char_ngrams(F.col("text"), 3, 6))).cast("long").alias("n"))
    return counts.filter("n > 0")


@query("f23_clean_changes", "SELECT doc_id, text FROM documents")
def f23(t: Tables) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit(" "), F.lit(" ##<END>##\n"))
    return t.documents.select("doc_id", fc.clean_changes(marked).alias("text"))


VECTOR_PARTS = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "NLH", "I": "NLH", "A": "NLH"}


def cvss_text(t: Tables) -> DataFrame:
    """A CVSS-3.1 vector per event, its metrics set by the event's number."""
    event = F.col("event_id")
    parts = [
        F.concat(F.lit(f"/{m}:"), F.substring(F.lit(letters), (event % len(letters) + 1).cast("int"), F.lit(1)))
        for m, letters in VECTOR_PARTS.items()
    ]
    links = F.array(F.lit("CVE details"), F.concat(F.lit("CVSS:3.1"), *parts), F.lit("CVSS:3.0/AV:N"))
    return t.events.select("event_id", links.alias("links"))


def _letter(m: str) -> str:
    letters = VECTOR_PARTS[m]
    return f"substr('{letters}', CAST(event_id % {len(letters)} AS INT) + 1, 1)"


def _code(m: str) -> str:
    cases = " ".join(f"WHEN '{label}' THEN {code}" for label, code in cvss.CVSS3_CODES[m].items())
    return f"CAST(CASE {_letter(m)} {cases} END AS INT) AS {m}"


@query("f27_cvss_codes", f"SELECT event_id, {', '.join(_code(m) for m in VECTOR_PARTS)} FROM events")
def f27(t: Tables) -> DataFrame:
    metrics = cvss_text(t).select("event_id", cvss.parse_cvss(cvss.pick_cvss(F.col("links"))).alias("m"))
    return metrics.select("event_id", *[c.alias(m) for m, c in cvss.cvss_codes(F.col("m")).items()])


@query("f28_parse_cvss", "SELECT event_id, metric, letter FROM (" + " UNION ALL ".join(f"SELECT event_id, '{m}' AS metric, {_letter(m)} AS letter FROM events" for m in VECTOR_PARTS) + ")")
def f28(t: Tables) -> DataFrame:
    metrics = cvss.parse_cvss(cvss.pick_cvss(F.col("links")))
    return cvss_text(t).select("event_id", F.explode(metrics).alias("metric", "letter"))


PAGE_RULES = {"title": "<title>([^<]*)</title>", "heading": "<h1>([^<]*)</h1>", "first_link": '<a href="[^"]*">([^<]*)</a>', "score": "CVSS ([0-9.]+)"}


@query("f29_extract_fields", "SELECT page_id, " + ", ".join(f"nullif(regexp_extract(html, {sql_text(r)}, 1), '') AS {n}" for n, r in PAGE_RULES.items()) + " FROM pages")
def f29(t: Tables) -> DataFrame:
    return pg.extract_fields(t.pages, "html", PAGE_RULES).select("page_id", *PAGE_RULES)


@query(
    "f29_cve_records",
    """SELECT page_id, 'CVE-2023-' || page_id AS cve_id, 'CVSS:3.1/AV:N' AS cvss_vector, page_id || '.5' AS base_score,
              CASE WHEN page_id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS base_severity FROM pages""",
)
def f29b(t: Tables) -> DataFrame:
    page = F.col("page_id").cast("string")
    html = F.concat(
        F.lit('<div id="contentdiv"><h1><a href="/cve/">CVE-2023-'), page,
        F.lit('</a></h1><table class="table table-borderless"><tr><th>Base Score</th></tr><tr><td class="ps-2"><div>0.1</div></td><td class="ps-2">OLD</td></tr>'
              '<tr>\n<td class="ps-2">\n<div class="cvssbox"> '), page, F.lit('.5 </div></td><td class="ps-2"> '),
        F.when(F.col("page_id") % 2 == 0, "HIGH").otherwise("LOW"), F.lit(' </td><td class="ps-2"><a href="#">\nCVSS:3.1/AV:N </a></td></tr></table></div>'),
        F.col("html"),
    )
    records = pg.cve_records(t.pages.withColumn("html", html))
    return records.select("page_id", "cve_id", "cvss_vector", "base_score", "base_severity")


@query(
    "f30_extract_links",
    """WITH links AS (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*?\\bhref=["'']([^"'']*)["'']', 1) AS l FROM pages)
       SELECT page_id, array_to_string(list_filter(l, lambda x: contains(x, '/') AND contains(x, 'th')), ' ') AS links FROM links""",
)
def f30(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(pg.extract_links(F.col("html"), ["/", "th"]), " ").alias("links"))


@query(
    "f31_year_links",
    """WITH links AS (SELECT page_id, string_split(url, '/')[5] AS last, url FROM pages),
       named AS (SELECT page_id, string_split(last, '?')[1] AS text, '/' || last AS href FROM links)
       SELECT page_id, CAST(text AS INT) AS year, 'https://www.cvedetails.com' || href AS url
       FROM named WHERE regexp_matches(trim(text), '^\\d+$') AND CAST(CASE WHEN regexp_matches(text, '^\\d+$') THEN text END AS BIGINT) BETWEEN 100 AND 600""",
)
def f31(t: Tables) -> DataFrame:
    last = F.get(F.split("url", "/"), F.lit(4))
    links = t.pages.select("page_id", F.get(F.split(last, r"\?"), F.lit(0)).alias("text"), F.concat(F.lit("/"), last).alias("href"))
    return pg.year_links(links, "text", "href", 100, 600).select("page_id", "year", "url")


@query("f35_cve_year", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1999 + doc_id % 25 AS INT) END AS year FROM documents")
def f35(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    prefix = F.when(doc % 3 == 0, "BUG-").otherwise("CVE-")
    cve = F.concat(prefix, (1999 + doc % 25).cast("string"), F.lit("-"), doc.cast("string"))
    return t.documents.select("doc_id", cvss.cve_year(cve).alias("year"))
