"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a run of ``RUN_WORDS`` words across line ends, so a notice may be wrapped at any word and
words far apart make none; a template is the words of a license notice. A block matches a template
when it holds at least ``PERCENT`` of its distinct words. Template words are put in
one global order, those that are in the fewest blocks of the corpus first. A matching block must
hold one of the first words of its template (the prefix), enough template words (length), and
enough of them at and after the shared word (position); only pairs that pass are verified.

Runs are cut at template words, and only in documents that hold enough words of some template as a
whole. A document holds the words of each of its runs, so this leaves out no match.

Everything is DataFrame functions. The corpus is read three times and never shuffled: word
counts are partial aggregates over the few hundred template words, the join is with the prefix
words of the templates, which is a table of fixed size, and only matches are shuffled.

Cases. A null text is empty. Rows that repeat get equal results each; a null id is reported as
null. A phrase counts at every place, in order of words, whatever stands between the words.
Templates that tie all count. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT = 90

# Phrases that mark a license wherever their words stand together.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# License notices and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

#: Words of a run: a little more than the longest template, for marks of comments between its lines.
RUN_WORDS = max(len(t.split()) for _, t in TEMPLATES) + 8


def word_set(text: str) -> list[str]:
    return list(dict.fromkeys(text.split()))


def need(n: int, percent: int = PERCENT) -> int:
    """Words of a template of ``n`` words that a matching block holds."""
    return -(-n * percent // 100)


def _words(x: Column) -> Column:
    """Words of one space each side, so neighbours do not share a space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), SEPARATORS, "  ")), F.lit(" "))


def _count(x: Column, part: Column) -> Column:
    return ((F.length(x) - F.length(F.replace(x, part, F.lit("")))) / F.length(part)).cast("long")


def _n_words(x: Column) -> Column:
    """Number of words of a text in the form of ``_words``."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("long")


def row_key(docs: DataFrame) -> Column:
    """The same for rows with equal id and text only."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")), F.length("text"))


def phrase_places(docs: DataFrame) -> DataFrame:
    """Words, and number, first and last place and labels of the phrases in each document."""
    base = docs.select("doc_id", row_key(docs).alias("key"), _words(F.coalesce("text", F.lit(""))).alias("w"))
    base = base.withColumn("n_words", F.when(F.length("w") > 2, _n_words(F.col("w"))).otherwise(F.lit(0).cast("long")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in sorted(PHRASES.items(), key=lambda p: p[1]):
        mark = " " + phrase.replace(" ", "  ") + " "
        has = F.contains("w", F.lit(mark))
        counts.append(F.when(has, _count(F.col("w"), F.lit(mark))).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(has, _n_words(F.substring_index("w", mark, 1))))
        after = _n_words(F.substring_index("w", mark, -1))
        lasts.append(F.when(has, F.col("n_words") - after - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    return base.select(
        "doc_id", "key", "n_words", reduce(lambda a, b: a + b, counts).alias("n_base"),
        F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_distinct(F.array_compact(F.array(*labels))).alias("base"),
    )


def _blocks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Template words of each line, in the order of ``vocabulary``, to count which are rare."""
    lines = docs.filter("text is not null").select(row_key(docs).alias("key"), F.posexplode(F.split("text", "\n")).alias("line", "block"))
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = lines.select("key", "line", F.array_intersect(known, F.split(F.lower("block"), SEPARATORS)).alias("words"))
    return found.filter(F.size("words") > 0)


def _runs(docs: DataFrame, order: list[str], rows: list[tuple]) -> DataFrame:
    """Template words, in the order of ``order``, of the runs of words that may match a template."""
    known = F.array(*[F.lit(w) for w in order])
    tokens = lambda x: F.filter(F.split(F.lower(x), SEPARATORS), lambda w: w != "")
    texts = docs.filter("text is not null").select(row_key(docs).alias("key"), "text")
    # Each explode of one value holds what is before it: no filter computes the words again.
    held = texts.select("key", "text", F.explode(F.array(F.array_intersect(known, F.split(F.lower("text"), SEPARATORS)))).alias("words"))
    templates = {r[1]: (r[3], r[4]) for r in rows}
    enough = reduce(
        lambda a, b: a | b,
        [F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in ws]))) >= least for ws, least in templates.values()],
    )
    may = held.filter((F.size("words") >= min(r[4] for r in rows)) & enough)
    places = F.filter(F.transform(tokens("text"), lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda p: F.array_contains(known, p["word"]))
    hits = may.select("key", F.explode(F.array(places)).alias("hits"))

    def run(k):
        end = F.element_at("hits", k)["at"] + RUN_WORDS
        inside = F.filter(F.slice(F.col("hits"), k, RUN_WORDS), lambda p: p["at"] < end)
        return F.array_intersect(known, F.transform(inside, lambda p: p["word"]))

    starts = F.sequence(F.lit(1), F.size("hits"))
    return hits.filter(F.size("hits") > 0).select("key", F.explode(F.array_distinct(F.transform(starts, run))).alias("words"))


def global_order(docs: DataFrame) -> list[str]:
    """Template words by the number of blocks that hold them, rare ones first."""
    vocabulary = sorted({w for _, t in TEMPLATES for w in word_set(t)})
    counts = _blocks(docs, vocabulary).select(F.explode("words").alias("word")).groupBy("word").count().collect()
    by_word = {r["word"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (by_word.get(w, 0), w))


def prefix_rows(order: list[str], percent: int = PERCENT) -> list[tuple]:
    """``word, template, label, words, need, pos`` for the prefix words of each template."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        words = sorted(word_set(text), key=rank.__getitem__)
        least = need(len(words), percent)
        rows += [(words[i], t, label, words, least, i) for i in range(len(words) - least + 1)]
    return rows


def template_matches(docs: DataFrame) -> DataFrame:
    """``key, labels, score``: labels of matching templates and the highest share, for documents with any."""
    order = global_order(docs)
    rows = prefix_rows(order)
    templates = docs.sparkSession.createDataFrame(rows, "word string, template int, label string, t_words array<string>, need int, t_pos int")
    least = min(r[4] for r in rows)
    first_words = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])
    blocks = _runs(docs, order, rows).filter((F.size("words") >= least) & F.arrays_overlap("words", first_words))
    probes = blocks.select("key", "words", F.posexplode("words").alias("pos", "word"))
    n, m = F.size("words"), F.size("t_words")
    most = F.least("pos", "t_pos") + F.least(n - F.col("pos"), m - F.col("t_pos"))
    pairs = probes.join(F.broadcast(templates), "word").filter((n >= F.col("need")) & (most >= F.col("need")))
    shared = F.size(F.array_intersect("words", "t_words"))
    matches = pairs.withColumn("shared", shared).filter("shared >= need").select("key", "label", (F.col("shared") / m).alias("share"))
    return matches.groupBy("key").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Words, phrase places, labels of phrases, labels of phrases and templates, and a score.

    The score is 1 with a phrase, else the highest share of a matching template, else 0.
    """
    rows = phrase_places(docs).join(template_matches(docs), "key", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB SQL."""
    template_rows = ", ".join("('%s', [%s])" % (label, ", ".join(f"'{w}'" for w in word_set(text))) for label, text in TEMPLATES)
    marks = {" " + p.replace(" ", "  ") + " ": (label, len(p.split())) for p, label in PHRASES.items()}
    n = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    counts = " + ".join(f"(length(w) - length(replace(w, '{m}', ''))) // {len(m)}" for m in marks)
    firsts = ", ".join(f"CASE WHEN contains(w, '{m}') THEN {n(f'''split_part(w, '{m}', 1)''')} END" for m in marks)
    lasts = ", ".join(f"CASE WHEN contains(w, '{m}') THEN n_words - {n(f'''split_part(w, '{m}', -1)''')} - {k} END" for m, (_, k) in marks.items())
    labels = ", ".join(f"CASE WHEN contains(w, '{m}') THEN '{label}' END" for m, (label, _) in marks.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    separators = SEPARATORS
    return f"""
WITH w AS (SELECT doc_id, ' ' || trim(regexp_replace({lower}, '{separators}', '  ', 'g')) || ' ' w FROM documents),
b AS (SELECT *, CASE WHEN w = '  ' THEN 0 ELSE {n('w')} END n_words FROM w),
t AS (SELECT * FROM (VALUES {template_rows}) v(label, words)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array({lower}, '{separators}'), lambda x: x <> '') ws FROM documents),
e AS (SELECT DISTINCT doc_id FROM d JOIN t ON 100 * len(list_intersect(ws, words)) >= {PERCENT} * len(words)),
l AS (
  SELECT DISTINCT doc_id, list_distinct(list_slice(ws, i, i + {RUN_WORDS - 1})) ws
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) i FROM d SEMI JOIN e USING (doc_id))),
m AS (
  SELECT doc_id, label, len(list_intersect(ws, words)) / len(words) AS share FROM l JOIN t
  ON 100 * len(list_intersect(ws, words)) >= {PERCENT} * len(words)),
f AS (SELECT doc_id, list(DISTINCT label) found, max(share) share FROM m GROUP BY doc_id),
p AS (
  SELECT doc_id, n_words, {counts} n_base, least({firsts}) first_word, greatest({lasts}) last_word,
    list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL))) base
  FROM b)
SELECT doc_id, n_words::BIGINT n_words, n_base::BIGINT n_base, first_word::BIGINT first_word, last_word::BIGINT last_word,
  array_to_string(base, ',') base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END score
FROM p LEFT JOIN f USING (doc_id)
"""
