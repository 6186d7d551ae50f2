"""Descriptions and code as bags of words and grams."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, functions as F

from sevfold.functions.code import let

# Operators before words, longer operators where they come first.
CODE_OPERATORS = (
    "<=", ">=", "<", ">", "?", "/=", "+=", "-=", "++", "--", "*=", "+", "-", "*", "/", "!=", "==", "=", "!", "&=", "&", "%", "||", "|=", "|", "$", ":",
)
CODE_WORD = "[a-zA-Z0-9]+"
CODE_TOKEN = "|".join(re.escape(op) for op in CODE_OPERATORS) + "|" + CODE_WORD

# Fixed value: a description token holds a letter that something follows.
DESC_TOKEN = r"[a-z]\S"
EXTRA_STOP_WORD = "aka"

# The English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren aren't
couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma
mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren
weren't won won't wouldn wouldn't
""".split()

# Words keep inner marks (``buffer-overflow``, ``1.2``); clitics and marks stand alone. The
# possessive repetition keeps the match of a very long word iterative.
CLITIC = r"(n't|'(?:s|re|ve|ll|d|m))\b"
WORD_TOKEN = r"n't|'(?:s|re|ve|ll|d|m)\b|\.\.\.|--|[^\s\p{P}\p{S}]+(?:[-.'/_][^\s\p{P}\p{S}]+)*+|[\p{P}\p{S}]"


def head_words(c: Column, n: int) -> Column:
    """First ``n`` words, words being what single blanks separate."""
    return F.substring_index(c, " ", n)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def code_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CODE_TOKEN), F.lit(0))


def desc_tokens(c: Column) -> Column:
    """Runs between blanks that hold a letter with something behind it; linear in the text."""
    words = F.split(F.lower(c), r"\s+")
    return F.filter(words, lambda w: w.rlike(DESC_TOKEN) & (w != EXTRA_STOP_WORD))


def description_words(c: Column) -> Column:
    """Lower-case word tokens without stop words and punctuation.

    A token counts as punctuation when it is a run within the ASCII punctuation string.
    """
    spaced = F.regexp_replace(F.lower(c), CLITIC, " $1")
    words = F.regexp_extract_all(spaced, F.lit(WORD_TOKEN), F.lit(0))
    stop = F.array(*[F.lit(w) for w in [*STOP_WORDS, EXTRA_STOP_WORD]])
    kept = F.filter(words, lambda w: F.instr(F.lit(string.punctuation), w) == 0)
    return F.filter(kept, lambda w: ~F.array_contains(stop, w))


def ngrams(words: Column, lo: int, hi: int) -> Column:
    """Word grams of ``lo`` to ``hi`` words, joined by a blank."""

    def of_size(w: Column, n: int) -> Column:
        if n == 1:
            return w
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.expr("cast(array() as array<int>)"))
        # Words by their place: a slice would copy the whole list for each gram.
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))

    return let(words, lambda w: F.concat(*[of_size(w, n) for n in range(lo, hi + 1)]))


def plain_text(c: Column) -> Column:
    """Lower case, with runs of white space as one blank: what character grams are cut from."""
    return F.regexp_replace(F.lower(c), r"(?U)\s\s+", " ")


def char_ngrams(c: Column, lo: int, hi: int) -> Column:
    """Overlapping grams of ``lo`` to ``hi`` characters of the lower-cased text.

    One look-ahead scan per gram length, character by character, so the cost is linear in the
    text; runs of two or more white-space characters count as one blank.
    """

    def of_size(t: Column, n: int) -> Column:
        return F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))

    return let(plain_text(c), lambda t: F.concat(*[of_size(t, n) for n in range(lo, hi + 1)]))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_usable_gram(gram: Column) -> Column:
    """A gram that is one token of two or more characters once stripped."""
    return gram.rlike(r"(?U)^\s*\S{2,}\s*$")


def usable_grams(grams: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.array_distinct(grams), is_usable_gram), strip))  # each gram is judged once


def term_counts(terms: Column) -> Column:
    """Distinct terms of one array with their counts, as ``array<struct<term, tf>>``.

    Sorting the array makes equal terms neighbours, so the count per document needs no
    shuffle: only vocabularies are aggregated across rows.
    """
    empty = F.expr("cast(array() as array<int>)")

    def with_sorted(s: Column) -> Column:
        positions = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(empty)
        starts = F.filter(positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(terms), with_sorted)


def parse_vector(c: Column) -> Column:
    """``"[0.1, 0.2]"`` as an array of doubles."""
    return F.from_json(c, "array<double>")
