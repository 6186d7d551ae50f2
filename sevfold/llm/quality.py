"""Quality of texts by weak supervision: rules vote or abstain, and their accuracies are estimated.

Each rule of ``RULES`` looks at whole-number counts of a text (``signals``) and votes good, bad or
not at all. No labels are read. Every text belongs to a class, good or bad, that nobody sees; a rule
that votes is right with one accuracy on good texts and another on bad ones, and its abstentions say
nothing. Expectation-maximisation estimates the share of good texts and the two accuracies of each
rule from the votes of all texts; then a text has a posterior probability of being good.

Texts are read once and whole. Votes are few: all texts with the same votes are one row of at most
3 ** rules, however large the corpus is, and only these rows reach the driver, where the estimation
runs. Posteriors are worked out by columns from the estimates, without a join.

Cases. A null or empty text has no words and counts of 0; all rules but that of the length abstain.
Rows that repeat count each. Without any text nothing is estimated and the result is empty. Null ids
and extra columns change nothing. Lines are split at line feeds only and compared as they are; words
are told apart by case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sevfold.llm import textkernel as K
from sevfold.llm.tables import set_down, small_batches

WINDOW = 5
ROUNDS = 100
#: Accuracies on good and bad texts, and the share of good ones, that the estimation starts from.
START_GOOD, START_BAD, START_SHARE = 0.95, 0.3, 0.8
THRESHOLD = 0.5

# Characters that count as symbols, and those that end a sentence.
SYMBOLS = "#*$%&|<>"
SENTENCE_ENDS = ".!?:;\"')"

#: Counts of a text. Marks are ASCII punctuation; ``n_double_marks`` are marks followed by the same mark.
SIGNALS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_ended_lines", "n_distinct", "n_no_letter", "n_marks", "n_double_marks", "n_upper", "n_lower",
)

#: Name of a rule, when it votes bad, when it votes good; SQL over the signals, in whole numbers.
RULES = (
    ("symbols", "10 * n_symbols > n_words", "n_symbols = 0 and n_words > 0"),
    ("marks", "20 * n_marks > 9 * n_words", "4 * n_marks <= n_words and n_words > 0"),
    ("double_marks", "5 * n_double_marks > n_words", "20 * n_double_marks <= n_words and n_words > 0"),
    ("words_without_letters", "5 * n_no_letter > n_words", "20 * n_no_letter <= n_words and n_words > 0"),
    ("upper_case", "2 * n_upper > n_upper + n_lower", "10 * n_upper <= n_upper + n_lower and n_upper + n_lower > 0"),
    ("repeated_words", "7 * n_repeat_words > n_words", "50 * n_repeat_words <= n_words and n_words >= 10"),
    ("repeated_lines", "4 * n_dup_lines > n_lines and n_lines >= 5", "n_dup_lines = 0 and n_lines >= 3"),
    ("distinct_words", "3 * n_distinct < n_words", "2 * n_distinct >= n_words and n_words >= 10"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars >= 3 * n_words and word_chars <= 9 * n_words and n_words > 0"),
    ("line_ends", "2 * n_ended_lines < n_lines and n_lines >= 2", "4 * n_ended_lines >= 3 * n_lines and n_lines > 0"),
    ("length", "n_words < 20", "n_words >= 50"),
)
#: Texts that fail whatever the rules say.
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"

_SYMBOL = K._table(lambda b: chr(b) in SYMBOLS)
_END = K._table(lambda b: chr(b) in SENTENCE_ENDS)
_MARK = K._table(lambda b: 0x21 <= b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7E)
_UPPER = K._table(lambda b: 0x41 <= b <= 0x5A)
_LOWER = K._table(lambda b: 0x61 <= b <= 0x7A)
_FIRST_BYTE = K._table(lambda b: not 0x80 <= b <= 0xBF)


def _by_row(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many flags are set between each two cuts."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[cuts[1:]] - sums[cuts[:-1]]


def _in_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return K.mix(hashes ^ K.mix(row.astype(np.uint64) + np.uint64(1)))


def _distinct(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    _, at = np.unique(_in_row(hashes, row), return_index=True)
    return np.bincount(row[at], minlength=rows)


def _signals(piece: K.Piece) -> list[np.ndarray]:
    data, rows = piece.data, piece.hi - piece.lo
    w = K.words(piece, K.NOT_SPACE, fold=lambda d: d)
    row = w.row_of()
    count = lambda table: _by_row(table[data], piece.offsets)

    repeated = np.zeros(len(row) + 1, dtype=np.int64)
    windows = K.window_hashes(w.hashes, WINDOW)
    at = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :]) if len(windows) else np.empty(0, dtype=np.int64)
    _, which, times = np.unique(_in_row(windows[at], row[at]), return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    np.add.at(repeated, twice, 1)
    np.add.at(repeated, twice + WINDOW, -1)

    edges = np.union1d(np.flatnonzero(data == 0x0A) + 1, piece.offsets)
    begin, end = edges[:-1], edges[1:]
    full = _by_row(K.NOT_SPACE[data], edges) > 0
    begin, end = begin[full], end[full]
    end = end - (data[end - 1] == 0x0A)
    line_row = np.searchsorted(piece.offsets, begin, side="right") - 1
    lines = np.bincount(line_row, minlength=rows)
    last = w.ends[np.searchsorted(w.ends, end, side="right") - 1] - 1

    letters = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(K.LETTER[data], out=letters[1:])
    same = _MARK[data]
    same[:-1] &= data[:-1] == data[1:]
    same[piece.offsets[1:][piece.offsets[1:] > 0] - 1] = False
    return [
        np.diff(w.first), _by_row(K.NOT_SPACE[data] & _FIRST_BYTE[data], piece.offsets), count(_SYMBOL),
        lines - _distinct(K.range_hashes(data, begin, end), line_row, rows), _by_row(np.cumsum(repeated[:-1]) > 0, w.first),
        lines, np.bincount(line_row[_END[data[last]]], minlength=rows), _distinct(w.hashes, row, rows),
        _by_row(letters[w.ends] == letters[w.starts], w.first), count(_MARK), _by_row(same, piece.offsets), count(_UPPER), count(_LOWER),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in K.pieces(batch.column("text")):
            found = [pa.array(c.astype(np.int64)) for c in _signals(piece)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[piece.lo : piece.hi], *found], names=["doc_id", *SIGNALS])


def signals(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``SIGNALS`` of each text."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} long" for s in SIGNALS))


def votes() -> list[Column]:
    """Vote of each rule: 1 good, -1 bad, 0 none."""
    return [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).alias(f"vote_{name}") for name, bad, good in RULES]


@dataclass
class Estimates:
    """Share of good texts, and how often a vote is right on good and on bad texts, by rule."""

    share: float
    good: np.ndarray
    bad: np.ndarray

    def log_odds(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of good before any vote, and what a good and a bad vote of each rule add."""
        return float(np.log(self.share / (1 - self.share))), np.log(self.good / (1 - self.bad)), np.log((1 - self.good) / self.bad)


def estimate(cast: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> Estimates:
    """Expectation-maximisation over rows of votes that ``times`` texts cast; counts are smoothed by one."""
    rules = cast.shape[1]
    now = Estimates(START_SHARE, np.full(rules, START_GOOD), np.full(rules, START_BAD))
    up, down = (cast == 1).astype(float), (cast == -1).astype(float)
    for _ in range(rounds):
        base, plus, minus = now.log_odds()
        good = times / (1 + np.exp(-(base + up @ plus + down @ minus)))
        bad = times - good
        now = Estimates(
            float((good.sum() + 1) / (times.sum() + 2)),
            (good @ up + 1) / (good @ (up + down) + 2),
            (bad @ down + 1) / (bad @ (up + down) + 2),
        )
    return now


def judged(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Estimates | None]:
    """Signals, votes and ``posterior`` of each text, and the estimates behind them (None without texts)."""
    names = [f"vote_{name}" for name, *_ in RULES]
    rows = set_down(signals(docs).select("*", *votes()), "votes")
    patterns = rows.groupBy(*names).agg(F.count("*").alias("times")).orderBy(*names).collect()  # at most 3 ** rules
    if not patterns:
        return rows.withColumn("posterior", F.lit(None).cast("double")), None
    table = np.array([tuple(p) for p in patterns], dtype=float)
    found = estimate(table[:, :-1], table[:, -1], rounds)
    base, plus, minus = found.log_odds()
    odds = F.lit(base)
    for name, g, b in zip(names, plus.tolist(), minus.tolist()):
        odds = odds + F.when(F.col(name) == 1, F.lit(g)).when(F.col(name) == -1, F.lit(b)).otherwise(F.lit(0.0))
    return rows.withColumn("posterior", 1 / (1 + F.exp(-odds))), found


def assess(docs: DataFrame) -> DataFrame:
    """Counts of each text, whether it fails outright, its posterior in millionths, and whether it is kept."""
    rows, _ = judged(docs)
    failed = F.expr(BASE_FAILED)
    return rows.select(
        "doc_id", *SIGNALS[:5], failed.alias("base_failed"), (~failed & (F.col("posterior") >= THRESHOLD)).alias("kept"),
        F.round(F.col("posterior") * 1_000_000).cast("long").alias("posterior_ppm"),
    )


def oracle() -> str:
    """The same in SQL: the estimation is a recursive query over the rows of equal votes."""
    rules = range(1, len(RULES) + 1)
    cast = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in RULES)
    odds = "ln(e.s / (1 - e.s))" + "".join(
        f" + CASE v[{j}] WHEN 1 THEN ln(e.g[{j}] / (1 - e.b[{j}])) WHEN -1 THEN ln((1 - e.g[{j}]) / e.b[{j}]) ELSE 0 END" for j in rules
    )
    good = ", ".join(f"(sum(CASE WHEN v[{j}] = 1 THEN p ELSE 0 END) + 1) / (sum(CASE WHEN v[{j}] <> 0 THEN p ELSE 0 END) + 2)" for j in rules)
    bad = ", ".join(f"(sum(CASE WHEN v[{j}] = -1 THEN c - p ELSE 0 END) + 1) / (sum(CASE WHEN v[{j}] <> 0 THEN c - p ELSE 0 END) + 2)" for j in rules)
    start = lambda x: f"[{', '.join([str(x)] * len(RULES))}]::DOUBLE[]"
    return rf"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, txt, list_filter(regexp_split_to_array(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
    list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
  FROM (SELECT doc_id, coalesce(text, '') txt FROM documents)),
x AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) n FROM (
    SELECT doc_id, unnest(range(1, len(ws) - 3)) i, ws[i] a, ws[i + 1] b, ws[i + 2] c, ws[i + 3] d, ws[i + 4] e FROM t)),
r AS (SELECT doc_id, count(DISTINCT k) n FROM (SELECT doc_id, unnest(range(i, i + 5)) k FROM x WHERE n > 1) GROUP BY doc_id),
s AS MATERIALIZED (
  SELECT t.doc_id, len(ws)::BIGINT n_words, length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g'))::BIGINT word_chars,
    length(regexp_replace(txt, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines,
    coalesce(r.n, 0)::BIGINT n_repeat_words, len(ls) n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;"'')][\x20\x09-\x0D]*$'))) n_ended_lines,
    len(list_distinct(ws)) n_distinct, len(list_filter(ws, lambda x: NOT regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) n_no_letter,
    length(regexp_replace(txt, '[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) n_marks,
    list_sum(list_transform(regexp_extract_all(txt, '{"|".join(f"[{chr(92)}x{m:02X}]{{2,}}" for m in range(0x21, 0x7F) if _MARK[m])}'), lambda x: length(x) - 1)) doubles,
    length(regexp_replace(txt, '[^A-Z]', '', 'g')) n_upper, length(regexp_replace(txt, '[^a-z]', '', 'g')) n_lower
  FROM t LEFT JOIN r USING (doc_id)),
v AS MATERIALIZED (SELECT *, coalesce(doubles, 0) n_double_marks, [{cast}] v FROM s),
p AS MATERIALIZED (SELECT v, count(*)::DOUBLE c FROM v GROUP BY v),
e AS (
  SELECT 0 r, {START_SHARE}::DOUBLE s, {start(START_GOOD)} g, {start(START_BAD)} b
  UNION ALL
  SELECT r + 1, (sum(p) + 1) / (sum(c) + 2), [{good}], [{bad}]
  FROM (SELECT e.r, v, c, c / (1 + exp(-({odds}))) p FROM e, p WHERE e.r < {ROUNDS}) GROUP BY r),
o AS (SELECT v, 1 / (1 + exp(-({odds}))) q FROM e, p WHERE r = {ROUNDS})
SELECT doc_id, {", ".join(SIGNALS[:5])}, ({BASE_FAILED}) base_failed, NOT ({BASE_FAILED}) AND q >= {THRESHOLD} kept, round(q * 1000000)::BIGINT posterior_ppm
FROM v JOIN o USING (v)
"""
