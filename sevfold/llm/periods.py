"""Periodic runs of words, caught online by dyadic square catchers.

Words are appended to a stream. For every power of two ``L`` the stream falls into blocks of ``L``
words, and each completed block is a catcher: the suffixes that begin ``L`` to ``2 L - 1`` words
after it are compared with it as appended words complete them. An equal suffix at distance ``d``
is a square of period ``d`` about the block if it extends, to the left over words that are there
and to the right with every word that is appended. Squares of a period that overlap are one run.
A stretch of words that agree with those ``d`` further on is ``2 L`` words long at least in a run
of three periods, so it holds a whole block of its level; shorter periods are caught by the lowest
level, whose block fits the shortest run. Words may be appended one by one or by the million:
comparisons are made on arrays, with the same result.

Windows of a level are hashed from two windows of the level below; extensions compare ranges by
prefix hashes in about ``log n`` steps, and every reported run is compared word by word afterwards.
A block that lies in a known run whose period divides the distance is not extended again, so a text
of one repeated word costs no more than others, ``n log n`` in all.

A task reads texts as one stream of about 1 MB, with a word of its own after each text, so no square
crosses texts; a longer text is a stream of its own. Nothing is shuffled.

Cases. A null or empty text has no words and no runs, and its collapsed text is empty. Rows that
repeat, null ids and extra columns: each row is worked out alone. Words are bytes between white
space, so case and marks count. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sevfold.functions.code import let
from sevfold.llm import textkernel as K
from sevfold.llm.tables import small_batches

LEAST, POWER = 24, 3
CELLS = 1 << 22
SPACE = r"[\x20\x09-\x0D]+"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Level:
    """Hashes of all windows of ``size`` words that are still needed, and the next block to compare."""

    def __init__(self, size: int):
        self.size, self.base, self.block = size, 0, 0
        self.values = np.empty(0, dtype=np.uint64)
        self.factor = K.mix(np.array([size + 0x51ED270B], dtype=np.uint64))[0] | np.uint64(1)

    def end(self) -> int:
        return self.base + len(self.values)

    def extend(self, new: np.ndarray) -> None:
        self.values = np.concatenate([self.values, new])

    def trim(self, keep_from: int) -> None:
        if keep_from > self.base:
            self.values, self.base = self.values[keep_from - self.base :].copy(), keep_from


class SquareCatchers:
    """Runs of period ``p`` and at least ``max(least, power * p)`` words in a stream; ``power`` is 3 or more.

    ``max_period`` spares levels that cannot matter. ``finish`` gives ``start, length, period`` rows in order.
    """

    def __init__(self, least: int = LEAST, power: int = POWER, max_period: int | None = None):
        if power < 3 or least < 1:
            raise ValueError("runs have three periods and a word at least")
        self.least, self.power, self.max_period = least, power, max_period
        self.lowest = 1
        while 3 * (2 * self.lowest) <= least + 2:
            self.lowest *= 2
        self.words = np.empty(0, dtype=np.uint64)
        self.sums = np.zeros(1, dtype=np.uint64)
        self.levels = [_Level(1)]
        self.open = np.empty((0, 3), dtype=np.int64)  # start, end, period of squares that reach the last word
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) -> period
        self._cover: tuple[np.ndarray, ...] | None = None

    def append(self, words: np.ndarray) -> None:
        """Add words (64-bit hashes) at the end of the stream."""
        if not len(words):
            return
        before = len(self.words)
        up, _ = K._POWERS.upto(before + len(words))
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(words * up[before:])])
        self.words = np.concatenate([self.words, words])
        if len(self.open):
            start, end, period = self.open.T
            self._settle(start, end + self._right(end - period, period), period)
        k = 0
        fresh = words
        while True:
            level = self.levels[k]
            level.extend(fresh)
            size = level.size
            if len(self.words) >= 2 * size and (self.max_period is None or 2 * size <= self.max_period or size < self.lowest):
                if k + 1 == len(self.levels):
                    self.levels.append(_Level(2 * size))
                above = self.levels[k + 1]
                at = above.end() - level.base
                count = max(level.end() - size - above.end(), 0)
                fresh = level.values[at : at + count] + above.factor * level.values[at + size : at + size + count]
                more = True
            else:
                more = False
            if size >= self.lowest:
                self._compare(level)
            if more:
                keep = self.levels[k + 1].end() + len(fresh)
                level.trim(min(keep, level.block * size) if size >= self.lowest else keep)
                k += 1
            else:
                break

    def finish(self) -> np.ndarray:
        """Close the stream."""
        for level in self.levels:
            if level.size >= self.lowest:
                self._compare(level, last=True)
        for start, end, period in self.open[np.argsort(self.open[:, 2])].tolist():
            if (start, end) not in self.runs:
                self._record(start, end, period)
        self.open = self.open[:0]
        rows = [(s, e - s, p) for (s, e), p in self.runs.items()]
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)

    def _distances(self, size: int) -> tuple[int, int]:
        return (1 if size == self.lowest else size), 2 * size

    def _compare(self, level: _Level, last: bool = False) -> None:
        """Compare completed blocks with the suffixes at their distances; at the end also with those that are there."""
        size = level.size
        lo, hi = self._distances(size)
        n = len(self.words)
        whole = (n - (hi - 1) - size) // size + 1 if n >= hi - 1 + size else 0
        step = max(CELLS // (hi - lo), 1)
        while level.block < whole:
            count = min(whole - level.block, step)
            first = level.block * size - level.base
            span = level.values[first : first + count * size + hi - 1]
            suffixes = np.lib.stride_tricks.sliding_window_view(span[lo:], hi - lo)[::size][:count]
            equal = suffixes == span[: count * size : size][:, None]
            begins = equal.copy()
            begins[1:] &= ~equal[:-1]
            block, distance = np.nonzero(begins)
            self._catch((block + level.block) * size, distance + lo, size)
            level.block += count
        if last:
            while level.block * size + lo + size <= n:
                first = level.block * size - level.base
                suffixes = level.values[first + lo : first + hi]
                distance = np.flatnonzero(suffixes == level.values[first]) + lo
                self._catch(np.full(len(distance), level.block * size), distance, size)
                level.block += 1

    def _catch(self, at: np.ndarray, period: np.ndarray, size: int) -> None:
        if not len(at):
            return
        if self.runs or len(self.open):
            if self._cover is None:
                known = np.array(sorted([(s, e, p) for (s, e), p in self.runs.items()] + [tuple(r) for r in self.open.tolist()]))
                reach = np.maximum.accumulate(known[:, 1])
                lead = np.maximum.accumulate(np.where(known[:, 1] == reach, np.arange(len(known)), 0))
                self._cover = (known, lead)
            known, lead = self._cover
            place = np.searchsorted(known[:, 0], at, side="right") - 1
            run = known[lead[np.maximum(place, 0)]]
            inside = (place >= 0) & (run[:, 1] >= at + period + size) & (period % run[:, 2] == 0)
            at, period = at[~inside], period[~inside]
        if len(at):
            self._settle(at - self._left(at, period), at + period + self._right(at, period), period)

    def _settle(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """Squares that reach the last word stay open; of the others those long enough are runs."""
        opened = end == len(self.words)
        if opened.any() or len(self.open):
            self._cover = None
        kept = self.open[self.open[:, 1] == len(self.words)] if len(self.open) else self.open
        squares = np.stack([start, end, period], axis=1)
        self.open = np.unique(np.concatenate([kept, squares[opened]]), axis=0)
        length = end - start
        for row in np.unique(squares[~opened & (length >= np.maximum(self.least, self.power * period))], axis=0).tolist():
            self._record(*row)

    def _record(self, start: int, end: int, period: int) -> None:
        wrong = np.flatnonzero(self.words[start : end - period] != self.words[start + period : end])
        edges = [-1, *wrong.tolist(), end - period - start]
        for a, b in zip(edges[:-1], edges[1:]):
            s, e = start + a + 1, start + b + period
            if e - s >= max(self.least, self.power * period):
                self.runs[s, e] = min(self.runs.get((s, e), period), period)
                self._cover = None

    def _same(self, a: np.ndarray, b: np.ndarray, length) -> np.ndarray:
        _, down = K._POWERS.upto(len(self.words) + 1)
        return (self.sums[a + length] - self.sums[a]) * down[a] == (self.sums[b + length] - self.sums[b]) * down[b]

    def _right(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Words from ``at`` on that agree with those ``period`` further."""
        room = len(self.words) - at - period
        out = np.zeros(len(at), dtype=np.int64)
        step = 1 << int(room.max(initial=0)).bit_length()
        while step:
            ok = np.flatnonzero(out + step <= room)
            a = at[ok] + out[ok]
            out[ok] += np.where(self._same(a, a + period[ok], step), step, 0)
            step >>= 1
        return out

    def _left(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Words before ``at`` that agree with those ``period`` further."""
        out = np.zeros(len(at), dtype=np.int64)
        step = 1 << int(at.max(initial=0)).bit_length()
        while step:
            ok = np.flatnonzero(out + step <= at)
            a = at[ok] - out[ok] - step
            out[ok] += np.where(self._same(a, a + period[ok], step), step, 0)
            step >>= 1
        return out


def _finder(least: int, power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch.column("text")):
                w = K.words(piece, K.NOT_SPACE, fold=lambda data: data)
                rows, sizes = piece.hi - piece.lo, np.diff(w.first)
                begin = w.first[:-1] + np.arange(rows)  # where each text begins in the stream
                stream = np.empty(len(w.hashes) + rows, dtype=np.uint64)
                ends = begin + sizes
                stream[ends] = K.mix(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
                inner = np.ones(len(stream), dtype=bool)
                inner[ends] = False
                stream[inner] = w.hashes
                catchers = SquareCatchers(least, power, max_period=int(sizes.max(initial=0)) // power)
                catchers.append(stream)
                runs = catchers.finish()
                row = np.searchsorted(begin, runs[:, 0], side="right") - 1
                steps = np.zeros(len(stream) + 1, dtype=np.int64)
                np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
                np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(steps[:-1]) == 0
                texts = []
                for i in range(rows):
                    words = piece.data[piece.offsets[i] : piece.offsets[i + 1]].tobytes().split()
                    mine = kept[begin[i] : ends[i]]
                    texts.append(b" ".join(words if mine.all() else [words[j] for j in np.flatnonzero(mine)]))
                offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(runs[:, 0] - begin[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[piece.lo : piece.hi], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each text.

    ``runs`` holds ``start, length, period`` in words, by start, then period: longest stretches of smallest
    period ``period`` with at least ``max(least, power * period)`` words. ``collapsed`` is the text with one
    period left of each run, its words joined by one space.
    """
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return read.mapInArrow(_finder(least, power), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where a tenth of the texts, chosen by the crc32 of the id, ends in copies of some of its words.

    With ``h`` that crc32 (of the empty text for a null id) and ``g = h div 10``, a text of ``n`` words with
    ``h % 10 = 0`` has word ``a + (i - a) % p`` at each ``i >= a``, where ``a = g % n`` and ``p = 1 + (n - a) div (3 + g % 8)``.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.expr("__h div 10")

    def planted(b: Column) -> Column:
        words, a, p, n = b["words"], b["a"], b["p"], b["n"]
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    def placed(b: Column) -> Column:
        a = b["g"] % b["n"]
        return F.struct(b["words"].alias("words"), b["n"].alias("n"), a.alias("a"), (F.floor((b["n"] - a) / (3 + b["g"] % 8)) + 1).alias("p"))

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    found = let(words, lambda w: F.struct(w.alias("words"), F.size(w).cast("long").alias("n"), g.alias("g")))
    changed = let(found, lambda b: F.when(b["n"] > 0, let(placed(b), planted)).otherwise(F.lit("")))
    text = F.when((F.col("__h") % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("__h")).select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` as counts, the run of greatest exponent and digests of runs and collapsed text."""
    higher = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    written = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.select("*", F.aggregate("runs", none, higher).alias("__best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "__best.start", "__best.length", "__best.period",
        F.expr("(1000 * __best.length) div __best.period").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
