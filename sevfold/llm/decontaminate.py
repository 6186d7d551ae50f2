"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over neighbouring words: it hashes the words at its marked positions and
ignores the others, so one replaced word does not break every seed around it. Every document and
every benchmark item is hashed under each mask at every position. Equal hashes are hits; each
hit fixes a diagonal of document and item, on which whole words are compared. A run on it is an
overlap if it begins and ends with equal words, has at least ``min_words`` of them, and if
``percent`` of its words are equal. All runs that lie in no longer one are reported; two of them
may share words where both together fall below ``percent``.

Work. The benchmark is a stated query set. It is read in blocks of at most ``BLOCK_WORDS`` words
(longer items are cut in overlapping parts), chosen by running sums of the item sizes; each block
is one broadcast of bounded size and one pass over all documents, whole, without any shuffle of
documents. Overlaps are the only rows that leave a task.

Cases. Words are runs of letters and digits, without case. A null or empty text has none. Items
of fewer than ``min_words`` words are too short to tell and match nothing. Items with equal texts
are all reported. A null id is reported as null. Rows that
repeat are reported each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sevfold.llm import textkernel as K
from sevfold.llm.tables import set_down, sized, small_batches

# The masks. A 1 marks a position that is hashed.
MASKS = ("11101101", "1101100111", "111000101011")
BLOCK_WORDS = 1 << 19
PART_WORDS = 1 << 12

OVERLAP = "doc_id long, item_id long, doc_start int, item_start int, n_words int, n_equal int"


def _offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id")
        for piece in K.pieces(batch.column("text")):
            w = K.words(piece, K.ALNUM)
            at, part, rows = [], [], []
            for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
                for start in range(0, max(1, int(b - a) - PART_WORDS // 2), PART_WORDS // 2):
                    at.append(piece.lo + i)
                    part.append(start)
                    rows.append(w.hashes[a + start : min(b, a + start + PART_WORDS)])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())).cast(pa.int64()), pa.array(part, pa.int32()), K.long_lists(rows)], names=["item_id", "part", "words"]
            )


class Block:
    """A block of benchmark items: their words end to end, and the seeds of each mask in order."""

    def __init__(self, ids: list, parts: list[int], rows: list[np.ndarray]):
        self.ids, self.parts = ids, np.array(parts, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.words = np.concatenate(rows) if rows else np.empty(0, dtype=np.uint64)
        self.seeds = []
        item = np.repeat(np.arange(len(rows)), np.diff(self.first))
        for mask in MASKS:
            h = K.window_hashes(self.words, len(mask), _offsets(mask))
            at = np.arange(len(h))
            inside = item[at] == item[at + len(mask) - 1] if len(h) else np.empty(0, dtype=bool)
            h, at = h[inside], at[inside]
            order = np.argsort(h, kind="stable")
            self.seeds.append((h[order], at[order]))
        self.item = item


def blocks(benchmark: DataFrame, min_words: int) -> Iterator[Block]:
    """Blocks of the benchmark, one at a time: no more than one is on the driver."""
    items = set_down(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .mapInArrow(_item_words, "item_id long, part int, words array<long>").filter(F.size("words") >= min_words),
        "items",
    )
    # Block numbers from sums over hash ranges: the window runs over at most 4096 rows.
    keyed = items.withColumn("h", F.pmod(F.xxhash64("item_id", "part", "words"), F.lit(4096)))
    sums = keyed.groupBy("h").agg(F.sum(F.size("words")).alias("n"), F.count("*").alias("c"))
    before = sums.withColumn("before", F.sum("n").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)))
    in_range = Window.partitionBy("h").orderBy("item_id", "part", "words").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("upto", F.sum(F.size("words")).over(in_range)).join(F.broadcast(before.select("h", "before")), "h")
    placed = set_down(
        placed.select("item_id", "part", "words", F.floor((F.coalesce("before", F.lit(0)) + F.col("upto")) / F.lit(BLOCK_WORDS)).cast("int").alias("block")),
        "blocks",
    )
    last = placed.agg(F.max("block")).first()[0]
    for b in range((last if last is not None else -1) + 1):
        rows = placed.filter(F.col("block") == b).orderBy("item_id", "part", "words").toArrow()
        if len(rows):
            yield Block(rows["item_id"].to_pylist(), rows["part"].to_pylist(), [r.values.to_numpy().view(np.uint64) for r in rows["words"]])


def runs(equal: np.ndarray, min_words: int, percent: int) -> np.ndarray:
    """Longest runs, as rows of start, end and equal words, of which ``percent`` and ``min_words`` are equal.

    With ``100 - percent`` points for equal words and ``-percent`` for others, these are runs of no
    negative sum. A start counts if the sum before it is lower than at all starts on its left.
    """
    at = np.flatnonzero(equal)
    if len(at) < max(min_words, 1):
        return np.empty((0, 3), dtype=np.int64)
    before = 100 * np.arange(len(at)) - percent * at  # sum before each equal word
    after = before + 100 - percent
    first = np.flatnonzero(np.concatenate([[True], before[1:] < np.minimum.accumulate(before)[:-1]]))
    best = np.maximum.accumulate(after[::-1])[::-1]
    last = np.searchsorted(-best, -before[first], side="right") - 1
    keep = np.concatenate([[True], last[1:] > last[:-1]]) & (last - first + 1 >= min_words)
    first, last = first[keep], last[keep]
    return np.stack([at[first], at[last] + 1, last - first + 1], axis=1)


def _hits(words: np.ndarray, row: np.ndarray, block: Block) -> np.ndarray:
    """Distinct (row, item, diagonal) of all seed hits, the diagonal in positions of the piece."""
    found = []
    for mask, (seeds, at) in zip(MASKS, block.seeds):
        h = K.window_hashes(words, len(mask), _offsets(mask))
        if not len(h) or not len(seeds):
            continue
        small = np.zeros(1 << 22, dtype=bool)
        small[(seeds >> np.uint64(42)).astype(np.int64)] = True
        pos = np.flatnonzero(small[(h >> np.uint64(42)).astype(np.int64)])
        pos = pos[row[pos] == row[pos + len(mask) - 1]]
        lo, hi = np.searchsorted(seeds, h[pos], side="left"), np.searchsorted(seeds, h[pos], side="right")
        n = hi - lo
        pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
        # Repeated seeds of the benchmark are walked in turns, so one turn holds a row per position.
        for turn in range(int(n.max()) if len(n) else 0):
            here = n > turn
            p, q = pos[here], at[lo[here] + turn]
            found.append(np.unique(np.stack([row[p], block.item[q], p - (q - block.first[block.item[q]])], axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), dtype=np.int64)


def _scanner(shared, min_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for piece in K.pieces(batch.column("text")):
                w = K.words(piece, K.ALNUM)
                out = []
                for r, item, diagonal in _hits(w.hashes, w.row_of(), block):
                    lo, hi = max(diagonal, w.first[r]), min(diagonal + block.first[item + 1] - block.first[item], w.first[r + 1])
                    other = block.first[item] + lo - diagonal
                    equal = w.hashes[lo:hi] == block.words[other : other + hi - lo]
                    for a, b, n_equal in runs(equal, min_words, percent):
                        out.append((piece.lo + r, block.ids[item], lo + a - w.first[r], block.parts[item] + lo - diagonal + a, b - a, n_equal))
                cols = list(zip(*out)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())).cast(pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(np.array(c, dtype=np.int32)) for c in cols[2:]]],
                    names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"],
                )

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, doc_start, item_start, n_words, n_equal``: one row per overlapping run that lies in no longer one.

    Positions count words from 0; ``n_words`` is the length of the run, ``n_equal`` its equal words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    found = None
    for block in blocks(benchmark, min_words):
        shared = spark.sparkContext.broadcast(block)
        part = texts.mapInArrow(_scanner(shared, min_words, percent), OVERLAP)
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], OVERLAP)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without an overlap with the benchmark.

    A text is known by its hash, not by its id, so rows with a null or a repeated id are judged each by its own text.
    """
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    hit = set_down(overlaps(keyed, benchmark).select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(sized(hit, 16), F.xxhash64(docs["text"]) == F.col("__leak"), "left_anti").select(docs.columns)
