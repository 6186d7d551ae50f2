"""Terms looked up inside the row: counts, weights and vectors over a vocabulary that every task holds.

A vocabulary that fits goes to the tasks once, as sorted terms with their weights; a task counts the
terms of a batch of rows with it and shuffles nothing. ``fits`` measures it first: callers join terms
by their text beyond that. Character grams are compared by 64-bit hashes, so that only grams that may
be in the vocabulary are ever spelt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from sevfold.sources.paths import ensure_checkpoint_dir

MAX_BYTES = 64 << 20
PIECE = 1 << 20
#: Rows and bytes of an Arrow batch of terms, texts or vectors: they bound what a task holds on both sides of a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

# White space of Unicode.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


@dataclass
class Vocabulary:
    """Terms in alphabetical order, and a weight of each (none: counts are the weights)."""

    terms: pa.Array
    weights: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.terms)


def small_batches(df: DataFrame) -> None:
    """Have the session send at most ``BATCH_ROWS`` rows, or about ``BATCH_BYTES``, to Python at once; a lower number of rows stays."""
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    spark.conf.set(_BYTES, f"{BATCH_BYTES}b")


def fits(vocab: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, bool]:
    """The vocabulary, checkpointed, and whether its terms fit in ``max_bytes`` with 16 bytes more for each."""
    ensure_checkpoint_dir(vocab.sparkSession)
    kept = vocab.checkpoint()
    return kept, (kept.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) <= max_bytes


def gathered(vocab: DataFrame, weight: str | None = None) -> Vocabulary:
    """A vocabulary that fits, on the driver."""
    table = vocab.select("term", *([weight] if weight else [])).toArrow().sort_by("term")
    terms = table["term"].combine_chunks().cast(pa.string())
    return Vocabulary(terms, table[weight].to_numpy() if weight else None)


def _counts(row: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and counts of equal pairs, in order."""
    key, n = np.unique(row.astype(np.int64) * max(size, 1) + place, return_counts=True)
    return key // max(size, 1), key % max(size, 1), n


def _weighed(row: np.ndarray, place: np.ndarray, n: np.ndarray, weights: np.ndarray | None, rows: int) -> np.ndarray:
    if weights is None:
        return n.astype(np.float64)
    w = n * weights[place]
    return w / np.sqrt(np.bincount(row, w * w, minlength=rows))[row]


def _lists(row: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _vectors(row: np.ndarray, place: np.ndarray, w: np.ndarray, size: int, rows: int) -> pa.StructArray:
    parts = [pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, size, np.int32)), _lists(row, pa.array(place.astype(np.int32)), rows), _lists(row, pa.array(w), rows)]
    return pa.StructArray.from_arrays(parts, fields=list(_VECTOR))


def _term_rows(batch: pa.RecordBatch, column: str, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the known terms of each row of an array column."""
    lists = batch.column(column)
    place = pc.index_in(lists.flatten(), value_set=known)
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    found = place.is_valid().to_numpy(zero_copy_only=False)
    return _counts(row[found], place.drop_null().to_numpy(), len(known))


def known_terms(df: DataFrame, doc: str, terms: Column, vocab: Vocabulary) -> DataFrame:
    """``doc, term, tf, weight`` of the terms of each row that the vocabulary holds.

    Weights are counts, or counts times the weight of the term, scaled to rows of length 1.
    """
    small_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = shared.value
        for batch in batches:
            row, place, n = _term_rows(batch, "terms", known.terms)
            w = _weighed(row, place, n, known.weights, len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), known.terms.take(pa.array(place)), pa.array(n.astype(np.int32)), pa.array(w)], names=[doc, "term", "tf", "weight"]
            )

    read = df.select(doc, terms.alias("terms"))
    schema = StructType([read.schema[doc], StructField("term", StringType()), StructField("tf", IntegerType()), StructField("weight", DoubleType())])
    return read.mapInArrow(run, schema)


def term_vectors(df: DataFrame, keep: list[str], blocks: list[tuple[Column, Vocabulary]], out: str = "features") -> DataFrame:
    """Columns ``keep`` and a sparse vector: the terms of each block over its vocabulary, side by side."""
    small_batches(df)
    shared = df.sparkSession.sparkContext.broadcast([v for _, v in blocks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, size = len(batch), [], 0
            for i, known in enumerate(shared.value):
                row, place, n = _term_rows(batch, f"__terms{i}", known.terms)
                parts.append((row, place + size, _weighed(row, place, n, known.weights, rows)))
                size += len(known)
            row, place, w = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(row, kind="stable")
            vector = _vectors(row[order], place[order], w[order], size, rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], vector], names=[*keep, out])

    read = df.select(*keep, *[c.alias(f"__terms{i}") for i, (c, _) in enumerate(blocks)])
    schema = StructType([*[read.schema[c] for c in keep], StructField(out, VectorUDT())])
    return read.mapInArrow(run, schema)


def term_places(df: DataFrame, terms: Column, vocab: Vocabulary) -> DataFrame:
    """All columns, and ``place`` and ``tf``: places of the known terms of each row in the vocabulary, in order, with their counts."""
    small_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(vocab.terms)
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            row, place, n = _term_rows(batch, "__terms", known)
            lists = [_lists(row, pa.array(x.astype(np.int32)), len(batch)) for x in (place, n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *lists], names=[*keep, "place", "tf"])

    schema = StructType([*df.schema, StructField("place", ArrayType(IntegerType())), StructField("tf", ArrayType(IntegerType()))])
    return df.select(*keep, terms.alias("__terms")).mapInArrow(run, schema)


def place_vectors(rows: DataFrame, size: int, weights: np.ndarray | None, out: str = "features") -> DataFrame:
    """Rows of ``term_places`` with a vector of the places below ``size``: counts, or counts times weights at length 1."""
    small_batches(rows)
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    keep = [c for c in rows.columns if c not in ("place", "tf")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("place")
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            place, n = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
            front = place < size
            row, place = row[front], place[front]
            w = _weighed(row, place, n[front], shared.value, len(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], _vectors(row, place, w, size, len(batch))], names=[*keep, out])

    schema = StructType([*[rows.schema[c] for c in keep], StructField(out, VectorUDT())])
    return rows.mapInArrow(run, schema)


# Character grams -------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class _Points:
    """Code points of some rows; ``ends`` is the end of the row that a point belongs to."""

    lo: int
    hi: int
    points: np.ndarray
    row: np.ndarray
    ends: np.ndarray
    white: np.ndarray  # white characters before each point
    hashes: list[np.ndarray]  # of the windows of 1, 2, ... points that begin there


def _pieces(column: pa.Array, longest: int) -> Iterator[_Points]:
    """Rows in runs of about ``PIECE`` bytes. A null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    sizes = pc.binary_length(column).to_numpy()
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(column):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, side="right")), lo + 1)
        part = column.slice(lo, hi - lo)
        lengths = pc.utf8_length(part).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
        last = np.cumsum(lengths)
        row = np.repeat(np.arange(hi - lo), lengths)
        white = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(np.isin(points, WHITE), out=white[1:])
        single = _mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        hashes = [single]
        for n in range(2, longest + 1):
            if len(points) >= n:
                hashes.append(hashes[-1][: len(points) - n + 1] * np.uint64(0x2545F4914F6CDD1D) + single[n - 1 :])
            else:
                hashes.append(np.empty(0, np.uint64))
        hashes = [_mix(h ^ np.uint64(i + 1)) if i else h for i, h in enumerate(hashes)]
        yield _Points(lo, hi, points, row, last[row] if len(row) else row, white, hashes)
        lo = hi


def _document_frequency(lo: int, hi: int):
    """Kernel: ``gram, term, df`` of windows of ``lo`` to ``hi`` points that are one token once stripped of white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in _pieces(batch.column(0), hi):
                found, cores, dfs = [], [], []
                for n in range(lo, hi + 1):
                    at = np.arange(max(len(p.points) - n + 1, 0))
                    at = at[at + n <= p.ends[at]]
                    before = p.white[at + 1] - p.white[at]
                    after = p.white[at + n] - p.white[at + n - 1]
                    size = n - before - after
                    usable = (p.white[at + n] - p.white[at] == before + after) & (size >= 2)
                    at, before, size = at[usable], before[usable], size[usable]
                    core = np.empty(len(at), dtype=np.uint64)
                    for m in range(max(n - 2, 2), n + 1):
                        these = size == m
                        core[these] = p.hashes[m - 1][at[these] + before[these]]
                    gram = p.hashes[n - 1][at]
                    order = np.argsort(gram, kind="stable")  # rows stay in order within a gram
                    gram, row = gram[order], p.row[at][order]
                    first = np.ones(len(gram), dtype=bool)
                    first[1:] = gram[1:] != gram[:-1]
                    once = first.copy()
                    once[1:] |= row[1:] != row[:-1]
                    begin = np.flatnonzero(first)
                    found.append(gram[begin])
                    cores.append(core[order[begin]])
                    dfs.append(np.add.reduceat(once, begin, dtype=np.int64) if len(begin) else np.empty(0, np.int64))
                gram, term, df = (np.concatenate(x) for x in (found, cores, dfs))
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(term.view(np.int64)), pa.array(df)], names=["gram", "term", "df"])

    return run


def _matches(p: _Points, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``n`` points without white space begin whose hash is known, and its place."""
    at = np.arange(max(len(p.points) - n + 1, 0))
    at = at[(at + n <= p.ends[at]) & (p.white[at + n] == p.white[at])]
    place = np.searchsorted(known, p.hashes[n - 1][at])
    ok = known[np.minimum(place, len(known) - 1)] == p.hashes[n - 1][at]
    return at[ok], place[ok]


def _spelt(shared, lo: int, hi: int):
    """Kernel: ``hash, term`` of the known windows of ``lo`` to ``hi`` points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for p in _pieces(batch.column(0), hi):
                places, texts = [], []
                for n in range(lo, hi + 1):
                    at, place = _matches(p, known, n)
                    place, first = np.unique(place, return_index=True)
                    windows = p.points[at[first][:, None] + np.arange(n)] if len(first) else np.empty((0, n), np.uint32)
                    raw = windows.astype("<u4").tobytes()
                    texts += [raw[4 * n * i : 4 * n * (i + 1)].decode("utf-32-le") for i in range(len(first))]
                    places.append(place)
                yield pa.RecordBatch.from_arrays([pa.array(known[np.concatenate(places)].view(np.int64)), pa.array(texts, pa.string())], names=["hash", "term"])

    return run


@dataclass
class Grams:
    """Hashes of gram terms in order, and the alphabetical place of each among ``terms``."""

    hashes: np.ndarray
    place: np.ndarray
    terms: pa.Array


def frequent_grams(texts: DataFrame, min_df: int, lo: int, hi: int) -> DataFrame:
    """``hash`` of the terms of frequent grams: windows of ``lo`` to ``hi`` characters in ``min_df`` texts, one token each, stripped.

    ``texts`` has one column. A task sends one row for each gram of about 1 MB of texts.
    """
    small_batches(texts)
    counted = texts.mapInArrow(_document_frequency(lo, hi), "gram long, term long, df long")
    often = counted.groupBy("gram").agg(F.sum("df").alias("df"), F.min("term").alias("term")).filter(F.col("df") >= min_df)
    return often.select(F.col("term").alias("hash")).distinct()


def spelt_grams(texts: DataFrame, hashes: DataFrame, lo: int, hi: int, max_bytes: int = MAX_BYTES) -> DataFrame | None:
    """``hash, term`` of chosen hashes, found in the texts once more; None if they do not fit in ``max_bytes``."""
    small_batches(texts)
    ensure_checkpoint_dir(texts.sparkSession)
    kept = hashes.checkpoint()
    if kept.count() * 8 > max_bytes:
        return None
    known = np.sort(kept.toArrow()["hash"].to_numpy().view(np.uint64))
    if not len(known):
        return kept.select("hash", F.lit("").alias("term"))
    shared = texts.sparkSession.sparkContext.broadcast(known)
    found = texts.mapInArrow(_spelt(shared, lo, hi), "hash long, term string")
    return found.groupBy("hash").agg(F.min("term").alias("term"))


def gathered_grams(spelt: DataFrame) -> Grams:
    """Spelt grams that fit, on the driver."""
    table = spelt.select("hash", "term").toArrow().sort_by("term")
    hashes = table["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Grams(hashes[order], order, table["term"].combine_chunks().cast(pa.string()))


def _gram_counts(p: _Points, grams: Grams, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(grams.hashes):
        for n in range(lo, hi + 1):
            at, place = _matches(p, grams.hashes, n)
            rows.append(p.row[at])
            places.append(grams.place[place])
    return _counts(np.concatenate(rows), np.concatenate(places), len(grams.terms))


def known_grams(df: DataFrame, doc: str, text: Column, grams: Grams, lo: int, hi: int) -> DataFrame:
    """``doc, term, tf``: how often each gram term stands in a text, white space not crossed."""
    small_batches(df)
    shared = df.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Grams = shared.value
        for batch in batches:
            for p in _pieces(batch.column("__text"), hi):
                row, place, n = _gram_counts(p, known, lo, hi)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + p.lo)), known.terms.take(pa.array(place)), pa.array(n.astype(np.int32))], names=[doc, "term", "tf"])

    read = df.select(doc, text.alias("__text"))
    schema = StructType([read.schema[doc], StructField("term", StringType()), StructField("tf", IntegerType())])
    return read.mapInArrow(run, schema)


def gram_vectors(df: DataFrame, keep: list[str], terms: Column, vocab: Vocabulary, text: Column, grams: Grams, lo: int, hi: int, out: str = "features") -> DataFrame:
    """Columns ``keep`` and a sparse vector: counts of ``terms`` over ``vocab``, then counts of gram terms."""
    small_batches(df)
    shared = df.sparkSession.sparkContext.broadcast((vocab, grams))
    size = len(vocab) + len(grams.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value
        for batch in batches:
            for p in _pieces(batch.column("__text"), hi):
                here = batch.slice(p.lo, p.hi - p.lo)
                parts = [_term_rows(here, "__terms", words.terms)]
                row, place, n = _gram_counts(p, known, lo, hi)
                parts.append((row, place + len(words), n))
                row, place, n = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(row, kind="stable")
                vector = _vectors(row[order], place[order], n[order].astype(np.float64), size, len(here))
                yield pa.RecordBatch.from_arrays([*[here.column(c) for c in keep], vector], names=[*keep, out])

    read = df.select(*keep, terms.alias("__terms"), text.alias("__text"))
    schema = StructType([*[read.schema[c] for c in keep], StructField(out, VectorUDT())])
    return read.mapInArrow(run, schema)
