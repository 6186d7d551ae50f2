"""Repeated passages across documents by a sparse suffix array.

Of every run of ``window`` neighbouring word k-grams the one with the smallest hash is a
minimiser. Two texts that share ``min_words`` words in a row share such a run, and so select the
same position in it. Only suffixes that begin at minimisers are kept, and of these only those
whose k-gram is in more than one document. They are sorted; every suffix is compared with its
neighbours of other documents, to the right along both suffixes and then to the left of both
positions. Words that match over at least ``min_words`` in a row are a repeated passage.

A suffix carries ``min_words`` word hashes on each side. That is enough: any ``min_words`` words
of a longer passage hold a minimiser of their own, and their matches overlap. Each suffix is
compared with the ``NEAR`` rows before and after it, and with the nearest of another document,
in two orders: by the words to the right, and by its k-gram and then the words to the left. So it
meets the documents that agree with it longest on either side.

What a suffix does not meet is not lost: every run of ``min_words`` words whose minimiser repeats is
hashed. Runs that two documents hold are added to the spans, and the smallest id of each hash is the
owner of that run, which tells the document that comes first.

Scale. The sort is by ranges of suffix, left side and id, so a passage in a third of all
documents spreads over many tasks. Rows at the ends of ranges are compared afterwards; there are
``2 * EDGE`` per range. A bitmap of fixed size tells which k-grams repeat; where it is too full
it lets more rows pass and changes no result.

Cases. Words are runs of letters and digits, without case. Null, empty and short texts have no
passage. Passages within one document do not count, nor among rows of one id. Rows with a null id
take no part. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sevfold.llm import textkernel as K
from sevfold.llm.tables import set_down, small_batches

GRAM = 8
NEAR, EDGE = 3, 8
BITMAP = 1 << 26
_LOW = 24
SUFFIX = "doc_id long, pos int, right binary, left binary"
MATCH = "doc_id long, start int, end int, other long"


def minimisers(grams: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the valid runs of ``window`` grams, and for each the place of its leftmost smallest gram."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    low = np.uint64((1 << _LOW) - 1)
    key = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    padded = np.full(-(-len(key) // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])
    start = np.flatnonzero(valid[:n])
    return start, start + (((smallest[start] & low).astype(np.int64) - start) & int(low))


def _selected(piece: K.Piece, min_words: int):
    """Words of a piece, the row of each word, its windows and their minimisers, all gram hashes."""
    w = K.words(piece, K.ALNUM)
    row = w.row_of()
    grams = K.window_hashes(w.hashes, GRAM)
    window = min_words - GRAM + 1
    n = max(0, len(w.hashes) - min_words + 1)
    start, at = minimisers(grams, row[:n] == row[min_words - 1 : min_words - 1 + n], window)
    return w, row, start, at, grams


def _grams(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for piece in K.pieces(batch.column("text")):
                _, row, _, at, grams = _selected(piece, min_words)
                at = np.unique(at)
                h = grams[at]
                pairs = np.unique(np.stack([h.view(np.int64), ids[piece.lo + row[at]]], axis=1), axis=0) if len(at) else np.empty((0, 2), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["h", "doc_id"])

    return run


def repeated_grams(texts: DataFrame, min_words: int) -> np.ndarray:
    """Bitmap, as 64-bit words, of the last bits of k-gram hashes that are in more than one document."""
    grams = texts.mapInArrow(_grams(min_words), "h long, doc_id long")
    both = grams.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    bit = F.col("h").bitwiseAND(F.lit(BITMAP - 1))
    words = both.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, dtype=np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _repeats(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    bit = h & np.uint64(BITMAP - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _windows(shared, min_words: int):
    """Hashes of the runs of ``min_words`` words whose minimiser repeats, as one list for each stretch of neighbouring places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for piece in K.pieces(batch.column("text")):
                w, row, start, at, grams = _selected(piece, min_words)
                start = start[_repeats(shared.value, grams[at])]
                h = K.window_hashes(w.hashes, min_words)[start].view(np.int64)
                first = np.flatnonzero((np.diff(start, prepend=-2) > 1) | (np.diff(row[start], prepend=-1) != 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(start)).astype(np.int32)), pa.array(h))
                begin = start[first]
                doc, pos = ids[piece.lo + row[begin]], begin - w.first[row[begin]]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos.astype(np.int32)), lists], names=["doc_id", "pos", "hashes"])

    return run


def _ranges(min_words: int):
    """Ranges of words that runs of ``min_words`` words at some places cover; runs that touch are one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for places in batch.column("places"):
                p = np.unique(places.values.to_numpy())
                first = np.flatnonzero(np.diff(p, prepend=p[0] - min_words - 1) > min_words)
                last = np.append(first[1:], len(p)) - 1
                out.append([{"start": s, "end": e} for s, e in zip(p[first].tolist(), (p[last] + min_words).tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "runs"])

    return run


def _shared_runs(texts: DataFrame, shared, min_words: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, runs``: ranges of words that others hold too. ``doc_id, least``: the smallest other id that does.

    A run of words is owned by the smallest id that holds it. Each other holder meets the owner,
    and the owner meets the smallest of the others, so no more rows than holders are made.
    """
    stretches = set_down(texts.mapInArrow(_windows(shared, min_words), "doc_id long, pos int, hashes array<long>"), "windows")
    windows = stretches.select("doc_id", "pos", F.posexplode("hashes").alias("at", "h")).select("h", "doc_id", (F.col("pos") + F.col("at")).alias("pos"))
    owners = windows.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("h", "owner")
    held = set_down(windows.join(owners, "h").select("doc_id", "pos", "owner"), "held")  # both uses below read it: one join, not two
    places = held.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    ranges = places.mapInArrow(_ranges(min_words), "doc_id long, runs array<struct<start:int,end:int>>")
    pairs = held.filter("doc_id <> owner").groupBy("doc_id", "owner").agg(F.lit(1).alias("one"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("doc_id"), F.col("owner").alias("other")), F.struct(F.col("owner").alias("doc_id"), F.col("doc_id").alias("other")))).alias("p"))
    return ranges, both.groupBy("p.doc_id").agg(F.min("p.other").alias("least"))


def _rows_of_bytes(m: np.ndarray) -> pa.Array:
    """Binary cells whose byte order is the order of the words in them."""
    data = np.ascontiguousarray(m.astype(">u4"))
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (4 * m.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _suffixes(shared, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        step = np.arange(min_words)
        for batch in batches:
            ids = batch.column("doc_id")
            for piece in K.pieces(batch.column("text")):
                w, row, _, at, grams = _selected(piece, min_words)
                at = np.unique(at)
                at = at[_repeats(bitmap, grams[at])]
                short = np.maximum((w.hashes >> np.uint64(32)).astype(np.uint32), 1)  # 0 stands for no word
                for lo in range(0, len(at), 4096):
                    p = at[lo : lo + 4096]
                    r = row[p]
                    right, left = p[:, None] + step, p[:, None] - 1 - step
                    sides = [
                        np.where(right < w.first[r + 1][:, None], short[np.minimum(right, len(short) - 1)], 0),
                        np.where(left >= w.first[r][:, None], short[np.maximum(left, 0)], 0),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(piece.lo + r)), pa.array((p - w.first[r]).astype(np.int32)), *map(_rows_of_bytes, sides)],
                        names=["doc_id", "pos", "right", "left"],
                    )

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u4").reshape(-1, width)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that rows of ``a`` and ``b`` have in common at their beginnings."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def neighbour_matches(doc: np.ndarray, pos: np.ndarray, right: np.ndarray, left: np.ndarray, min_words: int, old: int = 0) -> list[np.ndarray]:
    """Matches between neighbours of sorted suffixes, as rows of ``doc_id, start, end, other``.

    Pairs of which both are among the first ``old`` rows are left out.
    """
    n = len(doc)
    i = np.arange(n)
    pairs = [np.stack([i[d:], i[:-d]]) for d in range(1, NEAR + 1) if n > d]
    if n > 1:
        run = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
        begins = np.searchsorted(run, run, side="left")
        ends = np.searchsorted(run, run, side="right")
        pairs += [np.stack([i[begins > 0], begins[begins > 0] - 1]), np.stack([ends[ends < n], i[ends < n]])]
    if not pairs:
        return []
    x, y = np.unique(np.concatenate(pairs, axis=1), axis=1)
    keep = (doc[x] != doc[y]) & (x >= old)
    x, y = x[keep], y[keep]
    out = []
    for lo in range(0, len(x), 1 << 14):
        a, b = x[lo : lo + (1 << 14)], y[lo : lo + (1 << 14)]
        r, l = _shared(right[a], right[b]), _shared(left[a], left[b])
        long = r + l >= min_words
        a, b, r, l = a[long], b[long], r[long], l[long]
        out += [np.stack([doc[s], pos[s] - l, pos[s] + r, doc[o]], axis=1) for s, o in ((a, b), (b, a))]
    return out


def _batch_of_matches(found: list[np.ndarray]) -> list[pa.Array]:
    m = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 4), dtype=np.int64)
    return [pa.array(m[:, 0]), pa.array(m[:, 1].astype(np.int32)), pa.array(m[:, 2].astype(np.int32)), pa.array(m[:, 3])]


EDGES = "part int, place int, right binary, left binary"


def _compare(min_words: int):
    """Matches inside a sorted range; its first and last rows follow with ``part`` and ``place`` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["doc_id", "start", "end", "other", "part", "place", "right", "left"]

        def edge(rows, begin: bool):
            doc, pos, right, left = rows
            n = len(doc)
            cells = [pa.array(doc), pa.array(pos.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int32())]
            place = np.arange(n) if begin else np.arange(n) - n
            return pa.RecordBatch.from_arrays([*cells, pa.array(place.astype(np.int32)), _rows_of_bytes(right), _rows_of_bytes(left)], names=names)

        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            pos = batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            rows = [doc, pos, _matrix(batch.column("right"), min_words), _matrix(batch.column("left"), min_words)]
            old = 0
            if kept is None:
                yield edge([x[:EDGE] for x in rows], True)
            else:
                old = len(kept[0])
                rows = [np.concatenate([a, b]) for a, b in zip(kept, rows)]
            found = _batch_of_matches(neighbour_matches(*rows, min_words, old))
            n = len(found[0])
            empty = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*found, *empty], names=names)
            other = np.flatnonzero(rows[0] != rows[0][-1])
            tail = np.arange(max(0, len(rows[0]) - EDGE), len(rows[0]))
            if len(other) and other[-1] < tail[0]:
                tail = np.concatenate([[other[-1]], tail])
            kept = [x[tail] for x in rows]
        if kept is not None:
            yield edge(kept, False)

    return run


def _across(edges: list, min_words: int) -> list[np.ndarray]:
    """Matches of the last rows of each range with the first rows of the next that has any."""
    by_part: dict[int, tuple[list, list]] = {}
    for e in edges:
        by_part.setdefault(e["part"], ([], []))[0 if e["place"] >= 0 else 1].append(e)
    found = []
    parts = [by_part[p] for p in sorted(by_part)]
    for (_, last), (first, _) in zip(parts[:-1], parts[1:]):
        rows = sorted(last, key=lambda e: e["place"]) + sorted(first, key=lambda e: e["place"])
        side = lambda c: np.frombuffer(b"".join(bytes(e[c]) for e in rows), dtype=">u4").reshape(len(rows), -1)  # noqa: B023, E731
        found += neighbour_matches(np.array([e["doc_id"] for e in rows]), np.array([e["start"] for e in rows]), side("right"), side("left"), min_words, len(last))
    return found


def passage_matches(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``doc_id, start, end, other``: words from ``start`` to ``end`` are also in document ``other``."""
    return _matches(*_texts_and_bitmap(docs, min_words), min_words)


def _texts_and_bitmap(docs: DataFrame, min_words: int):
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return texts, docs.sparkSession.sparkContext.broadcast(repeated_grams(texts, min_words))


def _matches(texts: DataFrame, bitmap, min_words: int) -> DataFrame:
    suffixes = texts.mapInArrow(_suffixes(bitmap, min_words), SUFFIX)
    gram = F.substring("right", 1, 4 * GRAM)
    found = [_sorted_matches(suffixes, [F.col("right"), F.col("left")], min_words), _sorted_matches(suffixes, [gram, F.col("left"), F.col("right")], min_words)]
    return found[0].union(found[1])


def _sorted_matches(suffixes: DataFrame, sides: list, min_words: int) -> DataFrame:
    """Matches of neighbours in one order of the suffixes, those across ranges included."""
    order = [*sides, F.col("doc_id"), F.col("pos")]
    ranged = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    out = set_down(ranged.mapInArrow(_compare(min_words), f"{MATCH}, {EDGES}"), "matches")
    edges = out.filter("part is not null").collect()  # 2 * EDGE + 1 rows per range at most
    across = [(int(d), int(s), int(e), int(o)) for m in _across(edges, min_words) for d, s, e, o in m]
    return out.filter("part is null").select("doc_id", "start", "end", "other").union(suffixes.sparkSession.createDataFrame(across, MATCH))


def _merged(spans):
    """Union of sorted ``(start, end)`` spans."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def add(done, s):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(joins, longer).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, start, add)


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row per document with passages that are also in others.

    ``spans`` are ranges of words, ``n_repeated`` the words in them, ``first_other`` the smallest
    id that shares any, ``is_first`` whether no smaller id does: the copy a deduplication keeps.
    """
    texts, bitmap = _texts_and_bitmap(docs, min_words)
    found = _matches(texts, bitmap, min_words)
    one = F.struct(F.col("start"), F.col("end"))
    by_doc = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(one)).alias("all"), F.min("other").alias("met"))
    ranges, least = _shared_runs(texts, bitmap, min_words)
    by_doc = by_doc.join(ranges, "doc_id", "full").join(least, "doc_id", "full").withColumn("first_other", F.least("met", "least"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    every = F.array_sort(F.array_distinct(F.concat(F.coalesce("all", none), F.coalesce("runs", none))))
    merged = by_doc.withColumn("spans", _merged(every))
    return merged.select(
        "doc_id", F.size("spans").alias("n_spans"), F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("n_repeated"),
        "spans", "first_other", (F.col("doc_id") < F.col("first_other")).alias("is_first"),
    )
