"""Best-fit packing of documents into training windows under conflicts.

A window (bin) holds at most ``capacity`` words, at most one document of each duplicate cluster
and at most ``per_source`` documents of each source. Texts longer than the capacity are cut:
full windows stand alone, the rest is packed like a short text.

Bins are kept in the order of their free room. A document goes to the tightest bin it is
compatible with: search starts at the first bin with enough room and goes on to its successors
until the bitmaps of sources and clusters of a bin show no conflict; if none is left, a new bin
opens. Bitmaps have one bit per source (times its place) and per cluster of the shard, so they
are exact. Bins whose room is below the smallest document that is still to come are closed.

Scale. Documents are dealt by a hash of their id to shards of about ``shard_rows`` documents, so
a hot source is in all shards and no task grows with the input; each shard is packed on its own,
in the order of falling length, then id. Only ids, sources, clusters and lengths are shuffled.

Cases. A null or empty text, or one without words, has length 0 and takes no room: it goes to no
bin (``bin_id`` null). A null source or cluster conflicts with nothing. Ties go to the bin that
was opened first. A null id is packed like any other; rows that repeat are packed each (and
conflict as duplicates, having the same text). Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PLACED = "doc_id long, piece int, bin_id string, start int, n_words int"


class Bins:
    """Open bins in the order of free room, then of opening."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, sources: list[int], cluster: int) -> tuple[int, int]:
        """Bin and start of a document; ``sources`` are the bits it may take, of which it takes the first free one."""
        every = 0
        for bit in sources:
            every |= bit
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, b = self.order[at]
            if not self.clusters[b] & cluster and (not sources or self.sources[b] & every != every):
                del self.order[at]
                break
            at += 1
        else:
            room, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.clusters[b] |= cluster
        for bit in sources:
            if not self.sources[b] & bit:
                self.sources[b] |= bit
                break
        if room > size:
            insort(self.order, (room - size, b))
        return b, self.capacity - room

    def close(self, below: int) -> None:
        """Drop bins with less room than ``below``: nothing that is left fits in them."""
        del self.order[: bisect_left(self.order, (below, -1))]


def pack(docs: list[tuple], capacity: int, per_source: int) -> Iterator[tuple]:
    """``key, piece, bin, start, size`` of documents ``(key, source, cluster, size)`` in packing order."""
    rests, fulls = [], []
    for key, source, cluster, size in docs:
        n_full = size // capacity
        fulls += [(key, p, capacity) for p in range(n_full)]
        if size % capacity:
            rests.append((size % capacity, key, n_full, source, cluster))
    rests.sort(key=lambda r: -r[0])  # stable: ties stay in packing order
    smallest = min((r[0] for r in rests), default=0)
    bins = Bins(capacity)
    bit: dict[tuple, int] = {}
    one = lambda *k: 1 << bit.setdefault(k, len(bit)) if k[-1] is not None else 0
    for size, key, piece, source, cluster in rests:
        sources = [one("s", i, source) for i in range(per_source)] if source is not None else []
        b, start = bins.put(size, sources, one("c", cluster))
        bins.close(smallest)
        yield key, piece, b, start, size
    for i, (key, piece, size) in enumerate(fulls):
        yield key, piece, len(bins.sources) + i, 0, size


def _packer(capacity: int, per_source: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(d) else int(d) for d in rows["doc_id"]]
        # Where ids or rows repeat, all that decides is in the key, so the order is one of equals.
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows["cluster"].iat[i] or "", int(rows["n"].iat[i])))
        source = [s if isinstance(s, str) else None for s in rows["source"]]
        cluster = [c if isinstance(c, str) else None for c in rows["cluster"]]
        docs = [(ids[i], source[i], cluster[i], int(rows["n"].iat[i])) for i in order]
        out = [(d, p, f"{key[0]}-{b}", s, n) for d, p, b, s, n in pack(docs, capacity, per_source)]
        out += [(d[0], 0, None, None, 0) for d in docs if d[3] == 0]
        frame = pd.DataFrame(out, columns=["doc_id", "piece", "bin_id", "start", "n_words"])
        return frame.astype({"doc_id": "Int64", "piece": "int32", "start": "Int32", "n_words": "int32"})

    return run


def text_cluster(text: Column) -> Column:
    """Duplicate cluster of a text: digest of its words without case; null for a text without words."""
    words = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(F.length(words) > 0, F.md5(words.cast("binary")))


def pack_documents(docs: DataFrame, cluster: Column | None = None, capacity: int = 2048, per_source: int = 2, shard_rows: int = 4096) -> DataFrame:
    """``doc_id, piece, bin_id, start, n_words``: one row per piece of a document.

    ``piece`` numbers the parts of a cut text, ``start`` is the word of the bin where it begins.
    """
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (text_cluster(F.col("text")) if cluster is None else cluster.cast("string")).alias("cluster"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("n"),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("cluster", "n")).otherwise(F.xxhash64("doc_id"))
    dealt = sizes.withColumn("shard", F.pmod(salt, F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_packer(capacity, per_source), PLACED)
