"""N-gram Jaccard join: a grouped prefix join over the word shingles of whole documents.

Method. The set of a document is its distinct word shingles as 64-bit hashes. All sets are put
in one global order, rare shingles first; two sets that reach the threshold share a shingle in
their prefixes. Documents with the same prefix and the same size collapse into one group.
Groups that share a prefix shingle are filtered as pairs by size and position, then expanded to
their members (one per distinct set) and verified on the whole sets.

Order. Shingles whose hash is in the lowest part of the hash range come first, by the binary
logarithm of their document frequency and then by hash; the others follow by hash. The part is
chosen so that nearly every prefix lies in it, so only that part has to be counted and carried.
Frequencies below a floor count as rare. The floor is at least the counted rows divided by
``MAX_FREQUENT``, so the table of frequent shingles that is broadcast has at most
``MAX_FREQUENT`` rows at any input size. Any order gives the same result.

Groups of near copies. Frequent shingles are in a prefix only where a document has little else.
Such documents are ordered once more, by the frequencies of all their shingles among themselves:
what sets a copy apart then comes first, and copies that differ in more than the threshold allows
share no prefix shingle, or fail the positional filter. A pair that reaches the threshold either
shares a rare shingle in the first order, or both are such documents and meet in the second.

No group emits all its pairs. First every member of a group is compared with the first member,
and every group of a shingle with the one that has it in front, which has the least of its own. Pairs of the second step are only those that
share a prefix shingle or a group and are not in one component already; they cannot be skipped,
as a link may lead through any member.

Cases. A null or empty text, or one without words, has an empty set and no link. A text with
fewer words than ``size`` is one shingle. Rows with equal sets are linked. ``doc_id`` is a key:
rows that repeat it repeat the text and get the same result each; a null id gets null as its
component and takes no part. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sevfold.llm import textkernel as K
from sevfold.llm.tables import components, set_down, sized, small_batches

MAX_FREQUENT = 1 << 21
#: Logarithm of the most bits that mark repeated shingles; fuller bits let more rows pass and lose none.
MAX_BITS = 28
RARE = 8
#: Bytes of texts that a task works on at once; up to four Python workers of an executor do at a time, two of them in one task.
SMALL = 1 << 18
#: Part of the hash range that is counted, as a multiple of the prefix share.
SPAN = 1.5


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` of which one is shared by any set that reaches the threshold."""
    return n - -(-n * percent // 100) + 1


def _bound(percent: int) -> np.uint64:
    """Hashes below it are counted."""
    return np.uint64(min((1 << 64) - 1, int(min(1.0, SPAN * (100 - percent) / 100) * (1 << 64))))


def _signature(s: np.ndarray) -> tuple[int, int]:
    mixed = K.mix(s + np.uint64(0x51ED270B))
    one = np.add.reduce(mixed, dtype=np.uint64)
    two = np.add.reduce(K.mix(mixed ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _summaries(size: int, percent: int):
    bound = _bound(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for piece in K.pieces(batch.column("text"), SMALL):
                n, n_low, one, two, low = [], [], [], [], []
                for s in K.shingle_sets(K.words(piece, K.NOT_SPACE), size):
                    n.append(len(s))
                    a, b = _signature(s) if len(s) else (0, 0)
                    one.append(a)
                    two.append(b)
                    n_low.append(int(np.searchsorted(s, bound)))
                    keep = max(n_low[-1], prefix_length(len(s), percent) if len(s) else 0)
                    low.append(s[:keep])
                yield pa.RecordBatch.from_arrays(
                    [ids[piece.lo : piece.hi].cast(pa.int64()), pa.array(n, pa.int32()), pa.array(n_low, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), K.long_lists(low)],
                    names=["doc_id", "n", "n_low", "s1", "s2", "low"],
                )

    return run


def summaries(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Set size, two signatures of the set, and its shingles that may be in a prefix."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _summaries(size, percent), "doc_id long, n int, n_low int, s1 long, s2 long, low array<long>"
    )


class Frequencies:
    """What tasks know of the counted shingles: levels of frequent ones, and which may occur twice.

    ``hashes`` (sorted as unsigned) and ``levels`` have at most ``MAX_FREQUENT`` rows. ``bits``
    marks the last bits of hashes that more than one document has: others are in one only.
    """

    def __init__(self, hashes: np.ndarray, levels: np.ndarray, bits: np.ndarray):
        self.hashes, self.levels, self.bits = hashes, levels, bits

    def level(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), dtype=np.int8)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.levels[at], 0).astype(np.int8)

    def repeats(self, h: np.ndarray) -> np.ndarray:
        bit = h & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def frequencies(low: DataFrame, rare: int) -> Frequencies:
    """Count the shingles in ``low``; see ``Frequencies`` for the bounds of what is kept."""
    rows = low.agg(F.sum(F.size("low"))).first()[0] or 0
    floor = max(rare, -(-rows // MAX_FREQUENT))
    counts = low.select(F.explode("low").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    twice = set_down(counts.filter("c > 1"), "counts")
    found = twice.filter(F.col("c") >= floor).select("h", F.least(F.lit(120), F.log2("c") * 4).cast("byte").alias("level")).toArrow()
    h = found["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    size = 1 << min(MAX_BITS, max(20, rows.bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(size - 1))
    words = twice.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Frequencies(h[order], found["level"].to_numpy().astype(np.int8)[order], bits)


PREFIXES = "doc_id long, n int, s1 long, s2 long, pk long, often boolean, pos array<long>, token array<long>"


def _prefixes(percent: int, shared, bound: np.uint64, rare_only: bool):
    """Prefixes in the order of level and hash, hashes not below ``bound`` last.

    ``pk`` stands for the whole prefix, ``often`` tells whether a frequent shingle is in it.
    ``pos`` and ``token`` are the shingles that other documents may have, without the frequent
    ones if ``rare_only``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Frequencies = shared.value
        for batch in batches:
            lists = batch.column("low")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            counted = flat < bound
            rank = np.where(counted, known.level(flat), 127).astype(np.int8)
            frequent = counted & (rank > 0)
            kept = (~counted | known.repeats(flat)) & ~(frequent & rare_only)
            keys, often, places, tokens = [], [], [], []
            for n, a, b in zip(batch.column("n").to_pylist(), offsets[:-1], offsets[1:]):
                taken = a + np.argsort(rank[a:b], kind="stable")[: prefix_length(n, percent) if n else 0]
                keys.append(int(K.window_hashes(flat[taken], len(taken))[0].astype(np.int64)) if n else 0)
                often.append(bool(frequent[taken].any()))
                place = np.flatnonzero(kept[taken])
                places.append(place)
                tokens.append(flat[taken[place]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "n", "s1", "s2")] + [pa.array(keys, pa.int64()), pa.array(often, pa.bool_()), K.long_lists(places), K.long_lists(tokens)],
                names=["doc_id", "n", "s1", "s2", "pk", "often", "pos", "token"],
            )

    return run


def _tokens(prefixes: DataFrame) -> DataFrame:
    """One row per shingle of each prefix."""
    flat = prefixes.select(F.col("doc_id").alias("gid"), "n", F.explode(F.arrays_zip("pos", "token")).alias("t"))
    return flat.select("gid", "n", F.col("t.pos").cast("int").alias("pos"), F.col("t.token").alias("token"))


def _copies(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Prefix shingles ``gid, n, pos, token`` of documents by the frequency of all their shingles among them."""
    whole = _sets(size, False)
    every = texts.mapInArrow(whole, "id long, s array<long>")
    known = texts.sparkSession.sparkContext.broadcast(frequencies(every.select(F.col("s").alias("low")), 2))
    order = _prefixes(percent, known, np.uint64((1 << 64) - 1), False)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            ids, sets = batch.columns
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, sets.value_lengths(), none, none, sets], names=["doc_id", "n", "s1", "s2", "low"])

    prefixes = texts.mapInArrow(lambda batches: order(rows(batches)), PREFIXES)
    # Bits are turned over, so a shingle is another token than in the first order.
    return _tokens(prefixes).withColumn("token", F.bitwise_not("token"))


def _sets(size: int, short: bool):
    """Whole sets as longs; or, for a bound, the last 16 bits of each hash, sorted, as shorts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for piece in K.pieces(batch.column("text"), SMALL):
                rows = list(K.shingle_sets(K.words(piece, K.NOT_SPACE), size))
                if short:
                    column = pa.array([np.sort(r.astype(np.uint16)).tobytes() for r in rows], pa.binary())
                else:
                    column = K.long_lists(rows)
                yield pa.RecordBatch.from_arrays([ids[piece.lo : piece.hi].cast(pa.int64()), column], names=["id", "s"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets of shorts."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(nx[i], ny[j]).sum())


def _may_link(percent: int):
    """Pairs whose common shorts, never fewer than their common shingles, are enough for the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                a, b = np.frombuffer(x, dtype=np.uint16), np.frombuffer(y, dtype=np.uint16)
                keep.append((100 + percent) * _common(a, b) >= percent * (len(a) + len(b)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_sets(docs: DataFrame, pairs: DataFrame, size: int, short: bool) -> DataFrame:
    ids = set_down(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = docs.join(sized(ids, 16), F.col("doc_id") == F.col("id"), "left_semi")
    sets = texts.mapInArrow(_sets(size, short), "id long, s " + ("binary" if short else "array<long>"))
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    )


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the ``(a, b)`` pairs of document ids whose whole sets reach the threshold.

    A bound from 16 bits of each shingle, which never loses a link, leaves few pairs for the
    comparison of whole sets. ``docs`` has one row per id.
    """
    near = set_down(_with_sets(docs, pairs, size, True).mapInArrow(_may_link(percent), "a long, b long"), "near")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = (100 + percent) * shared >= percent * (F.size("sa") + F.size("sb"))
    return _with_sets(docs, near, size, False).filter(links).select("a", "b")


def _low_bound(pairs: DataFrame, low: DataFrame, percent: int) -> DataFrame:
    """Pairs that may reach the threshold by what they share in the counted part of the hash range."""
    part = low.select(F.col("doc_id").alias("id"), "n", F.expr("slice(low, 1, n_low)").alias("l"))
    both = pairs.join(part.toDF("a", "na", "la"), "a").join(part.toDF("b", "nb", "lb"), "b")
    most = F.size(F.array_intersect("la", "lb")) + F.least(F.col("na") - F.size("la"), F.col("nb") - F.size("lb"))
    return both.filter((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _may_reach(percent: int, n1: str, p1: str, n2: str, p2: str):
    """Size and positional filter of two sets that share a shingle at positions ``p1`` and ``p2`` from 0.

    The bound is that of the first shingle they share, before which nothing is common; a pair
    that reaches the threshold passes by that one, whatever becomes of it by others.
    """
    n1, n2, p1, p2 = F.col(n1), F.col(n2), F.col(p1), F.col(p2)
    most = F.least(n1 - p1, n2 - p2)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * most >= percent * (n1 + n2))


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Two documents link when their Jaccard similarity is at least ``percent`` / 100;
    ``component_id`` is the smallest id reachable by links. See the module text for the method.
    """
    spark = docs.sparkSession
    small_batches(spark)
    low = set_down(summaries(docs, size, percent), "shingles")
    counted = spark.sparkContext.broadcast(frequencies(low, RARE))
    known = low.filter("n > 0 and doc_id is not null")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not low.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        known, docs = known.dropDuplicates(["doc_id"]), docs.dropDuplicates(["doc_id"])
    prefixes = set_down(known.mapInArrow(_prefixes(percent, counted, _bound(percent), True), PREFIXES), "prefixes")

    # One member per distinct set, one group per prefix and size; names are smallest ids.
    # Documents of the second order are ordered by whole sets, so each set is a group of its own.
    members = prefixes.groupBy("n", "pk", "s1", "s2").agg(F.min("doc_id").alias("cid"), F.max("often").alias("often"))
    members = set_down(members.withColumn("salt", F.when(F.col("often"), F.col("cid")).otherwise(0)), "members")
    groups = members.groupBy("n", "pk", "salt").agg(F.min("cid").alias("gid"))
    members = set_down(members.join(groups, ["n", "pk", "salt"]), "grouped")
    heads = members.filter("cid = gid").select("gid")
    first_order = prefixes.join(heads, F.col("doc_id") == F.col("gid"), "left_semi")
    copies = set_down(first_order.filter("often").select(F.col("doc_id").alias("id")), "copies")
    texts = docs.join(sized(copies, 16), F.col("doc_id") == F.col("id"), "left_semi")
    tokens = _tokens(first_order).unionByName(set_down(_copies(texts, size, percent), "tokens"))
    firsts = tokens.groupBy("token").agg(F.min(F.struct("pos", "gid", "n")).alias("head"), F.count("*").alias("c")).filter("c > 1")
    shared = set_down(tokens.join(firsts.select("token", "head"), "token"), "shared")

    # Step 1: members against the first of their group, groups against the first of a shingle.
    to_heads = (
        shared.select("gid", "n", "pos", F.col("head.gid").alias("hgid"), F.col("head.n").alias("hn"), F.col("head.pos").alias("hpos"))
        .filter((F.col("gid") != F.col("hgid")) & _may_reach(percent, "n", "pos", "hn", "hpos"))
        .select(F.col("gid").alias("a"), F.col("hgid").alias("b")).distinct()
    )
    in_groups = members.filter("cid <> gid").select(F.col("cid").alias("a"), F.col("gid").alias("b"))
    pairs = set_down(_low_bound(to_heads.union(in_groups), known, percent), "pairs")
    first_links = set_down(_verified(docs, pairs, size, percent), "links1")
    comps = set_down(components(first_links), "comps1")

    # Step 2: what still is in different components and shares a group or a prefix shingle.
    placed = set_down(
        members.select("cid", "gid").join(comps, F.col("cid") == F.col("node"), "left")
        .select("cid", "gid", F.coalesce("comp", "cid").alias("comp")),
        "placed",
    )
    mixed = placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("gid")
    inside = placed.join(mixed, "gid", "left_semi")
    inside = inside.alias("x").join(inside.alias("y"), (F.col("x.gid") == F.col("y.gid")) & (F.col("x.comp") < F.col("y.comp")))
    inside = inside.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))

    parts = placed.select("gid", "comp").distinct()
    open_tokens = shared.join(parts, "gid").select("token", "gid", "n", "pos", "comp")
    open_heads = open_tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    open_tokens = set_down(open_tokens.join(open_heads, "token", "left_semi"), "open")
    other = open_tokens.toDF("token", "gid2", "n2", "pos2", "comp2")
    across = (
        open_tokens.join(other, "token")
        .filter((F.col("gid") < F.col("gid2")) & (F.col("comp") != F.col("comp2")) & _may_reach(percent, "n", "pos", "n2", "pos2"))
        .select("gid", "comp", "gid2", "comp2").distinct()
        .join(placed.select(F.col("gid"), F.col("comp"), F.col("cid").alias("a")), ["gid", "comp"])
        .join(placed.select(F.col("gid").alias("gid2"), F.col("comp").alias("comp2"), F.col("cid").alias("b")), ["gid2", "comp2"])
        .select("a", "b")
    )
    left = set_down(_low_bound(inside.union(across).distinct(), known, percent), "pairs")
    more = set_down(_verified(docs, left, size, percent), "links2") if not left.isEmpty() else left
    whole = components(first_links.union(more)) if not more.isEmpty() else comps

    named = (
        members.select("n", "s1", "s2", "cid").join(whole, F.col("cid") == F.col("node"), "left")
        .select("n", "s1", "s2", F.coalesce("comp", "cid").alias("comp"))
    )
    return (
        low.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Documents without near copies: of each component the row with the smallest id stays.

    Rows with a null id stay; of rows that repeat an id one stays.
    """
    found = set_down(ngram_components(docs, size, percent), "near")
    gone = set_down(found.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(sized(gone, 16), "doc_id", "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    repeated = set_down(repeated, "repeated")
    once = kept.join(sized(repeated, 16), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(sized(repeated, 16), "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
