"""Audit of how far the sources of a language differ in their words, with late text.

Terms are shuffled as digests of eight bytes; their texts stay where they are. Counts go by language,
source and digest. Digests that enough documents of a language hold are then looked up in the texts
once more, and the smallest and the largest text of each show whether one digest stands for several
terms. Such digests are split: only their occurrences are counted again, by text. From there on a
term is its digest and, if that was split, its text; the text of all others is joined back to the
few rows that are reported.

The shares of a term are whole numbers, ``1 + 10^9 (count + 2) div (N + 2 V)``, with ``V`` kept terms
in the language and ``N`` their occurrences; a difference of shares ``p`` and ``q`` weighs
``(p - q)^2 div (p + q)``. Counts are taken as decimals of 38 digits where their products may pass a long.

Two sources are compared over all kept terms, those that neither holds too. A term lies in a bucket of
its language, a source in a block of at most about ``BLOCK`` sources; a task works through the terms of
a bucket for two blocks as one matrix and sends on one sum for each pair of sources, so that neither a
frequent term nor a large source is a task of its own. Every other step is an aggregate with partial
sums, or a join that splits.

Cases. Null text, language and source are empty. Texts that repeat are documents each, as are rows with
equal or null ids. Groups without terms are compared too; a language without kept terms has shares of
none and values of 0. Ties go to the item that is first in UTF-8. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sevfold.llm import textkernel as K
from sevfold.llm.tables import set_down, sized, small_batches

MIN_DOCS = 10
TOP = 10
CELLS = 1 << 17
MIN_BUCKETS = 16
BLOCK = 512
SALTS = 64
#: Rows of counts that a task adds up before it sends them, and rows it sends at once.
HELD, SENT = 1 << 19, 1 << 16
SCALE = 1_000_000_000
TERM = ["lang", "digest", "split"]

#: A second look at the bytes of a term, so that two terms of one digest in one piece are told apart.
_OTHER = (np.arange(256, dtype=np.uint64) * np.uint64(167) + np.uint64(13)).astype(np.uint8)


def _added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns ``group, digest, docs, count`` of several lists as one, equal groups and digests added up."""
    group, digest, docs, count = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort([digest, group])
    group, digest = group[order], digest[order]
    first = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | (group[1:] != group[:-1])]))
    return [group[first], digest[first], np.add.reduceat(docs[order], first), np.add.reduceat(count[order], first)]


def _counter(bits: int):
    """Kernel: ``lang, source, digest, docs, count``, added up over up to ``HELD`` rows of a task."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[list[np.ndarray]] = []
        rows = 0

        def sent(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            lang, source = (pa.array(c, pa.string()) for c in zip(*names))
            for lo in range(0, len(columns[0]), SENT):
                group, digest, docs, count = (c[lo : lo + SENT] for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [lang.take(pa.array(group)), source.take(pa.array(group)), pa.array(digest.view(np.int64)), pa.array(docs), pa.array(count)],
                    names=["lang", "source", "digest", "docs", "count"],
                )

        for batch in batches:
            for piece in K.pieces(batch.column("text")):
                w = K.words(piece, K.LETTER)
                if not len(w.hashes):
                    continue
                here = zip(*(batch.column(c)[piece.lo : piece.hi].to_pylist() for c in ("lang", "source")))
                group = np.array([names.setdefault(g, len(names)) for g in here])
                place = np.empty(len(group), dtype=np.int64)
                place[np.argsort(group, kind="stable")] = np.arange(len(group))  # rows in the order of their groups
                row, digest = w.row_of(), w.hashes & mask
                order = np.lexsort([place[row], digest])
                row, digest = row[order], digest[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (digest[1:] != digest[:-1]) | (group[row[1:]] != group[row[:-1]])
                first = np.flatnonzero(new)
                new[1:] |= row[1:] != row[:-1]  # now the first of each document
                held.append([group[row[first]], digest[first], np.add.reduceat(new.astype(np.int64), first), np.diff(np.append(first, len(order)))])
                rows += len(first)
                if rows >= HELD:
                    held = [_added(held)]
                    rows = len(held[0][0])
                    if 2 * rows > HELD:
                        yield from sent(held[0])
                        names.clear()
                        held, rows = [], 0
        if held:
            yield from sent(_added(held))

    return run


def _speller(bits: int, groups: bool):
    """Kernel: ``digest, term`` of each piece; with ``groups`` also ``lang, source, docs, count`` of the term."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch.column("text")):
                w = K.words(piece, K.LETTER)
                if not len(w.hashes):
                    continue
                digest, row = w.hashes & mask, w.row_of()
                low = K.LOWER[piece.data]
                second = K.range_hashes(_OTHER[low], w.starts, w.ends)
                keys = [second, digest]
                if groups:
                    pair = pa.table({c: batch.column(c)[piece.lo : piece.hi] for c in ("lang", "source")})
                    names = pair.group_by(["lang", "source"], use_threads=False).aggregate([])
                    at = {(a, b): i for i, (a, b) in enumerate(zip(names["lang"].to_pylist(), names["source"].to_pylist()))}
                    group = np.array([at[g] for g in zip(pair["lang"].to_pylist(), pair["source"].to_pylist())])
                    place = np.empty(len(group), dtype=np.int64)
                    place[np.argsort(group, kind="stable")] = np.arange(len(group))
                    keys = [place[row], second, digest]
                order = np.lexsort(keys)
                row, digest, second = row[order], digest[order], second[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (digest[1:] != digest[:-1]) | (second[1:] != second[:-1])
                if groups:
                    new[1:] |= group[row[1:]] != group[row[:-1]]
                first = np.flatnonzero(new)
                raw = low.tobytes()
                terms = [raw[s:e] for s, e in zip(w.starts[order[first]].tolist(), w.ends[order[first]].tolist())]
                columns = {"digest": pa.array(digest[first].view(np.int64)), "term": pa.array(terms, pa.binary()).cast(pa.string())}
                if groups:
                    new[1:] |= row[1:] != row[:-1]
                    take = pa.array(group[row[first]])
                    columns |= {c: names[c].combine_chunks().take(take) for c in ("lang", "source")}
                    columns |= {"docs": pa.array(np.add.reduceat(new.astype(np.int64), first)), "count": pa.array(np.diff(np.append(first, len(order))))}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _read(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """``lang, source, digest, docs, count``, of parts of the texts."""
    return _read(docs).mapInArrow(_counter(bits), "lang string, source string, digest long, docs long, count long")


def _spelt(docs: DataFrame, bits: int, groups: bool) -> DataFrame:
    """``digest, term`` (and ``lang, source, docs, count``) of each piece of the texts."""
    schema = "digest long, term string" + (", lang string, source string, docs long, count long" if groups else "")
    return _read(docs).mapInArrow(_speller(bits, groups), schema)


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts ``lang, source, digest, split, count`` of kept terms, and ``digest, split, term`` with their texts.

    ``split`` is empty but for digests that stand for several terms.
    """
    sums = [F.sum("docs").alias("docs"), F.sum("count").alias("count")]
    counts = set_down(_counted(docs, bits).groupBy("lang", "source", "digest").agg(*sums), "counts")
    often = set_down(counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "digest"), "often")
    digests = set_down(often.select("digest").distinct(), "digests")
    found = _spelt(docs, bits, False).join(sized(digests, 16), "digest")
    known = set_down(found.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "texts")
    whole = known.filter("term = last").select("digest", F.lit("").alias("split"), "term")
    several = set_down(known.filter("term <> last").select("digest"), "several")
    counts = counts.join(sized(often, 64), ["lang", "digest"], "left_semi")
    if several.isEmpty():
        return set_down(counts.select("lang", "source", "digest", F.lit("").alias("split"), "count"), "kept"), whole
    single = counts.join(sized(several, 16), "digest", "left_anti").select("lang", "source", "digest", F.lit("").alias("split"), "count")
    again = _spelt(docs, bits, True).join(sized(several, 16), "digest", "left_semi")
    again = set_down(again.groupBy("lang", "source", "digest", F.col("term").alias("split")).agg(*sums), "again")
    enough = again.groupBy(*TERM).agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select(*TERM)
    apart = again.join(enough, TERM, "left_semi").select("lang", "source", "digest", "split", "count")
    return set_down(single.unionByName(apart), "kept"), whole.unionByName(apart.select("digest", "split", F.col("split").alias("term")).distinct())


def share(count: str, total: str, terms: str) -> Column:
    """``1 + 10^9 (count + 2) div (total + 2 terms)``; none where a language has no terms."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * ({wide(count)} + 2)) div nullif({wide(total)} + 2 * {wide(terms)}, 0)")


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def group_totals(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per group with its total, and one per language with its totals, terms, sources, buckets and blocks."""
    groups = set_down(_read(docs).groupBy("lang", "source").agg(F.count("*").alias("rows")).select("lang", "source"), "groups")
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    of_group = groups.join(sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    terms = kept.groupBy(*TERM).agg(F.sum("count").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(terms, "lang", "left").na.fill(0, ["lang_total", "terms"])
    cells = F.ceil(F.col("terms") * F.least("sources", F.lit(2 * BLOCK)) / CELLS)
    langs = langs.withColumn("buckets", F.greatest(cells, F.lit(MIN_BUCKETS)).cast("int")).withColumn("blocks", F.ceil(F.col("sources") / BLOCK).cast("int"))
    return set_down(of_group, "totals"), set_down(langs, "langs")


def _sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Summed differences of all pairs of sources of a bucket (``right``), from the shares that are not those of absence (``left``).

    ``seen`` counts the terms of the sums; each of the other terms differs by ``absent``.
    """
    right = right.sort_values("source", kind="stable").reset_index(drop=True)
    names, none = right["source"].to_numpy(), right["none"].fillna(1).to_numpy(np.int64)
    terms = left.groupby(["digest", "split"], sort=False).ngroup().to_numpy()
    p = np.tile(none, (terms.max(initial=-1) + 1, 1))
    p[terms, pd.Index(names).get_indexer(left["source"])] = left["p"].to_numpy(np.int64)
    side = right["block"].to_numpy() == right["low"].to_numpy()
    apart = bool((right["low"] != right["high"]).any())
    firsts, seconds, values, absent = [], [], [], []
    for a in np.flatnonzero(side) if apart else range(len(names)):
        others = np.flatnonzero(~side) if apart else np.arange(a + 1, len(names))
        mine, theirs = p[:, a : a + 1], p[:, others]
        values.append(((mine - theirs) ** 2 // (mine + theirs)).sum(axis=0))
        absent.append((none[a] - none[others]) ** 2 // (none[a] + none[others]))
        firsts.append(np.full(len(others), a))
        seconds.append(others)
    a, b, value, rest = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (firsts, seconds, values, absent))
    lang = right["lang"].iloc[0] if len(right) else ""
    low, high = np.minimum(names[a], names[b]), np.maximum(names[a], names[b])
    return pd.DataFrame({"lang": lang, "a": low, "b": high, "value": value, "seen": len(p), "absent": rest})


def pair_values(kept: DataFrame, totals: DataFrame, langs: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for each two sources of a language."""
    groups = totals.join(sized(langs, 100), "lang").select(
        "lang", "source", "buckets", "blocks", "total", "terms", share("0", "total", "terms").alias("none"),
        F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"),
    )
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    sides = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    every = groups.select("lang", "source", "none", "block", "blocks", "buckets", other)
    every = every.select("lang", "source", "none", "block", *sides, F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"))
    shares = kept.join(sized(groups, 200), ["lang", "source"])
    bucket = F.pmod(F.xxhash64("digest", "split"), F.col("buckets")).cast("int").alias("bucket")
    shares = shares.select("lang", "source", "digest", "split", share("count", "total", "terms").alias("p"), bucket, "block", other)
    shares = shares.select("lang", "bucket", *sides, "source", "digest", "split", "p")
    key = ["lang", "bucket", "low", "high"]
    sums = shares.groupBy(*key).cogroup(every.groupBy(*key)).applyInPandas(_sums, "lang string, a string, b string, value long, seen long, absent long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("absent").alias("absent"))
    value = F.col("value") + (F.col("terms") - F.col("seen")) * F.col("absent")
    return sums.join(sized(langs, 100), "lang").select("lang", "a", "b", value.alias("value"))


def term_values(kept: DataFrame, totals: DataFrame, langs: DataFrame) -> DataFrame:
    """``lang, source, digest, split, value`` of terms that a group uses more than its language."""
    whole = kept.groupBy(*TERM).agg(F.sum("count").alias("in_lang"))
    sides = totals.join(sized(langs, 100), "lang").select("lang", "source", "total", "lang_total", "terms")
    rows = kept.filter("count > 0").join(whole, TERM).join(sized(sides, 200), ["lang", "source"])
    rows = rows.select("lang", "source", "digest", "split", share("count", "total", "terms").alias("p"), share("in_lang", "lang_total", "terms").alias("q"))
    return rows.filter("p > q").select("lang", "source", "digest", "split", difference("p", "q").alias("value"))


def _top(rows: DataFrame, order: list[Column], salt: Column, n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group: first of each part of it, then of what is left."""
    place = F.row_number().over(Window.partitionBy("lang", "source", "__salt").orderBy(*order))
    parts = rows.withColumn("__salt", salt).withColumn("__place", place).filter(F.col("__place") <= n).drop("__salt", "__place")
    return parts.withColumn(out, F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col(out) <= n)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: see the module text. ``bits`` narrows digests."""
    kept, texts = kept_counts(docs, min_docs, bits)
    totals, langs = group_totals(docs, kept)
    half = pair_values(kept, totals, langs)
    both = half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )
    order = [F.desc("value"), F.col("item")]
    pairs = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    values = set_down(term_values(kept, totals, langs), "values")
    salt = F.pmod(F.xxhash64("digest", "split"), F.lit(SALTS))
    least = _top(values, [F.desc("value")], salt, top).groupBy("lang", "source").agg(F.min("value").alias("least"))
    chosen = values.join(least, ["lang", "source"]).filter("value >= least")  # with all ties of the last place
    named = chosen.join(texts, ["digest", "split"]).select("lang", "source", F.col("term").alias("item"), "value")
    terms = _top(named, order, F.pmod(F.xxhash64("item"), F.lit(SALTS)), top)
    one = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return one(pairs, "pair").unionByName(one(terms, "term"))


ORACLE = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () rid, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ts
  FROM documents),
o AS MATERIALIZED (SELECT rid, lang, source, unnest(ts) t FROM d),
k AS MATERIALIZED (SELECT lang, t, count(*) cf FROM o GROUP BY lang, t HAVING count(DISTINCT rid) >= {MIN_DOCS}),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(t)::HUGEINT v, coalesce(sum(cf), 0)::HUGEINT n FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, t, count(*)::HUGEINT c FROM o SEMI JOIN k USING (lang, t) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT n.lang, n.source, k.t, coalesce(c, 0) c, (1 + (({SCALE} * (coalesce(c, 0) + 2)) // (n.n + 2 * v)))::BIGINT p,
    (1 + (({SCALE} * (cf::HUGEINT + 2)) // (v.n + 2 * v)))::BIGINT q
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, t)),
s AS (
  SELECT a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) f
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::BIGINT AS "value"
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', t, ((p - q) * (p - q)) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, "value", (row_number() OVER (PARTITION BY lang, source, part ORDER BY "value" DESC, item))::INT AS "rank"
FROM r QUALIFY part = 'pair' OR "rank" <= {TOP}
"""
