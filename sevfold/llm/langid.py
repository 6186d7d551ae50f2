"""Language identification by the nearest of several centroids per language.

A text is a vector of letter trigrams (with word boundaries) hashed to ``DIMS`` places, weighted
by sublinear term frequency and inverse document frequency, with length 1. Each language has up
to ``CENTROIDS`` centroids from spherical k-means over its learning texts. A text gets the
language of the centroid with the highest cosine, and its score is that cosine. A text whose
cosine is below the floor of that language is rejected.

Fitting reads a bounded sample: of each language about ``per_lang`` texts (all, if fewer) with
the smallest hashes of their ids, whole. Prediction reads every text whole and shuffles nothing.

Cases. A null text, or one without any letter (``½`` and ``Ⅷ`` are none), is ``und`` with score 0 and is rejected. A text
with letters but nothing in common with any centroid gets the most frequent language, score 0,
and is rejected. Ties go to the language that is first by name. With nothing to learn from, all
texts are ``und``. Learning rows need a non-null text and language. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sevfold.llm import textkernel as K
from sevfold.llm.tables import small_batches

UND = "und"
DIMS = 4096
CENTROIDS = 4
#: Share of a language's learning texts that may lie below its floor, and how far the floor is below that.
FLOOR_SHARE, FLOOR_SLACK = 0.002, 0.5
#: Columns of a prediction: language, cosine, whether it is not rejected.
OUT = ("__lang_pred", "__lang_score", "__lang_kept")
_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that are no decimal digits


def counts(piece: K.Piece) -> np.ndarray:
    """Trigram counts of each row: rows x DIMS."""
    rows = piece.hi - piece.lo
    low = K.lower_latin(piece.data)
    low[~K.LETTER[piece.data]] = 0
    n = len(low)
    before, after = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
    before[1:], after[:-1] = low[:-1], low[1:]
    starts = piece.offsets[:-1]
    before[starts[starts < n]] = 0
    ends = piece.offsets[1:]
    after[ends[ends > 0] - 1] = 0
    code = ((before << 16) | (low.astype(np.uint32) << 8) | after) * np.uint32(0x9E3779B1) >> np.uint32(20)
    row = np.repeat(np.arange(rows), np.diff(piece.offsets))
    keep = low > 0
    return np.bincount(row[keep] * DIMS + code[keep], minlength=rows * DIMS).reshape(rows, DIMS)


@dataclass
class Model:
    """Languages by name, the weight of each place, centroids with the number of their language, floors."""

    langs: list[str]
    fallback: str
    idf: np.ndarray
    centroids: np.ndarray
    lang_of: np.ndarray
    floors: np.ndarray


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c, dtype=np.float32)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [x.mean(axis=0)]
    for _ in range(k - 1):
        seeds.append(x[int(np.argmin(np.max(x @ np.array(seeds).T, axis=1)))])
    c = np.array(seeds)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in K.pieces(batch.column("text"), rows=128):
            c = counts(piece)
            found = [np.flatnonzero(row) for row in c]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[piece.lo : piece.hi].cast(pa.int64()), batch.column("lang")[piece.lo : piece.hi],
                 K.long_lists(found).cast(pa.list_(pa.int32())), K.long_lists([row[f] for row, f in zip(c, found)]).cast(pa.list_(pa.int32()))],
                names=["doc_id", "lang", "at", "count"],
            )


def fit(learn: DataFrame, per_lang: int = 1000) -> Model:
    """Fit on rows of ``doc_id, text, lang``; see the module text for the bound of the sample."""
    small_batches(learn.sparkSession)
    usable = learn.filter("text is not null and lang is not null")
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    empty = Model([], UND, np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    if not sizes:
        return empty
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], per_lang / r["count"])])[F.col("lang")]
    place = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 32) - 1))) / F.lit(float(1 << 32))
    sample = usable.select("doc_id", "text", "lang").filter(place < share)
    rows = sample.mapInArrow(_sparse, "doc_id long, lang string, at array<int>, count array<int>").toArrow()
    rows = rows.filter(pc.greater(pc.list_value_length(rows["at"]), 0)).sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    lists, names = rows["at"].combine_chunks(), np.array(rows["lang"].to_pylist(), dtype=object)
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    row = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy(zero_copy_only=False))
    x[row, lists.flatten().to_numpy()] = rows["count"].combine_chunks().flatten().to_numpy()
    del rows, lists, row
    if not len(x):
        return empty
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighted(x, idf)
    langs = sorted(set(names))
    centroids, lang_of, floors = [], [], []
    for i, lang in enumerate(langs):
        own = x[names == lang]
        c = _cluster(own, min(CENTROIDS, len(own)))
        centroids.append(c)
        lang_of += [i] * len(c)
        floors.append(FLOOR_SLACK * float(np.quantile((own @ c.T).max(axis=1), FLOOR_SHARE)))
    fallback = next((r["lang"] for r in sizes if r["lang"] in langs), langs[0])
    return Model(langs, fallback, idf, np.concatenate(centroids).astype(np.float32), np.array(lang_of), np.array(floors))


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            texts = batch.column("text")
            for piece in K.pieces(texts, rows=128):
                rows = piece.hi - piece.lo
                pred, score, kept = [UND] * rows, [0.0] * rows, [False] * rows
                if model.langs:
                    cosine = weighted(counts(piece), model.idf) @ model.centroids.T
                    best = np.stack([cosine[:, model.lang_of == i].max(axis=1) for i in range(len(model.langs))], axis=1)
                    near = best.argmax(axis=1)
                    top = np.clip(best.max(axis=1), 0.0, 1.0)
                    for i, text in enumerate(texts[piece.lo : piece.hi].to_pylist()):
                        if text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text)):
                            score[i] = float(top[i])
                            pred[i] = model.langs[near[i]] if top[i] > 0 else model.fallback
                            kept[i] = bool(top[i] > 0 and top[i] >= model.floors[near[i]])
                extra = [batch.column(c)[piece.lo : piece.hi] for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays(
                    [*extra, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())],
                    names=[*batch.schema.names, *OUT],
                )

    return run


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (with ``text``) of ``docs``, then those of ``OUT``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # langs x CENTROIDS x DIMS floats
    read = docs.select(*["`{}`".format(c.replace("`", "``")) for c in keep])
    schema = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in read.schema)
    return read.mapInArrow(_predictor(shared), f"{schema}, {OUT[0]} string, {OUT[1]} double, {OUT[2]} boolean")


def fold_of(doc_id: Column, n: int) -> Column:
    """Fixed fold of a row: crc32 of its id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def identify(docs: DataFrame) -> DataFrame:
    """Predicted language of each row, learnt from the rows outside of fold 2 of 4."""
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return predict(docs, model, ["doc_id", "text"]).select("doc_id", held_out.alias("held_out"), F.col(OUT[0]).alias("lang_pred"), F.col(OUT[1]).alias("score"), (~F.col(OUT[2])).alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is not rejected, with the columns they had."""
    model = fit(docs.select("doc_id", "text", "lang"))
    return predict(docs, model, docs.columns).filter(F.col(OUT[2])).drop(*OUT)
