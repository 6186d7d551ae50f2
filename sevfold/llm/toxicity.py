"""Toxicity by a weighted finite-state pattern grammar over clauses.

Each clause is read word by word by a cascade of small transducers. The insult transducer maps
words to weights, the threat transducer verbs of harm; the negation transducer marks the words
that follow a negation, the reported-speech transducer the rest of a clause after a verb of
saying, and the target transducer a clause that speaks to or of somebody. Their composition gives
each matched word the product of its weight and the factors of the marks it carries, plus the
bonus of a target. A clause scores its best match, a document its best clause; documents without
a match score what such documents are worth.

Learning. The insult lexicon holds whole words and word beginnings (so inflected and compound
forms match) with the log-odds of being in a toxic text. It takes those that are far too frequent
in toxic texts for chance, given how many candidates there are. It is learnt on three quarters of the
learning rows; the factors of the marks and the probability of each range of document scores on
the rest. The learning rows are samples of about ``per_class`` toxic and twice as many other texts, with the smallest
hashes of their ids, read whole: this is the bound of what the driver and a broadcast hold.
Scoring reads every text whole and shuffles nothing.

Cases. A null or empty text has no match. A document labelled more than once is toxic if any
label says so; null labels and null ids teach nothing. With nothing to learn from, the fixed word
list below stands alone. Case is ignored (Latin-1 letters). Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sevfold.llm import textkernel as K
from sevfold.llm.langid import fold_of
from sevfold.llm.tables import set_down, sized, small_batches

# Seed words of the transducers in the languages of the corpus.
INSULTS = ("idiot", "moron", "loser", "scum", "trash", "stupid", "pathetic", "worthless", "disgusting", "clown", "imbecile", "vermin", "idiota", "imbécile", "idiote", "dummkopf", "abschaum", "estúpido", "basura")
THREATS = ("kill", "hurt", "destroy", "murder", "beat", "burn", "tuer", "détruire", "töten", "vernichten", "matar", "destruir")
TARGETS = ("you", "your", "he", "she", "they", "him", "her", "them", "people", "tu", "vous", "toi", "ils", "elles", "du", "ihr", "sie", "dich", "euch", "usted", "ustedes", "ellos", "ellas")
NEGATIONS = ("not", "never", "no", "isn", "aren", "wasn", "don", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca")
REPORTING = ("said", "says", "called", "wrote", "quoted", "claims", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo", "escribió", "llamó")

SEED_WEIGHT, THREAT_WEIGHT, TARGET_BONUS = 5.0, 4.0, 0.5
NEGATED, REPORTED = 0.3, 0.5
#: Words after a negation that it covers.
REACH = 4
#: Bytes of the word beginnings that may enter the lexicon.
BEGINNINGS = tuple(range(3, 13))
#: Documents of a mark, or of a score range, that weigh as much as the prior.
PRIOR = 5.0
#: Words that the lexicon may expect to take by chance.
CHANCE = 0.3
RANGES = (0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5)
_WHOLE = np.uint64(0xA0761D6478BD642F)
_END = re.compile(rb"[.!?;\n]")


def _hash(word: str) -> np.uint64:
    data = K.lower_latin(np.frombuffer(word.encode(), dtype=np.uint8))
    return K.range_hashes(data, np.array([0]), np.array([len(data)]))[0]


def _whole(h: np.ndarray) -> np.ndarray:
    return K.mix(h ^ _WHOLE)


def _features(piece: K.Piece) -> tuple[K.Words, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Words of a piece, and for length 0 (whole) and each beginning the words that have it and their hashes."""
    low = K.lower_latin(piece.data)
    starts, ends, first = K.word_ranges(piece, K.LETTER)
    w = K.Words(starts, ends, K.range_hashes(low, starts, ends), first)
    found = {0: (np.arange(len(starts)), _whole(w.hashes))}
    for n in BEGINNINGS:
        at = np.flatnonzero(ends - starts >= n)
        found[n] = (at, K.range_hashes(low, starts[at], starts[at] + n))
    return w, found


def _document_counts(known):
    """Documents by feature and label, added up per piece; with ``known`` only of those features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value if known is not None else None
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for piece in K.pieces(batch.column("text")):
                w, found = _features(piece)
                row = w.row_of()
                pairs = []
                for at, h in found.values():
                    if wanted is not None:
                        keep = np.isin(h, wanted)
                        at, h = at[keep], h[keep]
                    pairs.append(np.unique(np.stack([h, row[at].astype(np.uint64)]), axis=1) if len(h) else np.empty((2, 0), dtype=np.uint64))
                h, r = np.concatenate(pairs, axis=1)
                u, inverse = np.unique(h, return_inverse=True)
                one = np.bincount(inverse, weights=toxic[piece.lo + r.astype(int)], minlength=len(u)).astype(np.int64)
                both = np.bincount(inverse, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(one), pa.array(both - one)], names=["h", "c1", "c0"])

    return run


@dataclass
class Model:
    """Lexicon in hash order, factors of marks, bounds and probabilities of score ranges."""

    hashes: np.ndarray
    weights: np.ndarray
    lengths: tuple[int, ...] = BEGINNINGS
    negated: float = NEGATED
    reported: float = REPORTED
    chances: np.ndarray = field(default_factory=lambda: np.array([0.1, 0.15, 0.25, 0.4, 0.6, 0.8, 0.9, 0.95]))

    def __post_init__(self):
        named = lambda words: {int(_hash(w)) for w in words}
        self.threats, self.targets = named(THREATS), named(TARGETS)
        self.negations, self.reporting = named(NEGATIONS), named(REPORTING)


def read_clause(words: list[int], weights: list[float], model: Model) -> tuple[float, bool, bool]:
    """Run the composed transducers over a clause: best match, and whether it is negated or reported."""
    best, covered, reported, target = (0.0, False, False), 0, False, False
    for word, weight in zip(words, weights):
        if word in model.threats:
            weight = max(weight, THREAT_WEIGHT)
        if weight > 0:
            factor = (model.negated if covered > 0 else 1.0) * (model.reported if reported else 1.0)
            best = max(best, (weight * factor, covered > 0, reported))
        covered = REACH if word in model.negations else covered - 1
        reported = reported or word in model.reporting
        target = target or word in model.targets
    score, neg, rep = best
    return (score + TARGET_BONUS if score > 0 and target else score), neg, rep


def _matches(piece: K.Piece, model: Model) -> dict[int, tuple[float, bool, bool]]:
    """Best clause of each row that has any match."""
    w, found = _features(piece)
    weight = np.zeros(len(w.starts))
    for n, (at, h) in found.items():
        if len(model.hashes) and (n == 0 or n in model.lengths):
            i = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
            weight[at] = np.maximum(weight[at], np.where(model.hashes[i] == h, model.weights[i], 0.0))
    threat = np.isin(w.hashes, np.array(sorted(model.threats), dtype=np.uint64))
    row = w.row_of()
    out = {}
    for r in np.unique(row[(weight > 0) | threat]).tolist():
        a, b = int(w.first[r]), int(w.first[r + 1])
        begin = int(piece.offsets[r])
        text = piece.data[begin : int(piece.offsets[r + 1])].tobytes()
        ends = np.array([begin + m.start() for m in _END.finditer(text)], dtype=np.int64)
        clause = np.searchsorted(ends, w.starts[a:b])
        hit = np.unique(clause[(weight[a:b] > 0) | threat[a:b]])
        lo, hi = np.searchsorted(clause, hit, side="left"), np.searchsorted(clause, hit, side="right")
        out[r] = max(read_clause(w.hashes[a + i : a + j].tolist(), weight[a + i : a + j].tolist(), model) for i, j in zip(lo, hi))
    return out


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch.column("text")):
                rows = piece.hi - piece.lo
                x, neg, rep = np.zeros(rows), np.zeros(rows, dtype=bool), np.zeros(rows, dtype=bool)
                for r, best in _matches(piece, shared.value).items():
                    x[r], neg[r], rep[r] = best
                kept = [batch.column(c)[piece.lo : piece.hi] for c in batch.schema.names if c != "text"]
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(x), pa.array(neg), pa.array(rep)], names=[*names, "x", "negated", "reported"])

    return run


def _lexicon(rows: pd.DataFrame, n1: int, n0: int, tested: int, least: int, min_odds: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log-odds of features that chance does not explain, with the seeds."""
    c1, c0 = rows["c1"].to_numpy(dtype=float), rows["c0"].to_numpy(dtype=float)
    odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    n, q = c1 + c0, c1 / np.maximum(c1 + c0, 1)
    base = n1 / max(1, n1 + n0)
    # Chernoff bound of seeing this share of toxic texts or more, were the word the same in both.
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = -n * (np.where(q > 0, q * np.log(q / base), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - base)), 0))
    h = rows["h"].to_numpy(dtype=np.int64).view(np.uint64)
    keep = (c1 >= least) & (odds >= min_odds) & (bound < np.log(CHANCE / max(tested, 1)))
    found = dict(zip(h[keep].tolist(), odds[keep].tolist()))
    seen = dict(zip(h.tolist(), zip(n.tolist(), odds.tolist())))
    for word in INSULTS:
        key = int(_whole(np.array([_hash(word)]))[0])
        many, weight = seen.get(key, (0, 0.0))
        found.setdefault(key, SEED_WEIGHT if many < 2 * least else max(weight, 0.0))
    hashes = np.array(sorted(found), dtype=np.uint64)
    return hashes, np.array([found[int(k)] for k in hashes])


def _factor(rows: pd.DataFrame, prior: float) -> float:
    """Share of toxic texts among those whose best match carries a mark, drawn to the prior."""
    return float((rows["toxic"].sum() + prior * PRIOR) / (len(rows) + PRIOR))


def fit(learn: DataFrame, labels: DataFrame, per_class: int = 6000, least: int = 5, min_odds: float = 2.5) -> Model:
    """Fit on the rows of ``learn`` that ``labels`` (``doc_id, toxic``) mark; see the module text for the bound."""
    spark = learn.sparkSession
    small_batches(spark)
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = set_down(marks, "marks")
    rows = learn.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sized(marks, 24), F.col("doc_id") == F.col("id"))
    narrow = learn.select(F.col("doc_id").cast("long").alias("id")).join(sized(marks, 24), "id")
    total = {r["toxic"]: r["n"] for r in narrow.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, total.get(1, 0)))).otherwise(min(1.0, 2 * per_class / max(1, total.get(0, 0))))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))
    sample = set_down(rows.filter(place < share).select("doc_id", "text", "toxic"), "sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) > 0
    sizes = {r["toxic"]: r["n"] for r in sample.filter(part).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    counts = "h long, c1 long, c0 long"
    often = sample.filter(part & (F.col("toxic") == 1)).select("text", "toxic").mapInArrow(_document_counts(None), counts)
    often = set_down(often.groupBy("h").agg(F.sum("c1").alias("c1")), "features")
    tested = often.count()
    wanted = often.filter(F.col("c1") >= least).select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64)
    known = spark.sparkContext.broadcast(np.sort(wanted))
    both = sample.filter(part).select("text", "toxic").mapInArrow(_document_counts(known), counts).groupBy("h").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    model = Model(*_lexicon(both.toArrow().to_pandas(), n1, n0, tested, least, min_odds))

    # Marks first: with factors of 1, what is a match under a mark worth?
    model.negated = model.reported = 1.0
    read = lambda: sample.filter(~part).select("text", "toxic").mapInArrow(_scores(spark.sparkContext.broadcast(model)), "toxic int, x double, negated boolean, reported boolean").toArrow().to_pandas()
    trial = read()
    hit = trial[trial["x"] > 0]
    model.negated = _factor(hit[hit["negated"] & ~hit["reported"]], NEGATED)
    model.reported = _factor(hit[hit["reported"] & ~hit["negated"]], REPORTED)
    if len(trial):
        trial = read()
        weight = np.where(trial["toxic"] == 1, total.get(1, 0) / max(1, (trial["toxic"] == 1).sum()), total.get(0, 0) / max(1, (trial["toxic"] == 0).sum()))
        weight = weight / weight.mean()
        at = np.searchsorted(RANGES, trial["x"].to_numpy(), side="right")
        toxic = np.bincount(at, weights=weight * trial["toxic"], minlength=len(RANGES) + 1)
        every = np.bincount(at, weights=weight, minlength=len(RANGES) + 1)
        model.chances = np.maximum.accumulate((toxic + PRIOR * model.chances) / (every + PRIOR))
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the probability ``score`` that a text is toxic, by its best clause ``x``."""
    small_batches(docs.sparkSession)
    read = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = read.mapInArrow(_scores(shared), f"{schema}, x double, negated boolean, reported boolean")
    # Within a range the score rises with x, so that texts of a range are ranked.
    steps = [0.0, *RANGES, 12.0]
    value = F.lit(float(model.chances[0]))
    for i in range(1, len(model.chances)):
        a, b = float(model.chances[i]), float(model.chances[i + 1]) if i + 1 < len(model.chances) else min(1.0, float(model.chances[i]) + 0.01)
        inside = (F.least(F.col("x"), F.lit(steps[i + 1])) - steps[i]) / (steps[i + 1] - steps[i])
        value = F.when(F.col("x") >= steps[i], a + (b - a) * inside).otherwise(value)
    return scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score and verdict of each row, learnt from the labelled rows outside of fold 1 of 3."""
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = fit(docs.filter(~held_out), labels)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
